"""Schemas of the library's tables and the amino-acid dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROTEIN_HIT = "source string, id string, title string, organism string, summary string, url string"
LITERATURE_HIT = "source string, id string, title string, journal string, year int, abstract string, is_open_access boolean, fulltext_url string, url string, pmcid string, host_venue string"
ATOM = "structure_id string, model int, chain string, resi string, resn string, atom_name string, element string, x double, y double, z double, b double"
MESSAGE = "message_id string, ts string, role string, content string, source_notebook string, metadata string"
THREAD = f"thread_id string, root_key string, title string, created_at string, updated_at string, llm_process_tag string, metadata string, messages array<struct<message_id: string, ts: string, role: string, content: string, source_notebook: string, metadata: string>>"
ENTITY_BLOCK = "struct<id: string, sequence: string, structure_path: string, pdb_path: string, pdb_id: string, group: int, smiles: string, ccd: string>"
DESIGN_SPEC = f"entities array<struct<protein: {ENTITY_BLOCK}, peptide: {ENTITY_BLOCK}, ligand: {ENTITY_BLOCK}>>"
PLAN_STEP = "step_index int, step_name string, tools_from_registry string, python_code_to_execute string, rationale string, description string"

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"

#: Three-letter code, polarity group, Kyte-Doolittle hydropathy, Hopp-Woods polarity, side-chain volume.
AMINO_ACIDS = {
    "A": ("ALA", "np", 1.8, -0.5, 67.0), "C": ("CYS", "p~", 2.5, -1.0, 86.0), "D": ("ASP", "p-", -3.5, 3.0, 91.0), "E": ("GLU", "p-", -3.5, 3.0, 109.0),
    "F": ("PHE", "np", 2.8, -2.5, 135.0), "G": ("GLY", "np", -0.4, 0.0, 48.0), "H": ("HIS", "p+", -3.2, -0.5, 118.0), "I": ("ILE", "np", 4.5, -1.8, 124.0),
    "K": ("LYS", "p+", -3.9, 3.0, 135.0), "L": ("LEU", "np", 3.8, -1.8, 124.0), "M": ("MET", "np", 1.9, -1.3, 124.0), "N": ("ASN", "p~", -3.5, 0.2, 96.0),
    "P": ("PRO", "np", -1.6, 0.0, 90.0), "Q": ("GLN", "p~", -3.5, 0.2, 114.0), "R": ("ARG", "p+", -4.5, 3.0, 148.0), "S": ("SER", "p~", -0.8, 0.3, 73.0),
    "T": ("THR", "p~", -0.7, -0.4, 93.0), "V": ("VAL", "np", 4.2, -1.5, 105.0), "W": ("TRP", "np", -0.9, -3.4, 163.0), "Y": ("TYR", "p~", -1.3, -2.3, 141.0),
}


def aa_dim(spark: SparkSession) -> DataFrame:
    """One row for each amino acid: (aa, resn, polarity, kd, hw, volume)."""
    rows = [F.struct(F.lit(a).alias("aa"), *(F.lit(v).alias(n) for n, v in zip(("resn", "polarity", "kd", "hw", "volume"), values, strict=True))) for a, values in AMINO_ACIDS.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def require_columns(df: DataFrame, names, what: str = "table") -> DataFrame:
    """df, or ValueError when the plan is built if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")
    return df
