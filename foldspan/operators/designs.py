"""Design tables: numbering, metric assembly, threshold filter, best per structure, ranking and refolding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldspan.functions.text import blank, filled

KEY = ["structure_idx", "sequence_idx"]
#: Keys of the best designs that are broadcast at most.
BROADCAST_KEYS = 10_000
LIMITS = {"rmsd": 2.5, "ipae": 10.0, "binder_rmsd": 1.0, "binder_plddt": 80.0}


def keyed(*tables: DataFrame) -> list[str]:
    """The key of a design: with its run where the tables have one, so that runs in one table do not mix. Tables of which
    only some name a run raise, as their rows cannot be told apart."""
    named = ["run_id" in t.columns for t in tables]
    if any(named) and not all(named):
        raise ValueError("some of the tables have a run_id and some have none")
    return (["run_id"] if all(named) else []) + KEY


def assemble_metrics(records: DataFrame, *metrics: DataFrame) -> DataFrame:
    """Design records with their metric tables, joined on the key, and on run where they have it; of rows that repeat a key the
    first in order counts, so that each design stays, once."""
    for m in metrics:
        keys = keyed(records, m)
        rest = [c for c in m.columns if c not in keys]
        one = m.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__m")).select(*keys, "__m.*")
        records = records.join(one, keys, "left")
    return records


def number_designs(df: DataFrame, run: list[str]) -> DataFrame:
    """Adds design_idx, the place of a design in its run by key, from 0; an existing one stays."""
    if "design_idx" in df.columns:
        return df
    return df.withColumn("design_idx", F.row_number().over(Window.partitionBy(*run).orderBy(*KEY)) - 1)


def mean_score(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(scores), F.lit(0))


def binder_suffix(sequence: Column, length: Column) -> Column:
    """The last length letters; length 0 keeps all."""
    return F.when(length == 0, sequence).otherwise(F.right(sequence, length))


def known(c: str) -> Column:
    """A metric with NaN as null: Spark takes NaN for the largest number."""
    return F.when(~F.isnan(c), F.col(c))


def filter_designs(df: DataFrame, limits: dict | None = None) -> DataFrame:
    """Designs strictly within limits (the confidence above its limit); a missing metric fails."""
    x = LIMITS | (limits or {})
    return df.filter((known("rmsd") < x["rmsd"]) & (known("ipae") < x["ipae"]) & (known("binder_rmsd") < x["binder_rmsd"]) & (known("binder_plddt") > x["binder_plddt"]))


def select_best_per_structure(df: DataFrame, by: str = "ipae", run: list[str] | None = None) -> DataFrame:
    """One row a structure: of rows ranked by a metric, the first known value of each column; in rank order."""
    part = [*(run or []), "structure_idx"]
    order = Window.partitionBy(*part).orderBy(F.asc_nulls_last(by), "sequence_idx")
    span = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = [F.first(c, ignorenulls=True).over(span).alias(c) for c in df.columns if c not in part]
    return df.select(*part, *firsts, F.row_number().over(order).alias("__n")).filter("__n = 1").drop("__n").orderBy(F.asc_nulls_last(by), *part)


def rank_designs(df: DataFrame, has_metrics: bool = True) -> DataFrame:
    """Lowest interface error first, missing last; without metrics by score."""
    return df.orderBy(F.asc_nulls_last("ipae" if has_metrics else "score"), *KEY)


def selection_counts(df: DataFrame) -> DataFrame:
    """Designs and structures, of each run where there is a run_id."""
    return df.groupBy(*keyed(df)[:-2]).agg(F.count("*").alias("designs"), F.count_distinct("structure_idx").alias("structures"))


def lookup_refold(ranked: DataFrame, summaries: DataFrame, n: int, by: str = "ipae") -> DataFrame:
    """Structure files of the n best designs: the first refold record of each, rows without one dropped. Where the tables have
    a run_id, records are those of the design's run. The n keys go to the records, so that only those of the best designs are
    shuffled and ordered; n is a parameter."""
    key = keyed(ranked, summaries)
    top = ranked.orderBy(F.asc_nulls_last(by), *key).limit(max(1, n)).select(*key)
    first = Window.partitionBy(*key).orderBy(F.asc_nulls_last("out_pdb"), "out_cif")
    kept = summaries.join(F.broadcast(top) if n <= BROADCAST_KEYS else top, key)
    path = F.coalesce(filled("out_pdb"), F.regexp_replace(F.col("out_cif"), "\\.[^./]*$", ".pdb"))
    return kept.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(*key, path.alias("path"))


def refold_inputs(designs: DataFrame, specs: DataFrame, mode: str = "auto") -> DataFrame:
    """Per design the chains and ligands to refold. designs: run_id, key, sequence, chain_sequence (of the generated
    target), smiles, ccds; specs: run_id, template_sequence, spec_sequence, spec_smiles, spec_ccds. Explicit ligands win."""
    mode = mode.strip().lower()
    both = designs.join(specs, "run_id", "left")
    target = F.coalesce(filled("template_sequence"), filled("chain_sequence"), filled("spec_sequence")) if mode in ("auto", "protein", "peptide") else F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    pick = lambda own, spec: F.when(F.size(own) > 0, F.col(own)).otherwise(F.coalesce(spec, none)) if mode in ("auto", "ligand") else none
    return both.select("run_id", *KEY, F.array_compact(F.array(F.trim("sequence"), target)).alias("chains"), pick("smiles", "spec_smiles").alias("smiles"), pick("ccds", "spec_ccds").alias("ccds"))


def refold_summary(inputs: DataFrame, status: DataFrame) -> DataFrame:
    """File names, status, alignment flag and ligand counts of each design's refold, by run where the tables have a run_id."""
    stem = F.format_string("s%03d_q%03d", *KEY)
    name = lambda end: F.concat(F.lit("refold_"), stem, F.lit(end))
    key = keyed(inputs, status)
    return inputs.join(status, key, "left").select(
        *key, name(".cif").alias("out_cif"), name(".pdb").alias("out_pdb"), name(".json").alias("out_json"), blank("status").alias("status"),
        F.coalesce("aligned", F.lit(False)).alias("aligned_to_generated"), F.size("smiles").alias("ligand_smiles_count"), F.size("ccds").alias("ligand_ccd_count"),
    )
