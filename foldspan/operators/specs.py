"""Design specifications: flatten nested entities, validate requests and lay out complexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.functions.chains import chain_ids
from foldspan.functions.text import as_list, blank, filled

_AA = "^[A-Za-z*\\-]+$"


def is_explicit_sequence(c: Column) -> Column:
    """Whether text is a plain sequence: letters, * and -, no range such as 140..180; null is false."""
    text = F.trim(c)
    return F.coalesce((text != "") & ~text.contains("..") & text.rlike(_AA), F.lit(False))


def explicit(c: Column) -> Column:
    return F.when(is_explicit_sequence(c), F.trim(c))


def _ligands(entities: Column, field: str) -> Column:
    found = F.filter(F.transform(entities, lambda e: F.trim(e["ligand"][field])), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(found, F.array().cast("array<string>"))


def flatten_spec(specs: DataFrame, include_query_fields: bool = True) -> DataFrame:
    """One row a spec (spec_id, entities): the first protein as target, the second as design, ligand lists.

    A peptide counts only while no protein has been seen. Without include_query_fields all fields are null.
    """
    # proteins in order; a peptide joins only as the first of all
    step = lambda acc, e: F.concat(acc, F.when(e["protein"].isNotNull(), F.array(e["protein"])).when(e["peptide"].isNotNull() & (F.size(acc) == 0), F.array(e["peptide"])).otherwise(F.slice(acc, 1, 0)))
    empty = F.slice(F.transform("entities", lambda e: e["protein"]), 1, 0)
    rows = specs.select("spec_id", "entities", F.coalesce(F.aggregate("entities", empty, step), empty).alias("p"))
    first, second = F.get("p", 0), F.get("p", 1)
    path = lambda b: F.coalesce(filled(b["structure_path"]), filled(b["pdb_path"]))
    fields = {
        "target_chain_id": filled(first["id"]), "target_sequence": explicit(first["sequence"]), "target_pdb_id": filled(first["pdb_id"]), "target_structure_path": path(first),
        "design_chain_id": filled(second["id"]), "design_sequence": explicit(second["sequence"]), "design_pdb_id": filled(second["pdb_id"]), "design_structure_path": path(second),
        "design_group_id": second["group"], "ligand_smiles": _ligands(F.col("entities"), "smiles"), "ligand_ccds": _ligands(F.col("entities"), "ccd"),
    }
    return rows.select("spec_id", *((c if include_query_fields else F.when(F.lit(False), c)).alias(n) for n, c in fields.items()))


def refold_targets(specs: DataFrame) -> DataFrame:
    """All ligands, and the first non-blank chain id, structure path and explicit sequence over protein and peptide blocks."""
    blocks = F.flatten(F.transform("entities", lambda e: F.array_compact(F.array(e["protein"], e["peptide"]))))
    rows = specs.select("spec_id", "entities", blocks.alias("b"))
    first = lambda f: F.get(F.filter(F.transform("b", f), lambda x: x.isNotNull()), 0)
    return rows.select(
        "spec_id", _ligands(F.col("entities"), "smiles").alias("ligand_smiles"), _ligands(F.col("entities"), "ccd").alias("ligand_ccds"),
        first(lambda b: filled(b["id"])).alias("target_chain_id"), first(lambda b: F.coalesce(filled(b["structure_path"]), filled(b["pdb_path"]))).alias("target_structure_path"),
        first(lambda b: explicit(b["sequence"])).alias("target_sequence"),
    )


PATHS = ("target_structure_path", "target_fasta_path", "design_structure_path", "design_fasta_path", "ligand_smiles_path", "design_spec_path")
REQUEST = ("target_pdb_id", "target_sequence", "design_sequence", "ligand_ccd_path", "n_structures", *PATHS)


def validate_requests(requests: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(request_id, ok, errors, warnings). requests: request_id, REQUEST as text, ligand_smiles and ligand_ccds as arrays;
    files: (path) of what exists, None to leave paths unchecked."""
    has = lambda *names: F.coalesce(*(filled(n) for n in names)).isNotNull()
    ligand = (F.coalesce(F.size("ligand_smiles"), F.lit(0)) > 0) | (F.coalesce(F.size("ligand_ccds"), F.lit(0)) > 0) | has("ligand_smiles_path", "ligand_ccd_path")
    target, spec = has("target_structure_path", "target_pdb_id", "target_sequence", "target_fasta_path"), has("design_spec_path")
    count = F.col("n_structures").try_cast("int")
    say = lambda c, text: F.when(c, text if isinstance(text, Column) else F.lit(text))
    bad = lambda n: filled(n).isNotNull() & ~is_explicit_sequence(F.col(n))
    errors = [
        say(~(target | ligand | spec), "missing target: give a ligand, a sequence or a structure"), say(bad("target_sequence"), "target_sequence must be amino-acid letters"),
        say(bad("design_sequence"), "design_sequence must be amino-acid letters"), say(count.isNull(), "n_structures must be an integer of 1 or more"), say(count < 1, "n_structures must be 1 or more"),
    ]
    rows = requests
    if files is not None:
        pairs = requests.select("request_id", F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("name"), filled(n).alias("path")) for k, n in enumerate(PATHS))))).filter("path is not null")
        lost = pairs.join(files.select("path").distinct(), "path", "left_anti").groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("k", "name", "path"))).alias("lost"))
        rows = requests.join(lost, "request_id", "left")
    missing = F.transform("lost", lambda x: F.concat(F.lit("no such path for "), x["name"], F.lit(": "), x["path"])) if files is not None else F.array().cast("array<string>")
    all_errors = F.concat(F.array_compact(F.array(*errors)), F.coalesce(missing, F.array().cast("array<string>")))
    warnings = F.array_compact(F.array(say(~ligand & ~spec, "no ligand given"), say(spec & ~(target | ligand), "the target may be inside the design spec")))
    return rows.select("request_id", (F.size(all_errors) == 0).alias("ok"), all_errors.alias("errors"), warnings.alias("warnings"))


def assert_valid(report: DataFrame) -> DataFrame:
    """report, or ValueError with the messages of up to ten bad requests."""
    bad = report.filter("not ok").select("request_id", "errors").limit(10).collect()
    if bad:
        raise ValueError("\n".join(["invalid design requests:", *(f"- {r['request_id']}: {'; '.join(r['errors'])}" for r in bad)]))
    return report


def _entity(chain: Column, kind: str, source: Column, value: Column) -> Column:
    return F.struct(chain.alias("chain_id"), F.lit(kind).alias("kind"), source.alias("source"), value.alias("value"))


def _laid_out(ligands: Column, ids: Column) -> Column:
    return F.transform(ligands, lambda x, i: F.struct(F.get(ids, i).alias("chain_id"), x["kind"].alias("kind"), F.lit("ligand").alias("source"), x["value"].alias("value")))


def _ligand_list() -> Column:
    listed = lambda c, kind: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    return F.concat(listed(F.col("ligand_smiles"), "smiles"), listed(F.filter("ligand_ccds", lambda c: F.trim(c) != ""), "ccd"))


def query_entities(requests: DataFrame, start: int = 3) -> DataFrame:
    """(request_id, place, chain_id, kind, source, value, error): target chain, design chain, then ligands, smiles before
    ccds, with free ids from position start. A structure beats a sequence; a request without entities has one error row."""
    def part(side: str) -> Column:
        structure, sequence = F.coalesce(filled(f"{side}_structure_path"), filled(f"{side}_pdb_id")), filled(f"{side}_sequence")
        chain = F.coalesce(filled(f"{side}_chain_id"), F.lit("A" if side == "target" else "B"))
        source = F.when(structure.isNotNull(), "structure").otherwise("sequence")
        return F.when(F.coalesce(structure, sequence).isNotNull(), _entity(chain, side, source, F.coalesce(structure, sequence)))

    fixed = F.array_compact(F.array(part("target"), part("design")))
    rows = requests.select("request_id", fixed.alias("fixed"), _ligand_list().alias("ligands"))
    ids = chain_ids(F.size("ligands"), F.transform("fixed", lambda e: e["chain_id"]), start)
    rows = rows.select("request_id", F.concat("fixed", _laid_out(F.col("ligands"), ids)).alias("all"))
    placed = rows.select("request_id", F.posexplode_outer("all").alias("place", "e"))
    return placed.select("request_id", "place", "e.*", F.when(F.col("place").isNull(), "no query entities").alias("error"))


def complex_entities(requests: DataFrame, affinity: bool = False) -> DataFrame:
    """(request_id, chain_ids, values, binder, error): proteins from A on, ligands after them; affinity needs a ligand, and
    its binder is the given chain or the first ligand's."""
    rows = requests.withColumn("ligands", _ligand_list())
    n, m = F.size("sequences"), F.size("ligands")
    ids = chain_ids(n + m)
    binder = F.coalesce(filled("binder_chain"), F.when(m > 0, F.get(ids, n)))
    error = F.when(n == 0, "at least one protein sequence is needed").when(F.lit(affinity) & (m == 0), "affinity needs a ligand")
    return rows.select("request_id", ids.alias("chain_ids"), F.concat("sequences", F.transform("ligands", lambda x: x["value"])).alias("values"), F.when(F.lit(affinity), binder).alias("binder"), error.alias("error"))


def design_request_fields(inputs: DataFrame) -> DataFrame:
    """User inputs as typed fields: blanks as null, chains A and B, 16 structures; with a spec file only that and the count."""
    spec = filled("design_spec_yaml")
    field = lambda c: F.when(spec.isNull(), c)
    text = lambda n: field(filled(n)).alias(n)
    return inputs.select(
        "request_id", F.when(spec.isNotNull(), "spec").otherwise("fields").alias("mode"), F.coalesce(spec, filled("design_spec_path")).alias("design_spec_path"),
        field(F.coalesce(F.col("target_chain_id"), F.lit("A"))).alias("target_chain_id"), text("target_pdb_id"), text("target_sequence"), text("target_structure_path"),
        field(F.coalesce(F.col("design_chain_id"), F.lit("B"))).alias("design_chain_id"), text("design_pdb_id"), text("design_sequence"), text("design_structure_path"),
        field(F.coalesce(F.col("design_group_id").try_cast("int"), F.lit(1))).alias("design_group_id"), field(as_list("ligand_smiles")).alias("ligand_smiles"), field(as_list("ligand_ccds")).alias("ligand_ccds"),
        F.coalesce(F.col("n_structures").try_cast("int"), F.lit(16)).alias("n_structures"),
    )


def spec_text(c: Column | str) -> Column:
    """Spec text, '{}' if blank."""
    return F.coalesce(filled(blank(c)), F.lit("{}"))
