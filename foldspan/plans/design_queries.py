"""Queries of the pocket, structure, design and encoding operators, with their SQL."""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foldspan.operators import designs as T
from foldspan.operators import encodings as E
from foldspan.operators import pocket as P
from foldspan.operators import structures as S
from foldspan.plans.views import duck, view
from foldspan.schemas import ALPHABET, AMINO_ACIDS
from foldspan.sources.scratch import stored

METRICS = ["quantity", "price", "discount", "tax", "size"]
#: Stand-ins for published property scales, which are a parameter: made by a rule that both engines can follow.
SCALES = {a: [round(math.sin((i + 1) * (j + 1)), 2) for j in range(5)] for i, a in enumerate(ALPHABET)}


def _long(s, d):
    wide = P.row_order(view(s, d, "pocket"), "struct_name")
    for m in METRICS:
        wide = wide.withColumn(m, F.round(m, 6))
    return P.melt_metrics(wide, METRICS)


def _tagged(s, d):
    """Means are taken once: summed again in another order they may differ by a digit from those of the quantiles."""
    long = stored(_long(s, d), "long")
    return P.quantile_tag(long, P.metric_quantiles(long))


_Q = "q AS (SELECT metric, quantile_cont(value, 0.33) AS q33, quantile_cont(value, 0.67) AS q67 FROM pocketlong GROUP BY metric)"
_TAG = f"WITH {_Q}, tagged AS (SELECT l.struct_name, l.metric, l.metric_ord, l.value, CASE WHEN l.value IS NULL THEN 'na' WHEN l.value <= q33 THEN 'low' WHEN l.value >= q67 THEN 'high' ELSE 'mid' END AS tag FROM pocketlong l JOIN q USING (metric))"
_ATOM = """SELECT {c} AS structure_id, CASE WHEN vec_id % 2 = 0 THEN 'A' ELSE 'B' END AS chain, CAST(vec_id AS STRING) AS resi,
    CASE vec_id % 4 WHEN 0 THEN 'SER' WHEN 1 THEN 'LYS' WHEN 2 THEN 'LEU' ELSE 'UNK' END AS resn, CASE WHEN vec_id % 6 IN (4, 5) THEN 'OG' ELSE 'CA' END AS atom_name,
    CAST({e1} AS DOUBLE) * 50 AS x, CAST({e2} AS DOUBLE) * 50 AS y, CAST({e3} AS DOUBLE) * 50 AS z, CAST(vec_id % 100 AS DOUBLE) AS b FROM embeddings"""
_ATOMS_DUCK = "atoms AS (" + _ATOM.format(c="label || '_' || (vec_id // 1000)", e1="embedding[1]", e2="embedding[2]", e3="embedding[3]") + ")"


def _atoms(s, d):
    return view(s, d, _ATOM.format(c="label || '_' || (vec_id div 1000)", e1="embedding[0]", e2="embedding[1]", e3="embedding[2]"))


def _near(s, d):
    return S.residues_within(_atoms(s, d), "A", "B", 5.0)


_NEAR = f"WITH {_ATOMS_DUCK}, near AS (SELECT DISTINCT a.structure_id, a.resi FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND a.chain = 'A' AND b.chain = 'B' AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 25), res AS (SELECT DISTINCT a.structure_id, a.resn, a.resi FROM atoms a SEMI JOIN near n ON n.structure_id = a.structure_id AND n.resi = a.resi WHERE a.chain = 'A' AND a.atom_name = 'CA')"
_DIM = "dim(aa, resn, polarity, kd) AS (VALUES " + ", ".join(f"('{a}', '{v[0]}', '{v[1]}', {v[2]}::DOUBLE)" for a, v in AMINO_ACIDS.items()) + ")"


def _pairs(s, d):
    """Each structure against a copy of itself turned by 90 degrees and shifted; the copy's last coordinate is bent a little."""
    atoms = _atoms(s, d).filter("atom_name = 'CA'")
    copy = atoms.select(F.concat("structure_id", F.lit("'")).alias("structure_id"), "chain", "resi", "resn", "atom_name", (-F.col("y") + 3).alias("x"), (F.col("x") - 1).alias("y"), (F.col("z") + F.col("b") % 3).alias("z"), "b")
    pairs = atoms.select("structure_id").distinct().select(F.col("structure_id").alias("pair_id"), F.col("structure_id").alias("target"), F.concat("structure_id", F.lit("'")).alias("reference"))
    return atoms.unionByName(copy), pairs


def _fit_sql() -> str:
    """CTEs that fit every set of matched points (pair_id, part, t*, r*) by quaternions: the greatest root of the
    characteristic polynomial of the 4 x 4 matrix of their covariance, by Newton steps from above, and its vector from
    cofactors. Another way than the operators' singular values."""
    grid = [
        ["sxx + syy + szz", "syz - szy", "szx - sxz", "sxy - syx"], ["syz - szy", "sxx - syy - szz", "sxy + syx", "szx + sxz"],
        ["szx - sxz", "sxy + syx", "syy - sxx - szz", "syz + szy"], ["sxy - syx", "szx + sxz", "syz + szy", "szz - sxx - syy"],
    ]
    sign = lambda p: (-1) ** sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p)))
    product = lambda rows, columns, at: " + ".join(f"({sign(p)}) * " + " * ".join(at(r, columns[k]) for r, k in zip(rows, p, strict=True)) for p in permutations(range(len(columns))))
    own = lambda r, c: f"n{r}{c}"
    less = lambda r, c: f"(n{r}{c} - lam)" if r == c else f"n{r}{c}"
    cofactors = [f"({(-1) ** c}) * ({product((1, 2, 3), [k for k in range(4) if k != c], less)})" for c in range(4)]
    return f"""sums AS (SELECT pair_id, part, count(*) AS n, {", ".join(f"avg({s}{c}) AS m{s}{c}" for s in "tr" for c in "xyz")}, {", ".join(f"sum(t{a} * r{b}) - count(*) * avg(t{a}) * avg(r{b}) AS s{a}{b}" for a in "xyz" for b in "xyz")},
        {" + ".join(f"sum({s}{c} * {s}{c}) - count(*) * avg({s}{c}) * avg({s}{c})" for s in "tr" for c in "xyz")} AS spread FROM points GROUP BY pair_id, part HAVING count(*) >= 3),
    mat AS (SELECT *, {", ".join(f"{grid[r][c]} AS n{r}{c}" for r in range(4) for c in range(4))}, -2 * ({" + ".join(f"s{a}{b} * s{a}{b}" for a in "xyz" for b in "xyz")}) AS c2,
        -8 * (sxx * (syy * szz - syz * szy) - sxy * (syx * szz - syz * szx) + sxz * (syx * szy - syy * szx)) AS c1 FROM sums),
    poly AS (SELECT *, {product(range(4), list(range(4)), own)} AS c0 FROM mat),
    newton AS (SELECT pair_id, part, 0 AS k, spread / 2 AS lam, c2, c1, c0 FROM poly
        UNION ALL SELECT pair_id, part, k + 1, lam - coalesce((((lam * lam + c2) * lam + c1) * lam + c0) / nullif((4 * lam * lam + 2 * c2) * lam + c1, 0), 0), c2, c1, c0 FROM newton WHERE k < 80),
    root AS (SELECT poly.*, newton.lam FROM poly JOIN newton ON newton.pair_id = poly.pair_id AND newton.part = poly.part AND newton.k = 80),
    quat AS (SELECT *, {", ".join(f"{e} AS q{k}" for k, e in enumerate(cofactors))} FROM root),
    fit AS (SELECT pair_id, part, n, sqrt(greatest(0, spread - 2 * lam) / n) AS rmsd, {", ".join(f"m{s}{c}" for s in "tr" for c in "xyz")}, {", ".join(f"q{k} / sqrt(q0 * q0 + q1 * q1 + q2 * q2 + q3 * q3) AS q{k}" for k in range(4))} FROM quat)"""


_TURNED = f"""WITH RECURSIVE {_ATOMS_DUCK}, ca AS (SELECT * FROM atoms WHERE atom_name = 'CA'), every AS (SELECT structure_id AS pair_id, chain, resi, x AS tx, y AS ty, z AS tz, 3 - y AS rx, x - 1 AS ry, z + b % 3 AS rz FROM ca),
    points AS (SELECT *, 'whole' AS part FROM every UNION ALL SELECT *, 'binder' FROM every WHERE chain = 'A'), {{fit}}"""
_TURN = (
    ("q0 * q0 + q1 * q1 - q2 * q2 - q3 * q3", "2 * (q1 * q2 - q0 * q3)", "2 * (q1 * q3 + q0 * q2)"),
    ("2 * (q1 * q2 + q0 * q3)", "q0 * q0 - q1 * q1 + q2 * q2 - q3 * q3", "2 * (q2 * q3 - q0 * q1)"),
    ("2 * (q1 * q3 - q0 * q2)", "2 * (q2 * q3 + q0 * q1)", "q0 * q0 - q1 * q1 - q2 * q2 + q3 * q3"),
)


def _superposed(s, d):
    atoms, pairs = _pairs(s, d)
    return S.superpose(atoms, pairs).select("pair_id", "chain", "resi", *((F.round(c, 3) + 0.0).alias(c) for c in "xyz"))


def _rmsd(s, d):
    atoms, pairs = _pairs(s, d)
    return S.rmsd(atoms, pairs, "A").select("pair_id", F.round("rmsd", 6).alias("rmsd"), F.round("binder_rmsd", 6).alias("binder_rmsd"))


def _ipae(s, d):
    m = view(s, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.transform(F.slice("embedding", i * 6 + 1, 6), lambda x: F.abs(x.cast("double")))).alias("m"))
    return m.select("vec_id", F.round(S.ipae(F.col("m"), (F.col("vec_id") % 8).cast("int")), 9).alias("ipae"))


_FIRST = ", ".join(f"first(d.{c} ORDER BY ipae NULLS LAST, sequence_idx) FILTER (d.{c} IS NOT NULL) AS {c}" for c in ("sequence_idx", "rmsd", "ipae", "binder_rmsd", "binder_plddt", "score"))
_PASS = "rmsd < 2.5 AND ipae < 10 AND binder_rmsd < 1 AND binder_plddt > 80"
_LIM = {"rmsd": 2.5, "ipae": 40.0, "binder_rmsd": 1.2, "binder_plddt": 20.0}
_PASS2 = "rmsd < 2.5 AND ipae < 40 AND binder_rmsd < 1.2 AND binder_plddt > 20"
_COLS = ["structure_idx", "sequence_idx", "rmsd", "ipae", "binder_rmsd", "binder_plddt", "score"]
_SEQ = "SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq, upper(regexp_replace(source || lang, '[^A-Za-z]', '', 'g')) AS base FROM documents"
_SEQS = f"seqs AS ({_SEQ})"
_NAMES = "seqs AS (SELECT p_partkey, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS seq FROM part)"


def _letters(c):
    return F.upper(F.regexp_replace(c, "[^A-Za-z]", ""))


def _seqs(s, d):
    """All letters of each text, and of its source and language as the base."""
    return view(s, d, "documents").select("doc_id", _letters(F.col("text")).alias("seq"), _letters(F.concat("source", "lang")).alias("base"))


def _places(seq: str, offset: str = "0") -> str:
    place = f"CASE WHEN c <> '' AND contains('{ALPHABET}', c) THEN CAST({offset} + 20 * (i - 1) + instr('{ALPHABET}', c) - 1 AS INTEGER) END"
    return f"list_filter(list_transform(string_split({seq}, ''), lambda c, i: {place}), lambda x: x IS NOT NULL)"


_REFOLD = "SELECT structure_idx, sequence_idx, CASE WHEN partkey % 3 = 0 THEN '' ELSE 's' || partkey || '.pdb' END AS out_pdb, 's' || partkey || '.cif' AS out_cif FROM designs WHERE partkey % 5 <> 0"


def _refold_inputs(s, d):
    designs = view(s, d, "SELECT 'r' || CAST(partkey % 4 AS STRING) AS run_id, structure_idx, sequence_idx, ' SEQ ' AS sequence, CASE WHEN partkey % 2 = 0 THEN 'CHAIN' ELSE '' END AS chain_sequence, CASE WHEN partkey % 3 = 0 THEN 'CCO' END AS own FROM designs")
    designs = designs.select("*", F.array_compact(F.array("own")).alias("smiles"), F.array().cast("array<string>").alias("ccds"))
    specs = view(s, d, "SELECT DISTINCT 'r' || CAST(p_partkey % 3 AS STRING) AS run_id, CASE WHEN p_partkey % 3 = 1 THEN 'TEMPLATE' END AS template_sequence, 'SPEC' AS spec_sequence FROM part")
    specs = specs.select("*", F.array(F.lit("CO")).alias("spec_smiles"), F.array(F.lit("HEM")).alias("spec_ccds"))
    return T.refold_inputs(designs, specs)


_INPUTS = """SELECT 'r' || partkey % 4 AS run_id, structure_idx, sequence_idx, CASE WHEN partkey % 4 = 1 THEN ['SEQ', 'TEMPLATE'] WHEN partkey % 2 = 0 THEN ['SEQ', 'CHAIN'] WHEN partkey % 4 < 3 THEN ['SEQ', 'SPEC'] ELSE ['SEQ'] END AS chains,
    CASE WHEN partkey % 3 = 0 THEN ['CCO'] WHEN partkey % 4 < 3 THEN ['CO'] ELSE [] END AS smiles, CASE WHEN partkey % 4 < 3 THEN ['HEM'] ELSE [] END AS ccds FROM designs"""


#: The designs of two runs, which share their keys and differ in all else.
_RUNS = """(SELECT 'a' AS run_id, structure_idx, sequence_idx, partkey, rmsd, ipae, binder_rmsd, binder_plddt, score FROM designs
    UNION ALL SELECT 'b', structure_idx, sequence_idx, partkey + 1, rmsd, ipae + 0.5, binder_rmsd, binder_plddt - 1, score + 1 FROM designs WHERE partkey % 7 <> 0) runs"""
_RUN_REFOLD = f"SELECT run_id, structure_idx, sequence_idx, CASE WHEN partkey % 3 = 0 THEN '' ELSE run_id || partkey || '.pdb' END AS out_pdb, run_id || partkey || '.cif' AS out_cif FROM {_RUNS} WHERE partkey % 5 <> 0"


def _refold_summary(s, d):
    status = view(s, d, "SELECT 'r' || CAST(partkey % 4 AS STRING) AS run_id, structure_idx, sequence_idx, 'done' AS status, TRUE AS aligned FROM designs WHERE partkey % 2 = 0 UNION ALL SELECT 'other', structure_idx, sequence_idx, 'wrong', TRUE FROM designs")
    return T.refold_summary(_refold_inputs(s, d), status)


def _assembled(s, d):
    base = view(s, d, f"SELECT run_id, structure_idx, sequence_idx, partkey AS design_idx, score FROM {_RUNS}")
    return T.assemble_metrics(base, view(s, d, f"SELECT run_id, structure_idx, sequence_idx, rmsd, binder_rmsd FROM {_RUNS} WHERE partkey % 3 <> 0"), view(s, d, f"SELECT run_id, structure_idx, sequence_idx, ipae FROM {_RUNS} WHERE partkey % 4 <> 0"))


def _profile(s, d):
    signatures = P.residue_signature(view(s, d, "alignment"))
    return P.profile(_tagged(s, d), signatures).select("struct_name", "enzyme", "n_metrics", "metric_tags", "signature", "interpretation")


_LISTED = "coalesce(string_agg(metric, ', ' ORDER BY metric_ord) FILTER (tag = '{t}'), 'none')"


def _georgiev_matrix(s, d):
    names = view(s, d, "part").select("p_partkey", _letters(F.col("p_name")).alias("seq"))
    return E.encode(names, "georgiev", scales=SCALES).select("p_partkey", F.col("encoding").cast("array<double>").alias("encoding"))


def _metric_names(s, d):
    wide = P.row_order(view(s, d, "pocket"), "struct_name").withColumns({"note": F.lit("x"), "mixed": F.when(F.col("tax") >= 0, "1.5").otherwise("n/a")})
    names = P.detect_metrics(wide)
    return wide.limit(1).select(F.explode(F.array(*map(F.lit, names))).alias("metric"))


_CANDIDATES = {m: m for m in METRICS} | {"note": "'x'", "mixed": "CASE WHEN tax >= 0 THEN '1.5' ELSE 'n/a' END"}
_DETECTED = "SELECT metric FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS metric, count(TRY_CAST({c} AS DOUBLE)) AS n FROM pocket" for n, c in _CANDIDATES.items()) + ") WHERE n > 0"


def _nearest(s, d):
    return S.min_distances(_atoms(s, d), "A", "B", 2.0)


_NEAREST = f"WITH {_ATOMS_DUCK}, nearest AS (SELECT a.structure_id, a.resi, a.resn, sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS min_dist FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND a.chain = 'A' AND b.chain = 'B' GROUP BY a.structure_id, a.resi, a.resn)"
_DIM5 = "dim(resn, polarity, kd, hw, volume) AS (VALUES " + ", ".join(f"('{v[0]}', '{v[1]}', {v[2]}::DOUBLE, {v[3]}::DOUBLE, {v[4]}::DOUBLE)" for v in AMINO_ACIDS.values()) + ")"
_CENTERED = f"""{_NEAREST}, center AS (SELECT structure_id, avg(x) AS u, avg(y) AS v, avg(z) AS w FROM atoms WHERE chain = 'B' GROUP BY structure_id),
    far AS (SELECT a.structure_id, a.resi, a.resn, a.atom_name, sqrt((x - u) * (x - u) + (y - v) * (y - v) + (z - w) * (z - w)) AS d FROM atoms a JOIN center USING (structure_id) WHERE chain = 'A'),
    spread AS (SELECT structure_id, resi, resn, min(d) AS near_c, avg(d) AS mean_c, avg(d) FILTER (atom_name IN ('N', 'CA', 'C', 'O')) AS back_c FROM far GROUP BY ALL), residues AS (SELECT *, 1 / greatest(min_dist, 1e-6) AS wt FROM nearest JOIN spread USING (structure_id, resi, resn))"""
_WEIGHTED = "sum({e} * wt) / sum(wt)"
_SHELLS = {
    "mean_min_dist_to_centroid": "avg(near_c)", "mean_dist_to_centroid": "avg(mean_c)", "mean_dist_backbone_to_centroid": "avg(back_c)", "mean_volume": "avg(volume)", "weighted_mean_volume": _WEIGHTED.format(e="volume"), "volume_variance": "var_samp(volume)",
    "small_residue_frac": "avg((volume < 90)::INT)", "small_residue_frac_weighted": _WEIGHTED.format(e="(volume < 90)::INT"), "bulky_residue_frac": "avg((volume >= 124)::INT)", "bulky_residue_frac_weighted": _WEIGHTED.format(e="(volume >= 124)::INT"),
    "kd_mean": "avg(kd)", "kd_weighted": _WEIGHTED.format(e="kd"), "hw_mean": "avg(hw)", "hw_weighted": _WEIGHTED.format(e="hw"), "charged_fraction": "avg((polarity IN ('p+', 'p-'))::INT)", "polar_fraction": "avg((polarity <> 'np')::INT)",
}


def _descriptors(s, d):
    return S.pocket_descriptors(S.residue_distances(_atoms(s, d), "A", "B", 2.0))


#: Variants of a base by the factors of a part's key; some sets of mutations have no rows, so that ancestors differ.
_VARIANT = "'B' || CAST(p_partkey {div} 60 AS STRING) || CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN '-' ELSE '' END || {joined}"
_FACTORS = ("CASE WHEN p_partkey % 2 = 0 THEN 'A2C' END", "CASE WHEN p_partkey % 3 = 0 THEN 'F88L' END", "CASE WHEN p_partkey % 5 = 0 THEN 'T158A' END")


def _variants(s, d):
    name = _VARIANT.format(div="div", joined=f"concat_ws('+', {', '.join(_FACTORS)})")
    return P.melt_metrics(view(s, d, f"SELECT {name} || '_x' AS struct_name, p_retailprice AS price, p_size AS size, p_partkey AS ord FROM part"), ["price", "size"])


def _variant_deltas(s, d):
    """Against the nearest ancestor, and for asked pairs: each variant against the last of its base by name."""
    long = _variants(s, d)
    labels = P.variant_labels(long)
    last = labels.groupBy("base").agg(F.max("variant").alias("reference"))
    asked = P.pair_deltas(long, labels.join(last, "base").filter("variant <> reference").select("variant", "reference"))
    found = P.variant_deltas(long).withColumnRenamed("base", "reference")
    rounded = lambda t, kind: t.select(F.lit(kind).alias("kind"), "variant", "reference", "metric", (F.round("delta", 6) + 0.0).alias("delta"))
    return rounded(found, "ancestor").unionByName(rounded(asked, "asked"))


_VARIANT_DELTAS = f"""WITH v AS (SELECT {_VARIANT.format(div="//", joined=f"concat_ws('+', {', '.join(_FACTORS)})")} AS variant, 'B' || (p_partkey // 60) AS base, list_filter([{', '.join(_FACTORS)}], lambda x: x IS NOT NULL) AS muts, p_retailprice, p_size FROM part),
    means AS (SELECT variant, any_value(base) AS base, any_value(muts) AS muts, avg(p_retailprice) AS price, avg(p_size) AS size FROM v GROUP BY variant),
    near AS (SELECT a.variant, first(b.variant ORDER BY len(b.muts) DESC, b.variant) AS reference FROM means a JOIN means b ON a.base = b.base AND len(b.muts) < len(a.muts) AND list_has_all(a.muts, b.muts) GROUP BY a.variant),
    against AS (SELECT variant, max(variant) OVER (PARTITION BY base) AS reference FROM means),
    pairs AS (SELECT 'ancestor' AS kind, * FROM near UNION ALL SELECT 'asked', * FROM against WHERE variant <> reference)
    SELECT kind, p.variant, p.reference, metric, round(CASE metric WHEN 'price' THEN a.price - b.price ELSE a.size - b.size END, 6) + 0.0 AS delta
    FROM pairs p JOIN means a ON a.variant = p.variant JOIN means b ON b.variant = p.reference CROSS JOIN (VALUES ('price'), ('size')) m(metric)"""


def _digest(blocks):
    """Of each block the number of its values and their sum weighted by place, added in their order; blocks have equally many."""
    rest = [c for c in blocks.columns if c != "values"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                values = part.column(len(rest))
                rows = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                sums = np.cumsum(rows * np.arange(1, rows.shape[1] + 1), axis=1)[:, -1]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(rest))), values.value_lengths(), pa.array(sums)], [*rest, "n", "weighted"])

    kinds = ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in rest)
    return blocks.select(*rest, "values").mapInArrow(run, f"{kinds}, n int, weighted double").withColumn("weighted", F.round("weighted", 3))


def _blocks_sql(seq: str, columns: str) -> str:
    """Blocks of 64 positions of the letters of seq in DuckDB."""
    return f"SELECT {columns}, CAST((i - 1) // 64 AS INT) AS block, 320 AS n, round(coalesce(sum(list_sum(list_transform(v, lambda x, j: x::DOUBLE * ((i - 1) % 64 * 5 + j)))), 0), 3) AS weighted FROM (SELECT *, unnest(range(1, length({seq}) + 1)) AS i FROM seqs) LEFT JOIN scale ON aa = {seq}[i] GROUP BY ALL"


_SCALE_SQL = "scale(aa, v) AS (VALUES " + ", ".join(f"('{a}', [{', '.join(f'{x}::FLOAT' for x in v)}])" for a, v in SCALES.items()) + ")"

QUERIES = {
    "P1_require_columns": (lambda s, d: P.melt_metrics(P.row_order(view(s, d, "pocket"), "struct_name"), ["quantity"]).select("struct_name", F.round("value", 6).alias("value")), "SELECT struct_name, round(quantity, 6) AS value FROM pocket"),
    "P2_detect_metrics": (_metric_names, _DETECTED),
    "P3_melt_metrics": (lambda s, d: _long(s, d).drop("ord"), "SELECT struct_name, metric, metric_ord, value FROM pocketlong"),
    "P4_metric_quantiles": (lambda s, d: P.metric_quantiles(_long(s, d)).select("metric", F.round("q33", 6).alias("q33"), F.round("q67", 6).alias("q67")), f"WITH {_Q} SELECT metric, round(q33, 6) AS q33, round(q67, 6) AS q67 FROM q"),
    "P5_quantile_tag": (lambda s, d: _tagged(s, d).select("struct_name", "metric", "tag"), f"{_TAG} SELECT struct_name, metric, tag FROM tagged"),
    "P6_enzyme_key": (lambda s, d: view(s, d, "pocket").select("struct_name", P.enzyme_key(F.col("struct_name")).alias("enzyme")), "SELECT struct_name, split_part(struct_name, '_', 1) AS enzyme FROM pocket"),
    "P7_select_positions": (lambda s, d: P.select_positions(view(s, d, "alignment"), [3, 7, 20]).select("index", "enzyme"), "SELECT index, enzyme FROM alignment WHERE index IN (3, 7, 20)"),
    "P8_residue_signature": (lambda s, d: P.residue_signature(view(s, d, "alignment")), "SELECT enzyme, string_agg(index || ':' || res_aa, '; ' ORDER BY index) AS signature FROM alignment GROUP BY enzyme"),
    "P9_profile": (
        _profile,
        f"{_TAG}, sig AS (SELECT enzyme, string_agg(index || ':' || res_aa, '; ' ORDER BY index) AS signature FROM alignment GROUP BY enzyme) SELECT struct_name, split_part(struct_name, '_', 1) AS enzyme, count(value) AS n_metrics, '{{' || string_agg('\"' || metric || '\":\"' || tag || '\"', ',' ORDER BY metric_ord) || '}}' AS metric_tags, coalesce(any_value(signature), 'n/a') AS signature, 'High: ' || {_LISTED.format(t='high')} || '. Low: ' || {_LISTED.format(t='low')} || '.' AS interpretation FROM tagged LEFT JOIN sig ON sig.enzyme = split_part(struct_name, '_', 1) GROUP BY struct_name".replace("{{", "{").replace("}}", "}"),
    ),
    "P10_metric_extremes": (
        lambda s, d: P.metric_extremes(_long(s, d)),
        "SELECT 'min::' || metric AS pattern, first(struct_name ORDER BY value, struct_name) AS struct_name, min(value) AS value FROM pocketlong GROUP BY metric UNION ALL SELECT 'max::' || metric, first(struct_name ORDER BY value DESC, struct_name), max(value) FROM pocketlong GROUP BY metric",
    ),
    "T1_list_chains": (lambda s, d: S.list_chains(_atoms(s, d)), f"WITH {_ATOMS_DUCK} SELECT DISTINCT structure_id, chain FROM atoms"),
    "T2_resi_sort_key": (
        lambda s, d: view(s, d, "SELECT l_orderkey, l_linenumber, CASE l_partkey % 3 WHEN 0 THEN CAST(l_partkey AS STRING) || 'A' WHEN 1 THEN '-' || CAST(l_partkey AS STRING) ELSE 'x' END AS resi FROM lineitem").withColumn("k", S.resi_sort_key(F.col("resi"))).select("l_orderkey", "l_linenumber", "resi", "k.number", "k.suffix"),
        "SELECT l_orderkey, l_linenumber, resi, CASE WHEN m = 2 THEN NULL ELSE CASE WHEN m = 1 THEN -l_partkey ELSE l_partkey END END AS number, CASE m WHEN 0 THEN 'A' WHEN 1 THEN '' ELSE 'x' END AS suffix FROM (SELECT *, l_partkey % 3 AS m, CASE l_partkey % 3 WHEN 0 THEN l_partkey || 'A' WHEN 1 THEN '-' || l_partkey ELSE 'x' END AS resi FROM lineitem)",
    ),
    "T3_residues_within": (_near, f"{_NEAR} SELECT * FROM res"),
    "T4_classify_residues": (lambda s, d: S.classify_residues(_near(s, d)), f"{_NEAR}, {_DIM} SELECT structure_id, res.resn, resi, aa, polarity FROM res JOIN dim ON dim.resn = res.resn"),
    "T5_superpose": (
        _superposed,
        f"{_TURNED.format(fit=_fit_sql())} SELECT pair_id, chain, resi, "
        + ", ".join(f"round(CASE WHEN n IS NULL THEN t{c} ELSE mr{c} + " + " + ".join(f"({e}) * (t{d} - mt{d})" for e, d in zip(row, "xyz", strict=True)) + f" END, 3) + 0.0 AS {c}" for c, row in zip("xyz", _TURN, strict=True))
        + " FROM every LEFT JOIN (SELECT * FROM fit WHERE part = 'whole') USING (pair_id)",
    ),
    "T6_rmsd": (
        _rmsd,
        f"{_TURNED.format(fit=_fit_sql())} SELECT pair_id, round(coalesce(w.rmsd, b.rmsd), 6) AS rmsd, round(b.rmsd, 6) AS binder_rmsd FROM (SELECT DISTINCT structure_id AS pair_id FROM ca) LEFT JOIN (SELECT * FROM fit WHERE part = 'whole') w USING (pair_id) LEFT JOIN (SELECT * FROM fit WHERE part = 'binder') b USING (pair_id)",
    ),
    "T7_mean_plddt": (lambda s, d: S.mean_plddt(_atoms(s, d), "A").select("structure_id", F.round("plddt", 9).alias("plddt")), f"WITH {_ATOMS_DUCK} SELECT structure_id, round(avg(b), 9) AS plddt FROM atoms WHERE chain = 'A' AND atom_name = 'CA' GROUP BY structure_id"),
    "T8_ipae": (
        _ipae,
        "SELECT vec_id, CASE WHEN l > 0 AND l < 6 THEN round((sum(v) FILTER (i < l AND j >= l) + sum(v) FILTER (i >= l AND j < l)) / (l * (6 - l)) / 2, 9) END AS ipae FROM (SELECT vec_id, vec_id % 8 AS l, k // 6 AS i, k % 6 AS j, abs(embedding[k + 1]::DOUBLE) AS v FROM (SELECT *, unnest(range(36)) AS k FROM embeddings)) GROUP BY vec_id, l",
    ),
    "T9_assemble_metrics": (_assembled, f"SELECT run_id, structure_idx, sequence_idx, partkey AS design_idx, score, CASE WHEN partkey % 3 <> 0 THEN rmsd END AS rmsd, CASE WHEN partkey % 3 <> 0 THEN binder_rmsd END AS binder_rmsd, CASE WHEN partkey % 4 <> 0 THEN ipae END AS ipae FROM {_RUNS}"),
    "T10_number_designs": (
        lambda s, d: T.number_designs(view(s, d, "SELECT partkey div 50 AS run, structure_idx, sequence_idx FROM designs"), ["run"]),
        "SELECT partkey // 50 AS run, structure_idx, sequence_idx, CAST(row_number() OVER (PARTITION BY partkey // 50 ORDER BY structure_idx, sequence_idx) - 1 AS INT) AS design_idx FROM designs",
    ),
    "T11_mean_score": (
        lambda s, d: view(s, d, "embeddings").select("vec_id", F.round(T.mean_score(F.slice(F.transform("embedding", lambda x: x.cast("double")), F.lit(1), (F.col("vec_id") % 5).cast("int"))), 9).alias("score")),
        "SELECT vec_id, round(list_sum(list_transform(embedding[1:vec_id % 5], lambda x: x::DOUBLE)) / nullif(vec_id % 5, 0), 9) AS score FROM embeddings",
    ),
    "T12_binder_suffix": (lambda s, d: view(s, d, "part").select("p_partkey", T.binder_suffix(F.col("p_name"), F.col("p_size") % 6).alias("binder")), "SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN p_name ELSE right(p_name, p_size % 6) END AS binder FROM part"),
    "T13_filter_designs": (lambda s, d: T.filter_designs(view(s, d, "designs")).select(*_COLS), f"SELECT {', '.join(_COLS)} FROM designs WHERE {_PASS}"),
    "T14_select_best_per_structure": (lambda s, d: T.select_best_per_structure(T.filter_designs(view(s, d, "designs").select(*_COLS), _LIM)), f"SELECT structure_idx, {_FIRST} FROM designs d WHERE {_PASS2} GROUP BY structure_idx"),
    "T15_rank_designs": (lambda s, d: T.rank_designs(view(s, d, "designs").select(*_COLS)), f"SELECT {', '.join(_COLS)} FROM designs"),
    "T16_selection_counts": (lambda s, d: T.selection_counts(T.filter_designs(view(s, d, f"SELECT * FROM {_RUNS}"), _LIM)), f"SELECT run_id, count(*) AS designs, count(DISTINCT structure_idx) AS structures FROM {_RUNS} WHERE {_PASS2} GROUP BY run_id"),
    "T17_lookup_refold": (
        lambda s, d: T.lookup_refold(view(s, d, f"SELECT * FROM {_RUNS}"), view(s, d, _RUN_REFOLD), 50),
        f"WITH top AS (SELECT run_id, structure_idx, sequence_idx FROM {_RUNS} ORDER BY ipae NULLS LAST, run_id, structure_idx, sequence_idx LIMIT 50), ref AS ({_RUN_REFOLD}) SELECT run_id, structure_idx, sequence_idx, CASE WHEN out_pdb <> '' THEN out_pdb ELSE replace(out_cif, '.cif', '.pdb') END AS path FROM top JOIN ref USING (run_id, structure_idx, sequence_idx)",
    ),
    "T18_refold_inputs": (_refold_inputs, _INPUTS),
    "T19_refold_summary": (
        _refold_summary,
        f"WITH inp AS ({_INPUTS}) SELECT i.run_id, i.structure_idx, i.sequence_idx, 'refold_' || stem || '.cif' AS out_cif, 'refold_' || stem || '.pdb' AS out_pdb, 'refold_' || stem || '.json' AS out_json, CASE WHEN partkey % 2 = 0 THEN 'done' ELSE '' END AS status, partkey % 2 = 0 AS aligned_to_generated, CAST(len(smiles) AS INT) AS ligand_smiles_count, CAST(len(ccds) AS INT) AS ligand_ccd_count FROM (SELECT *, printf('s%03d_q%03d', structure_idx, sequence_idx) AS stem FROM inp) i JOIN designs d ON d.structure_idx = i.structure_idx AND d.sequence_idx = i.sequence_idx",
    ),
    "E1_max_length": (lambda s, d: _seqs(s, d).agg(F.max(F.length("seq")).alias("n")).select(F.lit(E.max_length(_seqs(s, d))).alias("n")), f"WITH {_SEQS} SELECT CAST(max(length(seq)) AS INT) AS n FROM seqs"),
    "E2_one_hot": (
        lambda s, d: E.encode(_seqs(s, d), "one_hot").select("doc_id", "encoding.size", "encoding.indices"),
        f"WITH {_SEQS} SELECT doc_id, CAST((SELECT max(length(seq)) FROM seqs) * 20 AS INT) AS size, {_places('seq')} AS indices FROM seqs",
    ),
    "E3_georgiev": (lambda s, d: _digest(E.scaled_blocks(_seqs(s, d), "doc_id", SCALES)), f"WITH {_SEQS}, {_SCALE_SQL} {_blocks_sql('seq', 'doc_id')}"),
    "E3_georgiev_whole": (
        _georgiev_matrix,
        f"WITH {_NAMES}, {_SCALE_SQL}, m AS (SELECT max(length(seq)) AS n FROM seqs), cells AS (SELECT p_partkey, i, coalesce(v, [0::FLOAT, 0::FLOAT, 0::FLOAT, 0::FLOAT, 0::FLOAT]) AS v FROM (SELECT p_partkey, seq, unnest(range(1, n + 1)) AS i FROM seqs, m) LEFT JOIN scale ON aa = seq[i]) SELECT p_partkey, list_transform(flatten(list(v ORDER BY i)), lambda x: x::DOUBLE) AS encoding FROM cells GROUP BY p_partkey",
    ),
    "E4_encode": (lambda s, d: E.encode(_seqs(s, d), "one_hot", n=10).select("doc_id", "encoding.indices"), f"WITH {_SEQS}, cut AS (SELECT doc_id, substring(seq, 1, 10) AS seq FROM seqs) SELECT doc_id, {_places('seq')} AS indices FROM cut"),
    "E5_feature_matrix": (
        lambda s, d: E.feature_matrix(_seqs(s, d), base="base").select("doc_id", "features.size", "features.indices"),
        f"WITH {_SEQS}, m AS (SELECT max(length(seq)) AS n, max(length(base)) AS b FROM seqs) SELECT doc_id, CAST((n + b) * 20 AS INT) AS size, list_concat({_places('base')}, {_places('seq', '20 * b')}) AS indices FROM seqs, m",
    ),
    "E5_scaled_features": (
        lambda s, d: _digest(E.block_matrix(_seqs(s, d), "doc_id", SCALES, base="base")),
        f"WITH {_SEQS}, {_SCALE_SQL} SELECT 'mutant' AS side, * FROM ({_blocks_sql('seq', 'doc_id')}) UNION ALL SELECT 'base', * FROM ({_blocks_sql('base', 'doc_id')})",
    ),
    "X1_conservation": (
        lambda s, d: S.conservation(view(s, d, "alignment")).select("index", F.round("entropy", 9).alias("entropy"), F.round("gap_fraction", 9).alias("gap_fraction")),
        "WITH c AS (SELECT index, res_aa AS aa, count(*) AS n FROM alignment GROUP BY ALL), t AS (SELECT index, sum(n) AS a, coalesce(sum(n) FILTER (aa <> '-'), 0) AS k FROM c GROUP BY index) SELECT index, round(abs(coalesce(sum(-(n / k) * log2(n / k)) FILTER (aa <> '-'), 0)), 9) AS entropy, round(max((a - k) / a), 9) AS gap_fraction FROM c JOIN t USING (index) GROUP BY index",
    ),
    "X2_min_distances": (lambda s, d: _nearest(s, d).withColumn("min_dist", F.round("min_dist", 6)), f"{_NEAREST} SELECT structure_id, resi, resn, round(min_dist, 6) AS min_dist FROM nearest"),
    "X2_pocket_descriptors": (
        lambda s, d: _descriptors(s, d).select("structure_id", "shell", "n", *((F.round(c, 6) + 0.0).alias(c) for c in _SHELLS)),
        f"{_CENTERED}, {_DIM5} SELECT structure_id, CASE WHEN min_dist < 6 THEN 'proximal' ELSE 'distal' END AS shell, count(*) AS n, {', '.join(f'round({e}, 6) + 0.0 AS {n}' for n, e in _SHELLS.items())} FROM residues JOIN dim USING (resn) GROUP BY structure_id, shell",
    ),
    "X2_pocket_extremes": (
        lambda s, d: P.metric_extremes(P.melt_metrics(P.row_order(S.pocket_table(_descriptors(s, d)), "struct_name"), ["num_pocket_res<6", "kd_weighted (distal)", "mean_dist_to_centroid (distal)"]).withColumn("value", F.round("value", 6) + 0.0)),
        f"""{_CENTERED}, {_DIM5}, shells AS (SELECT *, CASE WHEN min_dist < 6 THEN 'proximal' ELSE 'distal' END AS shell FROM residues JOIN dim USING (resn)),
            wide AS (SELECT structure_id, count(*) FILTER (shell = 'proximal')::DOUBLE AS a, round(sum(kd * wt) FILTER (shell = 'distal') / sum(wt) FILTER (shell = 'distal'), 6) + 0.0 AS b, round(avg(mean_c) FILTER (shell = 'distal'), 6) + 0.0 AS c FROM shells GROUP BY structure_id),
            long AS (SELECT structure_id, 'num_pocket_res<6' AS metric, a AS value FROM wide UNION ALL SELECT structure_id, 'kd_weighted (distal)', b FROM wide UNION ALL SELECT structure_id, 'mean_dist_to_centroid (distal)', c FROM wide)
            SELECT 'min::' || metric AS pattern, first(structure_id ORDER BY value, structure_id) AS struct_name, min(value) AS value FROM long WHERE value IS NOT NULL GROUP BY metric UNION ALL SELECT 'max::' || metric, first(structure_id ORDER BY value DESC, structure_id), max(value) FROM long WHERE value IS NOT NULL GROUP BY metric""",
    ),
    "X4_variant_deltas": (_variant_deltas, _VARIANT_DELTAS),
    "X3_composition": (
        lambda s, d: E.composition(_seqs(s, d), "doc_id").select("doc_id", "residues", *(F.round(c, 9).alias(c) for c in ("kd_mean", "nonpolar", "neutral", "basic", "acidic"))),
        f"WITH {_SEQS}, {_DIM} SELECT doc_id, count(*) AS residues, round(avg(kd), 9) AS kd_mean, round(avg((polarity = 'np')::INT), 9) AS nonpolar, round(avg((polarity = 'p~')::INT), 9) AS neutral, round(avg((polarity = 'p+')::INT), 9) AS basic, round(avg((polarity = 'p-')::INT), 9) AS acidic FROM (SELECT doc_id, unnest(string_split(seq, '')) AS aa FROM seqs) JOIN dim USING (aa) GROUP BY doc_id",
    ),
    "X5_pocket_assays": (
        lambda s, d: P.pocket_assays(_long(s, d), view(s, d, "SELECT p_brand AS enzyme, 'price' AS assay, max(p_retailprice) AS value FROM part WHERE p_size > 40 GROUP BY p_brand")).select("struct_name", "metric", "value", "assay", "activity"),
        "SELECT struct_name, metric, l.value, assay, a.value AS activity FROM pocketlong l LEFT JOIN (SELECT p_brand AS enzyme, 'price' AS assay, max(p_retailprice) AS value FROM part WHERE p_size > 40 GROUP BY p_brand) a ON a.enzyme = split_part(struct_name, '_', 1)",
    ),
}


def queries():
    return {n: q for n, (q, _) in QUERIES.items()}


def oracle_sql():
    return {n: duck(sql) for n, (_, sql) in QUERIES.items() if sql}


__all__ = ["METRICS", "QUERIES", "SCALES", "oracle_sql", "queries"]
