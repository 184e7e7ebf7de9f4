"""Files, sinks and record operators against row-by-row versions."""

import json
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foldspan import plans
from foldspan.operators import designs, encodings, pocket, ranks, specs, structures
from foldspan.sources import files, sinks, spec_yaml
from oracle import connect, same

SPEC = """# a design
entities:
  - protein:
      id: A
      sequence: 140..180   # a range
  - ligand: {id: B, smiles: "C1#N(C)", ccd: ~}
  - peptide:
      id: 'it''s'
      sequence: >-free
      group: 3
"""


def test_yaml_values():
    text = SPEC.replace("      sequence: >-free\n", "")
    want = {"entities": [{"protein": {"id": "A", "sequence": "140..180"}}, {"ligand": {"id": "B", "smiles": "C1#N(C)", "ccd": None}}, {"peptide": {"id": "it's", "group": 3}}]}
    assert spec_yaml.load(text) == want and spec_yaml.load(text.replace("\n", "\r\n")) == want
    assert spec_yaml.load("a: [1, 2.5,\n  'x, y', {b: c}]\nd:\n- - 1\n  - two words\n- e: 1\n  f:\n    - g\n") == {"a": [1, 2.5, "x, y", {"b": "c"}], "d": [[1, "two words"], {"e": 1, "f": ["g"]}]}
    assert spec_yaml.load("url: http://a.b/c#d\nesc: \"\\u00e9\\n\"\ntrue: false") == {"url": "http://a.b/c#d", "esc": "é\n", True: False}
    assert spec_yaml.load("") is None and spec_yaml.load("# only\n---\n") is None and spec_yaml.load("- 1") == [1]
    for bad in (SPEC, "a: &x 1", "a: [1, 2", "a: 1\n  b: 2", "- a\nb: 1", "a: 'x", "a: 1\na: 2", "a: {b: 1} c", "\ta: 1", "a:\n  - 1\n b: 2"):
        with pytest.raises(ValueError):
            spec_yaml.load(bad)


def test_specs_from_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text('entities:\n  - protein:\n      id: A\n      sequence: 140..180\n  - ligand:\n      id: B\n      smiles: "C1CNC[C@@H]1O"')
    (tmp_path / "b.json").write_text('{"entities": [{"protein": {"id": "A", "sequence": "ACD"}}]}')
    (tmp_path / "c.yaml").write_text("entities: [")
    (tmp_path / "d.json").write_text('{"entities": [')
    (tmp_path / "e.yaml").write_text("")
    got = {r["spec_id"].rsplit("/", 1)[1]: r for r in files.read_design_specs(spark, str(tmp_path)).collect()}
    assert got["a.yaml"]["entities"][0]["protein"]["sequence"] == "140..180" and got["a.yaml"]["entities"][1]["ligand"]["smiles"] == "C1CNC[C@@H]1O"
    assert [bool(got[x]["problem"]) for x in ("a.yaml", "b.json", "c.yaml", "d.json")] == [False, False, True, True]
    flat = {r["spec_id"].rsplit("/", 1)[1]: r for r in specs.flatten_spec(files.read_design_specs(spark, str(tmp_path)).filter("problem is null")).collect()}
    assert (flat["a.yaml"]["target_chain_id"], flat["a.yaml"]["target_sequence"], flat["b.json"]["target_sequence"]) == ("A", None, "ACD")
    with pytest.raises(Exception, match="must be a mapping"):
        files.checked_design_specs(spark.createDataFrame([("x", "- 1")], "file string, text string")).collect()


def test_fasta_split_over_tasks(spark, tmp_path):
    rng = random.Random(1)
    text = "".join(rng.choice([">", " >"]) * (k > 0) + f"r{k} note\n" + "\n".join("".join(rng.choice("ACDE") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5))) + "\n\n" for k in range(400))
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.fasta").write_text("AC\nDE\n>" + text)
    (tmp_path / "f/b.fasta").write_text(" >x y\r\nAC\r\n\r\nDE\r\n>z\r\nK")
    whole = files.parse_fasta(files.whole_files(spark, str(tmp_path / "f")))
    want = {f: [(r["seq_id"], r["sequence"]) for r in sorted(whole.collect(), key=lambda r: r["rec_no"]) if r["file"].endswith(f)] for f in ("a.fasta", "b.fasta")}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        cut = files.read_fasta(spark, str(tmp_path / "f"))
        assert files.in_files(spark, str(tmp_path / "f"), "\n>").rdd.getNumPartitions() > 3
        got = {f: [(r["seq_id"], r["sequence"]) for r in sorted(cut.collect(), key=lambda r: r["rec_no"]) if r["file"].endswith(f)] for f in want}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want and want["b.fasta"] == [("x", "ACDE"), ("z", "K")] and want["a.fasta"][0] == ("", "ACDE") and len(want["a.fasta"]) > 200


def test_threads_and_their_quarantine(spark, tmp_path):
    for name, text in {"a": json.dumps({"thread_id": "1", "messages": []}), "b": "{ not", "c": json.dumps({"thread_id": " ", "messages": []}), "d": json.dumps({"thread_id": "4"})}.items():
        (tmp_path / f"{name}.json").write_text(text)
    checked = files.checked_threads(spark, str(tmp_path))
    assert [r["thread_id"] for r in files.good_threads(checked).collect()] == ["1"]
    assert {r["file"][-6:]: r["reason"] for r in files.quarantined(checked).collect()} == {"b.json": "malformed JSON", "c.json": "no thread_id", "d.json": "no messages"}


def test_models_and_locations(spark, tmp_path):
    atom = lambda name, alt, x, weight: f"ATOM      1  {name:<3}{alt}SER A  10    {x:8.3f}{0:8.3f}{0:8.3f}{weight:6.2f}{50:6.2f}           C"
    lines = ["HEADER", "MODEL        1", atom("CA", " ", 1, 1), atom("OG", "A", 2, 0.4), atom("OG", "B", 3, 0.6), "ENDMDL", "MODEL        2", atom("CA", " ", 9, 1), "ENDMDL"]
    (tmp_path / "two.pdb").write_text("\n".join(lines))
    got = files.read_structures(spark, str(tmp_path / "two.pdb")).collect()
    assert sorted((r["model"], r["atom_name"], r["x"]) for r in got) == [(1, "CA", 1.0), (1, "OG", 3.0)]
    every = files.parse_pdb(spark.createDataFrame([("s", k, x) for k, x in enumerate(lines)], "structure_id string, line int, value string"))
    assert [r["model"] for r in every.collect()] == [1, 1, 1, 2]


def test_a_stage_is_reused_only_for_what_it_was_built_from(spark, tmp_path):
    one, two = spark.range(5), spark.range(6)
    run = lambda df, config: sinks.stage(spark, str(tmp_path / "s"), {"in": df}, config, lambda: df.filter(f"id < {config['n']}"))
    assert [run(one, {"n": 3})[1], run(one.repartition(3), {"n": 3})[1], run(one, {"n": 2})[1], run(two, {"n": 3})[1], run(one, {"n": 3})[1]] == [False, True, False, False, True]
    assert run(one, {"n": 2})[0].count() == 2


def test_a_stream_that_starts_again_adds_nothing_twice(spark, tmp_path):
    spark.range(4).selectExpr("cast(id as string) AS message_id").repartition(2).write.parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = spark.readStream.schema("message_id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(sinks.message_sink(str(tmp_path / "m"), "chat")).option("checkpointLocation", str(tmp_path / f"state{k}")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["message_id"] for r in sinks.read_messages(spark, str(tmp_path / "m")).collect()) == ["0", "1", "2", "3"]


def test_tables_are_written_and_watched_in_one_pass(spark, tmp_path):
    df = spark.range(1000).selectExpr("id AS project_id", "nullif(id % 10, 3) AS x")
    said = sinks.write_tables({"t": df}, str(tmp_path / "o"))
    row = said.first()
    assert (row["rows"], row["nulls"]["x"], row["low"], row["high"]) == (1000, 100, "0", "999")
    assert len(list((tmp_path / "o/t").glob("bucket=*"))) <= sinks.BUCKETS and spark.read.parquet(str(tmp_path / "o/t")).count() == 1000


def test_places_of_frequent_values(spark, tmp_path):
    rows = [("a", 1.0)] * 3000 + [("a", float(k)) for k in range(500)] + [("b", 2.0)]
    spark.createDataFrame(rows, "g string, v double").repartition(7).write.parquet(str(tmp_path / "p"))
    got = ranks.placed(spark.read.parquet(str(tmp_path / "p")), ["g"], ["v"]).collect()
    a = sorted((r["pos"], r["v"]) for r in got if r["g"] == "a")
    assert [p for p, _ in a] == list(range(3500)) and [v for _, v in a] == sorted(v for g, v in rows if g == "a") and {r["total"] for r in got} == {3500, 1}


@pytest.mark.parametrize("values", [[], [None], [1.0], [1.0, 2.0], [float(k * k % 97) for k in range(301)], [5.0] * 50])
def test_quantiles(spark, values):
    df = spark.createDataFrame([("m", v) for v in values] + [("n", None)], "metric string, value double")
    got = {r["metric"]: (r["q33"], r["q67"]) for r in pocket.metric_quantiles(df).collect()}
    known = sorted(v for v in values if v is not None)

    def quantile(q):
        at = q * (len(known) - 1)
        k = math.floor(at)
        return known[k] + (at - k) * (known[min(k + 1, len(known) - 1)] - known[k])

    assert got["n"] == (None, None)
    if known:
        assert all(math.isclose(x, quantile(q), abs_tol=1e-9) for x, q in zip(got["m"], (0.33, 0.67), strict=True))
    plan = pocket.metric_quantiles(df)._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_equal_values_at_the_bounds_keep_their_tags(spark):
    rows = [(f"s{k}", k, f"m{n}", n, v) for n, v in enumerate([25.344331, 26.290119, 25.343757, 58.925136, 51.664701, 15.339984]) for k in range(9)]
    long = spark.createDataFrame(rows, "struct_name string, ord int, metric string, metric_ord int, value double")
    quantiles = pocket.metric_quantiles(long)
    assert all(r["q33"] == r["q67"] == rows[9 * int(r["metric"][1:])][4] for r in quantiles.collect())
    assert {r["tag"] for r in pocket.quantile_tag(long, quantiles).collect()} == {"low"}


def test_nearest_atoms_without_a_radius(spark):
    rng = random.Random(2)
    atoms = [(s, c, str(k // 3), "SER", "CA", *(rng.gauss(0, w) for _ in range(3))) for s, w in (("near", 3.0), ("wide", 400.0)) for c in "AB" for k in range(60 if c == "A" else 5)]
    atoms += [("lone", "A", "1", "SER", "CA", 0.0, 0.0, 0.0), ("far", "A", "1", "SER", "CA", 0.0, 0.0, 0.0), ("far", "B", "1", "LIG", "C", 1e4, 0.0, 0.0), ("bad", "A", "1", "SER", "CA", None, 0.0, 0.0), ("bad", "B", "1", "SER", "CA", 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(atoms, "structure_id string, chain string, resi string, resn string, atom_name string, x double, y double, z double")
    got = {(r["structure_id"], r["resi"]): r["min_dist"] for r in structures.min_distances(df, "A", "B", 1.0).collect()}
    want = {}
    for a in atoms:
        for b in atoms:
            if a[0] == b[0] and (a[1], b[1]) == ("A", "B") and a[5] is not None:
                want[a[0], a[2]] = min(want.get((a[0], a[2]), math.inf), math.dist(a[5:], b[5:]))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want) and ("far", "1") in got
    assert structures.min_distances(df.filter("structure_id = 'lone'"), "A", "B").count() == 0


def test_ancestors_of_combined_mutations(spark):
    names = ["Cv", "Cv-F88L", "Cv-T158A", "Cv-T158A+F88L", "Cv-A1C+F88L+T158A", "Dx-A1C+B2D", "Dx-A1C", "Ey-A1C"]
    long = spark.createDataFrame([(f"{n}_s", "m", float(k)) for k, n in enumerate(names)], "struct_name string, metric string, value double")
    got = {r["variant"]: (r["base"], r["delta"]) for r in pocket.variant_deltas(long).collect()}
    assert got == {"Cv-F88L": ("Cv", 1.0), "Cv-T158A": ("Cv", 2.0), "Cv-T158A+F88L": ("Cv-F88L", 2.0), "Cv-A1C+F88L+T158A": ("Cv-T158A+F88L", 1.0), "Dx-A1C+B2D": ("Dx-A1C", -1.0)}
    asked = spark.createDataFrame([("Cv-F88L", "Dx-A1C"), ("Cv", "none")], "variant string, reference string")
    assert [(r["variant"], r["reference"], r["delta"]) for r in pocket.pair_deltas(long, asked).collect()] == [("Cv-F88L", "Dx-A1C", -5.0)]


def test_scales_from_a_file_in_blocks(spark, tmp_path):
    (tmp_path / "scales.csv").write_text("aa,s1,s2\nA,0.57,3.37\nC,2.66,-1.52\nD,-2.46,-0.66\n")
    scales = encodings.read_scales(spark, str(tmp_path / "scales.csv"))
    df = spark.createDataFrame([(1, "acXD"), (2, ""), (3, "A" * 130)], "k int, seq string")
    got = {(r["k"], r["block"]): r["values"] for r in encodings.scaled_blocks(df, "k", scales, width=64).collect()}
    assert sorted(got) == [(1, 0), (3, 0), (3, 1), (3, 2)] and all(len(v) == 128 for v in got.values())
    first = [round(x, 2) for x in got[1, 0][:10]]
    assert first == [0.57, 3.37, 2.66, -1.52, 0.0, 0.0, -2.46, -0.66, 0.0, 0.0]
    whole = encodings.encode(df, "georgiev", scales=scales, n=192).filter("k = 3").first()["encoding"]
    assert whole == [x for b in range(3) for x in got[3, b]]
    (tmp_path / "bad.csv").write_text("aa,s1\nAB,0.5\n")
    with pytest.raises(ValueError, match="residue letter"):
        encodings.read_scales(spark, str(tmp_path / "bad.csv"))


def test_runs_do_not_mix(spark):
    a = spark.createDataFrame([("r", 0, 0, 1.0), ("q", 0, 0, 2.0)], "run_id string, structure_idx int, sequence_idx int, rmsd double")
    b = spark.createDataFrame([("r", 0, 0, 5.0), ("q", 0, 0, 6.0)], "run_id string, structure_idx int, sequence_idx int, ipae double")
    assert sorted((r["run_id"], r["rmsd"], r["ipae"]) for r in designs.assemble_metrics(a, b).collect()) == [("q", 2.0, 6.0), ("r", 1.0, 5.0)]
    with pytest.raises(ValueError, match="run_id"):
        designs.assemble_metrics(a, b.drop("run_id"))


def test_one_matching_join_for_both_errors(spark):
    atoms = spark.createDataFrame([("t", "A", "1", "CA", 0.0, 0.0, 0.0)], "structure_id string, chain string, resi string, atom_name string, x double, y double, z double")
    pairs = spark.createDataFrame([("p", "t", "t")], "pair_id string, target string, reference string")
    plan = structures.rmsd(atoms, pairs, "A")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join") == 3 and plan.first()["rmsd"] is None


def test_cif_by_lines(spark, tmp_path):
    text = """data_x
#
loop_
_entity.id
_entity.name
1 'ATOM of a kind'
#
loop_
_atom_site.group_PDB
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.pdbx_PDB_model_num
ATOM CA . SER A 10 1.0 2.0 3.0 1.00 1
ATOM "O5'" A LIG B 1 4.0 5.0 ? 0.30 1
ATOM "O5'" B LIG B 1 5.0 5.0 6.0 0.70 1
ATOM CA . SER A 10 9.0 9.0 9.0 1.00 2
loop_
_other.id
ATOM
"""
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.cif").write_text(text)
    (tmp_path / "c/b.cif").write_text(text.replace("\n", "\r\n"))
    (tmp_path / "c/none.cif").write_text("data_y\n#\n")
    rows = files.read_cif(spark, str(tmp_path / "c")).collect()
    want = [(1, "A", "10", "SER", "CA", 1.0, 3.0), (1, "B", "1", "LIG", "O5'", 5.0, 6.0)]
    for name in ("a.cif", "b.cif"):
        assert sorted((r["model"], r["chain"], r["resi"], r["resn"], r["atom_name"], r["x"], r["z"]) for r in rows if r["structure_id"].endswith(name)) == want
    assert len(rows) == 4


def test_wide_pocket_table(spark):
    atoms = [("s", "A", "1", "GLY", "CA", 0.0, 0.0, 0.0), ("s", "A", "1", "GLY", "CB", 0.0, 2.0, 0.0), ("s", "A", "2", "TRP", "CA", 20.0, 0.0, 0.0), ("s", "B", "1", "LIG", "C", 4.0, 0.0, 0.0), ("s", "B", "1", "LIG", "N", 6.0, 0.0, 0.0)]
    df = spark.createDataFrame(atoms, "structure_id string, chain string, resi string, resn string, atom_name string, x double, y double, z double")
    got = {r["resi"]: r for r in structures.residue_distances(df, "A", "B").collect()}
    assert math.isclose(got["1"]["min_dist"], 4) and math.isclose(got["1"]["min_dist_to_centroid"], 5) and math.isclose(got["1"]["dist_to_centroid"], (5 + math.sqrt(29)) / 2) and math.isclose(got["1"]["dist_backbone_to_centroid"], 5)
    wide = structures.pocket_table(structures.pocket_descriptors(structures.residue_distances(df, "A", "B"))).first()
    assert (wide["struct_name"], wide["num_pocket_res_ali"], wide["num_pocket_res<6"]) == ("s", 2, 1)
    assert wide["mean_volume (proximal)"] == 48.0 and wide["mean_volume (distal)"] == 163.0 and math.isclose(wide["mean_dist_to_centroid (distal)"], 15)
    assert pocket.detect_metrics(structures.pocket_table(structures.pocket_descriptors(structures.residue_distances(df, "A", "B"))))[:2] == ["num_pocket_res_ali", "num_pocket_res<6"]


def test_vectors_beyond_four_digits_in_structure_files(spark, tmp_path):
    rows = [(k, [x, 0.25, -0.5] + [0.0] * 33, 1) for k, x in ((7, 0.5), (12345, 0.125), (12346, -0.000001), (22345, 0.75))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = connect(str(tmp_path))
    for name in ("S6_read_structures", "S7_cif_to_atoms"):
        same(db, plans.queries()[name](spark, str(tmp_path)), plans.oracle_sql()[name])


def test_records_are_picked_before_they_are_ordered(spark):
    ranked = spark.createDataFrame([(k, 0, float(k)) for k in range(9)], "structure_idx int, sequence_idx int, ipae double")
    records = spark.createDataFrame([(k, 0, f"{c}.pdb", "x.cif") for k in range(9) for c in "ba"], "structure_idx int, sequence_idx int, out_pdb string, out_cif string")
    found = designs.lookup_refold(ranked, records, 2)
    assert {(r["structure_idx"], r["path"]) for r in found.collect()} == {(0, "a.pdb"), (1, "a.pdb")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("BroadcastHashJoin")


def test_blocks_are_read_once_from_a_long_sequence(spark):
    seq = "".join(random.Random(3).choices("ACDEXyé", k=64 * 1024 + 70))
    scales = {"A": [0.5, 1.0], "C": [2.0, -1.0], "Y": [3.0, 0.25]}
    df = spark.createDataFrame([("k", seq), ("short", "ac"), ("none", "")], "id string, seq string")
    blocks = encodings.scaled_blocks(df, "id", scales)
    got = {(r["id"], r["block"]): r["values"] for r in blocks.collect()}
    assert len(got) == 1024 + 2 + 1 and all(len(v) == 128 for v in got.values())
    assert [v for k in range(1026) for v in got["k", k]][: 2 * len(seq)] == [v for c in seq.upper() for v in scales.get(c, [0.0, 0.0])]
    assert got["short", 0][:6] == [0.5, 1.0, 2.0, -1.0, 0.0, 0.0]
    assert "Generate" not in blocks._jdf.queryExecution().executedPlan().toString()


def test_packed_threads_equal_single_files(spark, tmp_path):
    texts = {
        "a.json": json.dumps({"thread_id": "1", "updated_at": "2024", "messages": [{"role": "user", "content": "h\ni", "metadata": {"f": ["/x.md"]}}]}, separators=(",", ":")).replace(',"messages', ',\n "messages'), "b.json": "{ not json", "c.json": '{"thread_id": " ", "messages": []}',
        "d.json": '{"thread_id": "4"}', "e.json": '{"thread_id": "5", "messages": [{"role": "user", "content": "cut', "f.json": '{"thread_id": 6, "messages": [{"role": "é\u2028", "ts": 3}]}', "h.json": "\n ", "i.json": "",
    }
    (tmp_path / "one").mkdir()
    for name, text in texts.items():
        (tmp_path / "one" / name).write_text(text)
    single = files.checked_threads(spark, str(tmp_path / "one")).withColumn("file", F.regexp_extract("file", "[^/]*$", 0))
    files.write_packed(spark.createDataFrame([*texts.items()], "file string, text string").repartition(2), str(tmp_path / "packed"))
    packed = files.parse_threads(files.packed_files(spark, str(tmp_path / "packed")))
    assert packed.columns == single.columns
    assert sorted(map(str, packed.collect())) == sorted(map(str, single.collect())) and packed.filter("reason is null").count() == 2


def test_thread_query_writes_few_files(spark, tmp_path):
    from foldspan import plans

    spark.range(200).selectExpr("id AS conv_id", "CAST(0 AS INT) AS turn", "'user' AS role", "'hello' AS text").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    begun = {x for x in Path(spark.conf.get("spark.checkpoint.dir")).rglob("part-*")}
    got = plans.queries()["S5_read_threads"](spark, str(tmp_path)).collect()
    made = [x for x in Path(spark.conf.get("spark.checkpoint.dir")).rglob("part-*") if x not in begun]
    assert len(got) == 200 and len(made) <= 20 and sum(r["reason"] == "malformed JSON" for r in got) == 29


def test_yaml_lines_are_read_once():
    """What is kept of a line, and the quick way to a key, equal the rules; lines that specs share are not read again."""
    rng = random.Random(3)
    for _ in range(3000):
        line = "".join(rng.choice(["a", "B_1", ":", " ", "  ", "#", '"', "'", "-", "1", "x: y", "\t", "{"]) for _ in range(rng.randint(1, 7)))
        found = spec_yaml._KEY.match(line)
        assert spec_yaml._key(line) == (found and (found[1], line[found.end() :])), line
    spec_yaml._line.cache_clear()
    for k in range(50):
        assert spec_yaml.load(f"# s\nentities:\n  - protein:\n      id: A{k} # n\n      group: 0x1") == {"entities": [{"protein": {"id": f"A{k}", "group": "0x1"}}]}
    assert spec_yaml._line.cache_info().misses == 54
