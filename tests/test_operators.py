import json
import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from foldspan.functions import text as X
from foldspan.functions.chains import chain_ids
from foldspan.operators import designs, encodings, evidence, plan_steps, pocket, specs, structures, threads
from foldspan.schemas import require_columns
from foldspan.sources import files, responses, sinks
from foldspan.streaming import rows as stream_rows


def hits(spark, data):
    names = "project_id long, source string, id string, title string, journal string, host_venue string, url string, fulltext_url string, abstract string, is_open_access boolean"
    return spark.createDataFrame(data, names)


def test_scores_and_tiers(spark):
    data = [
        (1, "PubMed", "a", "", "", "", "https://www.nature.com/x", "", "t", True),
        (1, "OpenAlex", "b", "", "", "", "https://x.org", "", "", False),
        (1, "WebSearch", "c", "", "", "", "https://x.org", "", "t", None),
        (1, "WebSearch", "d", "", "", "", "https://www.nature.com/x", "", "t", False),
        (1, "LocalPDF", "e", "", "", "", "/tmp/x.pdf", "", "t", True),
        (1, "Elsewhere", "f", None, None, None, None, None, None, None),
    ]
    got = {r["id"]: (round(r["quality_score"], 9), r["quality_tier"]) for r in evidence.annotated(hits(spark, data)).collect()}
    assert got == {"a": (1.0, "high"), "b": (0.65, "medium"), "c": (0.45, "low"), "d": (0.70, "medium"), "e": (0.95, "high"), "f": (0.25, "low")}


def test_report_has_zeros(spark):
    projects = spark.createDataFrame([(1,), (2,)], "project_id long")
    report = evidence.source_report(evidence.annotated(hits(spark, [(1, "PubMed", "a", "Nature of x", "", "", "", "", "t", True)])), projects)
    got = {(r["project_id"], r["metric"]): r["value"] for r in report.collect()}
    assert got[1, "nature_hits"] == 1 and got[2, "total_literature_hits"] == 0 and len(got) == 18


def loop_budget(docs, max_files, per_file, total):
    used, out = 0, {}
    for name, text in sorted(docs)[:max_files]:
        piece = " ".join(text.split())[:per_file].rstrip(" ")
        if not piece:
            out[name] = ("", "error")
            continue
        cut = piece[: max(0, total - used)].rstrip(" ")
        used += len(cut)
        out[name] = (cut, "used" if cut else "skipped")
    return out


def test_budget_example(spark):
    docs = spark.createDataFrame([(1, "a", "abcdefg"), (1, "b", "   "), (1, "c", "xy zw"), (1, "d", "q")], "project_id long, name string, text string")
    got = {r["name"]: (r["excerpt"], r["status"]) for r in evidence.text_budget(docs, 20, 5, 8).collect()}
    assert got == {"a": ("abcde", "used"), "b": ("", "error"), "c": ("xy", "used"), "d": ("q", "used")}


def test_budget_equals_the_loop(spark):
    rng = random.Random(4)
    data, want = [], {}
    for p in range(120):
        docs = [(f"{k:02}", "".join(rng.choice("ab  ") for _ in range(rng.randint(0, 9)))) for k in range(8)]
        data += [(p, *x) for x in docs]
        want |= {(p, n): v for n, v in loop_budget(docs, 7, 6, 17).items()}
    got = evidence.text_budget(spark.createDataFrame(data, "project_id long, name string, text string"), 7, 6, 17).collect()
    assert {(r["project_id"], r["name"]): (r["excerpt"], r["status"]) for r in got} == want


def test_records_of_empty_projects(spark):
    projects = spark.createDataFrame([(1,), (2,)], "project_id long")
    df = spark.createDataFrame([(1, "x", float("nan"))], "project_id long, id string, score double")
    got = {r["project_id"]: json.loads(r["records"]) for r in evidence.bounded_records(df, projects, 5, ["id"]).collect()}
    assert got == {1: [{"id": "x", "score": None}], 2: []}


def test_pocket_tags_and_extremes(spark):
    data = [("ET_1", "7.0"), ("Cv_1", "7.7"), ("Cv-F88L_1", "5.8"), ("Dc_1", "4.9"), ("TE_1", "nan"), ("OA_1", "4.5")]
    wide = spark.createDataFrame([(k, n, v, "x") for k, (n, v) in enumerate(data)], "ord int, struct_name string, dist string, note string")
    assert pocket.detect_metrics(wide) == ["dist"]
    long = pocket.melt_metrics(wide, ["dist"])
    tags = {r["struct_name"]: r["tag"] for r in pocket.quantile_tag(long, pocket.metric_quantiles(long)).collect()}
    assert tags == {"ET_1": "high", "Cv_1": "high", "Cv-F88L_1": "mid", "Dc_1": "low", "TE_1": "na", "OA_1": "low"}
    extremes = {r["pattern"]: (r["struct_name"], r["value"]) for r in pocket.metric_extremes(long).collect()}
    assert extremes == {"min::dist": ("OA_1", 4.5), "max::dist": ("Cv_1", 7.7)}
    deltas = pocket.variant_deltas(long).collect()
    assert [(r["variant"], r["base"], round(r["delta"], 9)) for r in deltas] == [("Cv-F88L", "Cv", -1.9)]


def test_pocket_needs_columns(spark):
    with pytest.raises(ValueError):
        require_columns(spark.range(1), ["struct_name"])
    with pytest.raises(ValueError):
        pocket.analyse(spark.createDataFrame([("a", 0, "x")], "struct_name string, ord int, m string"), spark.createDataFrame([(1, "A")], "index int, e_res_aa string"))


def test_analyse_gives_signatures(spark):
    wide = spark.createDataFrame([("e_1", 0, 1.0), ("f_1", 1, 2.0)], "struct_name string, ord int, m double")
    alignment = spark.createDataFrame([(3, "A"), (1, None), (2, "C")], "index int, e_res_aa string")
    profiles, extremes = pocket.analyse(wide, alignment, [1, 3])
    assert {r["enzyme"]: r["signature"] for r in profiles.collect()} == {"e": "1:-; 3:A", "f": "n/a"}
    assert extremes.count() == 2


ATOMS = "structure_id string, chain string, resn string, resi string, atom_name string, x double, y double, z double, b double"


def test_proximity_example(spark):
    data = [("s", "A", "SER", "10", "CA", 0, 0, 0), ("s", "A", "SER", "10", "OG", 4, 0, 0), ("s", "A", "LYS", "9A", "CA", 20, 0, 0), ("s", "A", "UNK", "11", "CA", 8, 0, 3), ("s", "B", "LIG", "1", "C1", 8, 0, 0)]
    atoms = spark.createDataFrame([(*map(str, r[:5]), *map(float, r[5:]), 1.0) for r in data], ATOMS)
    near = structures.residues_within(atoms, "A", "B", 5.0)
    assert {(r["resn"], r["resi"]) for r in near.collect()} == {("SER", "10"), ("UNK", "11")}
    assert [(r["aa"], r["resi"], r["polarity"]) for r in structures.classify_residues(near).collect()] == [("S", "10", "p~")]
    order = spark.createDataFrame([("10",), ("9A",), ("x",), ("-2",)], "resi string").orderBy(structures.resi_sort_key(F.col("resi")))
    assert [r["resi"] for r in order.collect()] == ["-2", "9A", "10", "x"]


def test_proximity_equals_brute_force(spark):
    rng = random.Random(2)
    pts = [("s%d" % (k % 2), rng.choice("AB"), "GLY", str(k), "CA", *(rng.uniform(-9, 9) for _ in range(3)), 1.0) for k in range(300)]
    want = {(a[0], a[3]) for a in pts for b in pts if a[0] == b[0] and a[1] == "A" and b[1] == "B" and math.dist(a[5:8], b[5:8]) <= 3}
    got = structures.residues_within(spark.createDataFrame(pts, ATOMS), "A", "B", 3.0).collect()
    assert {(r["structure_id"], r["resi"]) for r in got} == want


def test_superposition_of_a_turned_copy(spark):
    rng = random.Random(8)
    pts = [(rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(12)]
    c, s = math.cos(1.1), math.sin(1.1)
    data = [("t", "A", "GLY", str(k), "CA", *p, 50.0) for k, p in enumerate(pts)]
    data += [("r", "A", "GLY", str(k), "CA", c * x - s * y + 5, s * x + c * y - 2, z + 1, 50.0) for k, (x, y, z) in enumerate(pts)]
    data += [("few", "A", "GLY", str(k), "CA", 0.0, 0.0, float(k), 50.0) for k in range(2)]
    atoms = spark.createDataFrame(data, ATOMS)
    pairs = spark.createDataFrame([("p", "t", "r"), ("q", "few", "r")], "pair_id string, target string, reference string")
    got = {r["pair_id"]: (r["rmsd"], r["binder_rmsd"]) for r in structures.rmsd(atoms, pairs, "A").collect()}
    assert got["p"][0] < 1e-9 and got["p"][1] < 1e-9 and got["q"] == (None, None)
    moved = {r["resi"]: (r["x"], r["y"], r["z"]) for r in structures.superpose(atoms, pairs.filter("pair_id = 'p'")).collect()}
    assert all(math.dist(moved[r[3]], r[5:8]) < 1e-9 for r in data if r[0] == "r")


def test_ipae_example(spark):
    m = spark.range(1).select(F.expr("array(array(0D,2D,4D),array(6D,0D,1D),array(8D,1D,0D))").alias("m"))
    assert [m.select(structures.ipae(F.col("m"), F.lit(n))).first()[0] for n in (1, 3, 0)] == [5.0, None, None]


DESIGN = "structure_idx int, sequence_idx int, rmsd double, ipae double, binder_rmsd double, binder_plddt double, score double"


def test_filter_and_best(spark):
    data = [(0, 0, 1.0, 5.0, 0.5, 90.0, 0.9), (0, 1, 1.2, 4.0, 0.6, 85.0, None), (1, 0, 2.5, 4.0, 0.5, 90.0, 0.8), (1, 1, 1.0, 3.0, 0.5, float("nan"), 0.7), (2, 0, 1.0, 3.5, 0.9, 81.0, 0.6)]
    kept = designs.filter_designs(spark.createDataFrame(data, DESIGN))
    assert {(r[0], r[1]) for r in kept.collect()} == {(0, 0), (0, 1), (2, 0)}
    best = designs.select_best_per_structure(kept).collect()
    assert [(r["structure_idx"], r["sequence_idx"], r["score"]) for r in best] == [(2, 0, 0.6), (0, 1, 0.9)]


def test_refold_lookup(spark):
    ranked = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (2, 0, 3.0)], "structure_idx int, sequence_idx int, ipae double")
    found = spark.createDataFrame([(0, 0, " ", "a.b.cif"), (2, 0, "z.pdb", "z.cif")], "structure_idx int, sequence_idx int, out_pdb string, out_cif string")
    assert [r["path"] for r in designs.lookup_refold(ranked, found, 2).collect()] == ["a.b.pdb"]


def test_encodings(spark):
    df = spark.createDataFrame([("acXD", "A")], "seq string, base string")
    one = encodings.encode(df, "one_hot", n=6).first()["encoding"]
    assert (one["size"], one["indices"], one["values"]) == (120, [0, 21, 62], [1.0, 1.0, 1.0])
    both = encodings.feature_matrix(df, base="base").first()["features"]
    assert (both["size"], both["indices"]) == (100, [0, 20, 41, 82])
    dense = encodings.encode(df, "georgiev", n=6, scales={a: [0.5, 1.0] for a in "ACD"}).first()["encoding"]
    assert len(dense) == 12 and dense[4:6] == [0.0, 0.0] and dense[8:] == [0.0] * 4
    with pytest.raises(ValueError):
        encodings.encode(df, "other")


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.thread_ref(F.lit("literature_review_D762A72EC7F04BEC9B66CCD3AAC21B91.json"))) == "d762a72ec7f04bec9b66ccd3aac21b91"
    assert one(X.thread_ref(F.lit("abc"))) == "abc"
    assert one(X.sanitise_tag(F.lit(" my tag! "))) == "my_tag"
    assert one(X.clean_text(F.lit(" a  \n b "), 3)) == "a b"
    assert one(X.clean_text(F.lit(None))) == ""
    assert one(X.compact_text(F.lit("x" * 20), 10)) == "x" * 7 + "..."
    assert one(X.as_list(F.lit(None))) == [] and one(X.as_list(F.lit(" a, ,b"))) == ["a", "b"]
    assert one(chain_ids(F.lit(3), F.array(F.lit("AB")), 25)) == ["Z", "AA", "AC"]


def test_referenced_files(spark):
    metadata = '{"p":"/a b","q":"out/x.csv","r":["/tmp/y", "q\\"/z.md"],"s":"./z", "out.md": 3}'
    got = threads.referenced_files(spark.createDataFrame([("t", metadata), ("t", None)], "thread string, metadata string"))
    assert {r["path"] for r in got.collect()} == {"/tmp/y", "out/x.csv", 'q"/z.md'}


def test_thread_creation_and_context(spark):
    old = spark.createDataFrame([("a",)], "thread_id string")
    with pytest.raises(ValueError):
        threads.create_threads(old, old)
    refs = spark.createDataFrame([("missing", "")], "ref string, tag string")
    rows = spark.createDataFrame([Row(file="x.json", thread_id="x", messages=[Row(role="user", content="hi", metadata="{}")])])
    texts = spark.createDataFrame([], "path string, text string")
    assert threads.thread_context(refs, rows, texts).first()["context"] == ""
    with pytest.raises(FileNotFoundError):
        threads.thread_context(refs, rows, texts, on_missing="raise")


def test_plan_array(spark):
    shapes = ['note: [{"step_index":2},{"step_index":1},3] end', '[{"step_index":1}]', "no", "", None, "[1, 2]", "[broken", '{"a": [1]}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(shapes)], "plan_id int, text string")
    got = {r["plan_id"]: r["n"] for r in df.select("plan_id", F.size(plan_steps.extract_json_array(F.col("text"))).alias("n")).collect()}
    assert got == {0: 2, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    assert [r["step_index"] for r in plan_steps.plan_steps(df.filter("plan_id = 0")).collect()] == [1, 2]


def test_invalid_requests_raise(spark):
    report = spark.createDataFrame([(1, False, ["bad"])], "request_id int, ok boolean, errors array<string>")
    with pytest.raises(ValueError, match="bad"):
        specs.assert_valid(report)


def test_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("ACD\n\n>x y\n AC \nDE\n>empty\n>z\nK\n")
    got = files.read_fasta(spark, str(tmp_path / "a.fasta")).orderBy("rec_no").collect()
    assert [(r["seq_id"], r["sequence"]) for r in got] == [("", "ACD"), ("x", "ACDE"), ("z", "K")]
    (tmp_path / "t.txt").write_text("# no\n\n CCO ethanol\nHEM\n")
    assert [r["token"] for r in files.read_tokens(spark, str(tmp_path / "t.txt")).collect()] == ["CCO", "HEM"]
    chats = tmp_path / "chats"
    chats.mkdir()
    (chats / "a_1.json").write_text(json.dumps({"thread_id": "1", "updated_at": "2024", "messages": [{"role": "user", "content": "hi", "metadata": {"f": ["/x.md"]}}]}, indent=1))
    (chats / "bad.json").write_text("{ not json")
    rows = files.read_threads(spark, str(chats))
    assert [(r["thread_id"], r["n_messages"]) for r in threads.list_threads(rows).collect()] == [("1", 1)]
    assert json.loads(rows.first()["messages"][0]["metadata"]) == {"f": ["/x.md"]}
    (tmp_path / "s.json").write_text('{"entities": [{"protein": {"id": "A", "sequence": "140..180"}}, {"ligand": {"id": "B", "smiles": " CCO "}}]}')
    flat = specs.flatten_spec(files.read_design_specs(spark, str(tmp_path / "s.json"))).first()
    assert (flat["target_chain_id"], flat["target_sequence"], flat["ligand_smiles"]) == ("A", None, ["CCO"])
    (tmp_path / "p.csv").write_text(",struct_name,struct_name,m<6\n0,e_1,e_1,1.5\n")
    assert files.read_table_csv(spark, str(tmp_path / "p.csv")).columns == ["struct_name", "m<6"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "project_id int, x string")
    manifest = sinks.write_tables({"t": df}, str(tmp_path / "out"), csv=True, config={"a": 1}).collect()
    assert [(r["table"], r["rows"], r["nulls"], r["low"], r["high"], r["config"]) for r in manifest] == [("t", 2, {"project_id": 0, "x": 0}, "1", "2", '{"a": 1}')]
    assert sinks.reuse(spark, str(tmp_path / "out/t")).count() == 2 and sinks.reuse(spark, str(tmp_path / "none")) is None
    vectors = encodings.feature_matrix(spark.createDataFrame([("AC",)], "seq string"))
    sinks.write_vectors(vectors, str(tmp_path / "v"), sparse=False)
    dense = spark.read.parquet(str(tmp_path / "v")).first()["features"]
    assert len(dense) == 40 and [k for k, x in enumerate(dense) if x] == [0, 21]
    for k in (0, 1, 0):
        sinks.append_messages(spark.createDataFrame([(str(k), "t")], "message_id string, thread_id string"), str(tmp_path / "m"), f"batch-{k}")
    assert sorted(r["message_id"] for r in sinks.read_messages(spark, str(tmp_path / "m")).collect()) == ["0", "1"]


def test_malformed_xml(spark):
    landed = spark.createDataFrame([("P1", "<a><b>x</b>\n y</a>"), ("P2", "<a>"), ("P3", None)], "pmcid string, body string")
    assert {r["pmcid"]: r["excerpt"] for r in responses.xml_fulltext(landed).collect()} == {"P1": "x y", "P2": "", "P3": ""}


def test_scores_on_a_stream(spark, tmp_path):
    data = hits(spark, [(1, "PubMed", str(k), "", "", "", "", "", "t", True) for k in range(6)])
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    query = stream_rows.run(stream_rows.stream(spark, str(tmp_path / "in"), data._jdf.schema().toDDL(), 1), stream_rows.score_hits, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_pocket_descriptors(spark):
    data = [("s", "GLY", 3.0), ("s", "TRP", 4.0), ("s", "LYS", 9.0), ("s", "UNK", 1.0)]
    got = {r["shell"]: r for r in structures.pocket_descriptors(spark.createDataFrame(data, "structure_id string, resn string, min_dist double")).collect()}
    near, far = got["proximal"], got["distal"]
    assert (near["n"], near["mean_volume"], near["small_residue_frac"], near["bulky_residue_frac"], near["charged_fraction"]) == (2, 105.5, 0.5, 0.5, 0.0)
    assert math.isclose(near["weighted_mean_volume"], (48 / 3 + 163 / 4) / (1 / 3 + 1 / 4)) and far["charged_fraction"] == 1.0 and far["volume_variance"] is None
