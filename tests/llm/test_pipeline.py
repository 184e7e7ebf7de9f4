import os
import re
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from foldspan.llm import bpe, quality_classifier, quality_rules, registry
from foldspan.llm.common import written
from oracle import connect, same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.count()
        assert 0 < rows <= count
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == names
        docs, count = out, rows


def test_each_stage_against_a_plain_version(spark):
    """Each stage on all that its predecessor kept: verdicts of the operators themselves for the classifier, the rules' SQL,
    similarity counted pair by pair, alignments by dynamic programming over whole texts, and the tokenizer library."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = written(stages["quality_classifier"](spark, docs, SF), "good")
    verdict = {r["doc_id"]: r["predicted"] for r in quality_classifier.scored(docs, labels).collect()}
    assert {r["doc_id"] for r in good.collect()} == {k for k, v in verdict.items() if v}
    clean = written(stages["quality_rules"](spark, good, SF), "clean")
    db = duckdb.connect()
    db.register("documents", good.toArrow())
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in db.sql(f"SELECT doc_id FROM ({quality_rules.ORACLE}) WHERE kept").fetchall()}
    before = {r["doc_id"]: r["text"].split("\n") for r in good.collect()}
    for r in clean.collect():
        rest = iter(before[r["doc_id"]])
        assert all(line in rest for line in r["text"].split("\n")) and r["n_chars"] == len(r["text"])
    single = written(stages["near_duplicates"](spark, clean, SF), "single")
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for k, t in texts.items()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for k, w in words.items()}
    parent = {k: k for k in sets}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[top(a)] = top(b)
    left = [r["doc_id"] for r in single.collect()]
    assert len(left) == len({top(k) for k in left}) == len({top(k) for k in parent})
    fresh = written(stages["decontamination"](spark, single, SF), "fresh")
    items = [[w for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", r["text"].lower())] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def holds(text, item):
        row, best = [0] * (len(text) + 1), 0
        for w in item:
            last, row = row, [0] * (len(text) + 1)
            for j, v in enumerate(text, 1):
                row[j] = max(0, last[j - 1] + (2 if v == w else -1), last[j] - 1, row[j - 1] - 1)
            best = max(best, *row)
        return best >= len(item)

    some = {r["doc_id"]: re.findall(r"[0-9a-z\x80-\U0010ffff]+", r["text"].lower()) for r in single.collect()}
    dirty = {k for k, t in some.items() if any(len(set(t) & set(i)) >= len(set(i)) / 3 and holds(t, i) for i in items if len(i) > 5)}
    kept = {r["doc_id"] for r in fresh.collect()}
    assert kept == set(some) - dirty and dirty
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    own = {r["doc_id"]: r["text"] for r in fresh.collect()}
    for r in stages["byte_level_bpe"](spark, fresh, SF).collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(own[r["doc_id"]]) and r["text"] == own[r["doc_id"]]


def test_pipeline_round_trips_texts_and_drops_copies(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    ids = [r["doc_id"] for r in got]
    assert len(ids) == len(set(ids)) and len({r["text"] for r in got}) == len(got)
    assert all(r["n_tokens"] * 4 == len(r["ids"]) and r["n_tokens"] > 0 for r in got)


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    for name, sql in registry.oracle_sql().items():
        same(connect(SF), names[name](spark, SF), sql)
