"""Rows without an id, ids with labels that disagree, and repeated ids, in the queries that learn."""

import os

import pytest

from foldspan.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["op3_toxicity", "op8_language_model", "op10_quality_classifier"])
def test_odd_ids(spark, tmp_path, name):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = docs.limit(3).selectExpr("cast(null as long) AS doc_id", "text", "lang", "source", "n_chars").unionByName(docs.limit(2))
    docs.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    labels.unionByName(labels.limit(5).selectExpr("doc_id", "1 - quality AS quality", "1 - toxic AS toxic")).unionByName(labels.limit(2).selectExpr("cast(null as long) AS doc_id", "quality", "toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    rows = registry.queries()[name](spark, str(tmp_path)).collect()
    assert len(rows) == docs.count() + 5 and all(r["held_out"] is not None and r["score"] is not None for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False] * 3
