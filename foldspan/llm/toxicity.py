"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt: document frequencies of words in labelled rows, counted in tasks and summed by a shuffle, give
each word a log-likelihood ratio and log-odds; a strong and a weak list, each of bounded length, are broadcast. Features
are densities of both lists, hits near second-person words, capitals, punctuation, words broken up or spelt with digits,
and hits among these after undoing it. Lexicon and trees are fitted on rows of three folds by id, and calibrated on the
fourth, whose labels neither has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.llm.common import agreed_labels, broadcast_if_small, crc_bucket, runs, sample, small_batches, spans, word_hashes, written

#: Least log-likelihood ratios of the strong and the weak list, and the words each may have (those of highest ratio).
STRONG, WEAK, WORDS = 30.0, 16.0, 20_000
#: Bound of the labelled rows that trees and calibration are fitted on.
TRAIN_ROWS = 200_000
NEAR = 5
#: Second-person words of the languages at hand.
SECOND_PERSON = "you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes vosotros vuestro ti".split()
#: Digits and signs that stand for letters.
STANDS_FOR = str.maketrans("0134578@$!", "oieastbasi", "*._-+#%&|'\"")
FEATURES = ("strong_weight", "strong_rate", "strong_most", "strong_count", "weak_rate", "weak_count", "near_person", "person_rate", "capitals", "marks", "symbols", "broken", "undone", "length")


def _hash(text: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(text), np.uint8)
    ends = np.cumsum([len(w) for w in text])
    return word_hashes(raw, ends - [len(w) for w in text], ends)


def lexicon(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (sorted), log-odds weights and list (1 strong, 0 weak) of words that mark label 1. labelled: (text, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.asarray(batch.column(1).cast(pa.int64()))
            found, marks = [], []
            for i, _, raw, starts, ends, first in spans(batch.column(0), runs):
                hashes = word_hashes(raw, starts, ends)
                for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    found.append(np.unique(hashes[a:b]))
                    marks.append(np.full(len(found[-1]), y[i + k]))
            if found:
                word, place = np.unique(np.concatenate(found), return_inverse=True)
                mark = np.concatenate(marks)
                ones = np.bincount(place, mark, len(word)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(ones), pa.array(np.bincount(place, minlength=len(word)) - ones)], ["word", "a", "b"])

    total = labelled.agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).first()
    t, c = float(total["t"] or 0), float(total["c"] or 0)
    empty = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
    if not t or not c:
        return empty
    counts = labelled.select("text", "y").mapInArrow(run, "word long, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b, share = F.col("a"), F.col("b"), t / (t + c)
    part = lambda x, p: F.when(x > 0, x * F.log(x / ((a + b) * p))).otherwise(0.0)
    odds = F.log((a + 0.5) / (t - a + 0.5)) - F.log((b + 0.5) / (c - b + 0.5))
    judged = counts.select("word", (2 * (part(a, share) + part(b, 1 - share))).alias("ratio"), odds.alias("odds")).filter((F.col("odds") > 0) & (F.col("ratio") >= WEAK))
    judged = written(judged, "lexicon")
    lists = [judged.filter(part).orderBy(F.desc("ratio"), "word").limit(WORDS).toArrow() for part in (F.col("ratio") >= STRONG, F.col("ratio") < STRONG)]
    word, odds = (np.concatenate([x.column(c).to_numpy() for x in lists]) for c in ("word", "odds"))
    strong, word = np.repeat([1, 0], [x.num_rows for x in lists]), word.view(np.uint64)
    order = np.argsort(word)
    return word[order], np.clip(odds, 0.5, 10)[order], strong[order]


def features(docs: DataFrame, words: tuple) -> DataFrame:
    """(id, *FEATURES) of each row of docs (id, text); zeros for null and empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight, strong = shared.value
        person = np.sort(_hash([w.encode() for w in SECOND_PERSON]))

        def look_up(hashes: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            return np.where(known[at] == hashes, at, -1)

        for batch in batches:
            out = np.zeros((len(FEATURES), batch.num_rows))
            for i, j, raw, starts, ends, first in spans(batch.column(1), runs):
                hashes, n = word_hashes(raw, starts, ends), j - i
                owner = np.repeat(np.arange(n), np.diff(first))
                total = np.maximum(np.bincount(owner, minlength=n), 1)
                per = lambda mask, values=None: np.bincount(owner[mask], None if values is None else values[mask], n)  # noqa: E731, B023
                hit = look_up(hashes) if len(known) else np.full(len(hashes), -1)
                is_strong, is_weak = (hit >= 0) & (strong[hit] == 1) if len(known) else hit >= 0, (hit >= 0) & (strong[hit] == 0) if len(known) else hit >= 0
                w = np.where(hit >= 0, weight[hit], 0.0) if len(known) else np.zeros(len(hashes))
                second = np.isin(hashes, person)
                sums = np.append(0, np.cumsum(second))
                at = np.flatnonzero(is_strong)
                close = np.zeros(len(hashes), bool)
                close[at] = sums[np.minimum(at + NEAR + 1, first[owner[at] + 1])] > sums[np.maximum(at - NEAR, first[owner[at]])]
                head = raw[starts]
                marks = (head == 0x21) | (head == 0x3F)
                symbol = (head > 0x20) & (head < 0x80) & ~(((head >= 0x30) & (head < 0x3A)) | ((head | 32) >= 0x61) & ((head | 32) < 0x7B))
                inner = symbol.copy()
                if len(inner):
                    inner[[0, -1]] = False
                    inner[1:-1] &= (ends[:-2] == starts[1:-1]) & (ends[1:-1] == starts[2:]) & (owner[:-2] == owner[2:])
                digit = (raw >= 0x30) & (raw < 0x3A)
                digits = np.add.reduceat(digit, starts) if len(starts) else np.zeros(0)
                mixed = ~symbol & (digits > 0) & (digits < ends - starts)
                undone = np.zeros(n)
                if len(known):
                    odd = np.flatnonzero(mixed | inner)
                    spelt, whose = [], []
                    for k in odd:
                        lo, hi = starts[k], ends[k]
                        a, b = (starts[k - 1], ends[k + 1]) if inner[k] else (lo, hi)
                        text = raw[a:b].tobytes().decode("utf-8", "ignore").lower().translate(STANDS_FOR)
                        if text:
                            spelt.append(text.encode())
                            whose.append(owner[k])
                    if spelt:
                        good = look_up(_hash(spelt))
                        good = (good >= 0) & (strong[good] == 1)
                        undone = np.bincount(np.array(whose)[good], minlength=n)
                upper, letter = (raw >= 0x41) & (raw < 0x5B), ((raw | 32) >= 0x61) & ((raw | 32) < 0x7B)
                capitals = np.add.reduceat(upper, starts) if len(starts) else np.zeros(0)
                letters = np.add.reduceat(letter, starts) if len(starts) else np.zeros(0)
                most = np.zeros(n)
                np.maximum.at(most, owner[at], w[at])
                all_ = np.ones(len(hashes), bool)
                rows = (
                    per(is_strong, w) / total, per(is_strong) / total, most, np.log1p(per(is_strong)), per(is_weak) / total, np.log1p(per(is_weak)),
                    per(close) / total, per(second) / total, per(all_, capitals) / np.maximum(per(all_, letters), 1), per(marks) / total,
                    per(symbol & ~marks) / total, per(inner | mixed) / total, undone / total, np.log1p(np.diff(first)),
                )
                out[:, i:j] = rows
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in out)], ["id", *FEATURES])

    return docs.select("id", "text").mapInArrow(run, "id long, " + ", ".join(f"{x} double" for x in FEATURES))


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", learns: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for each document, by itself.

    Labels are joined on doc_id and used only where learns holds (a condition on doc_id; all by default). Null and empty
    texts have zero features and a score like any other; texts of any length are read whole; equal texts have equal
    scores. Null ids are scored and never learnt from; ids that repeat are scored row by row, and each row is learnt from;
    ids with both labels are not. Without rows of both labels in the fitting and the calibration folds, the score is the
    mean label, or 0. An empty table gives an empty one. Other columns of docs are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    calibrates = crc_bucket("id", 1000) % 4 == 3
    marked = broadcast_if_small(agreed_labels(labels, label, learns))
    known = lexicon(slim.join(marked.filter(~calibrates), "id").select("text", "y"))
    table = written(features(slim, known), "features")
    joined = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    rows = written(table.join(marked, "id").select("y", calibrates.alias("calibrates"), *FEATURES), "labelled")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample(rows, TRAIN_ROWS)).select("features", "y", "calibrates")
    rows = rows.coalesce(4).persist()
    seen = {(r["calibrates"], r["y"]): r["count"] for r in rows.groupBy("calibrates", "y").count().collect()}
    if any((c, y) not in seen for c in (False, True) for y in (0, 1)):
        share = sum(n for (_, y), n in seen.items() if y == 1) / max(1, sum(seen.values()))
        scores = table.select("id", F.lit(float(share)).alias("score"))
    else:
        trees = GBTClassifier(labelCol="y", maxDepth=3, maxIter=20, stepSize=0.2, minInstancesPerNode=3, seed=5).fit(rows.filter("not calibrates"))
        raw = lambda df: df.withColumn("raw", vector_to_array("probability").getItem(1))
        scale = IsotonicRegression(labelCol="y", featuresCol="raw", predictionCol="score").fit(raw(trees.transform(rows.filter("calibrates"))).select("raw", F.col("y").cast("double")))
        scores = scale.transform(raw(trees.transform(joined)).select("id", "raw")).select("id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"))
    rows.unpersist()
    return scores.select(F.col("id").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
