"""Features of the classifiers, value by value, against plain versions."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foldspan.llm import common, quality_classifier, toxicity

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")
LEXICON = {"grok": (3.0, 1), "fool": (2.0, 1), "méchant": (4.0, 1), "bad": (1.0, 0), "loud": (0.5, 0)}
TEXTS = [
    "You GROK, you fool!! Bad day.", "", None, "   ", "f00l and g.r.o.k and gr*k, fo0l b4d", "Nobody is loud here; the mill turned for you.", "méchant! TU es méchant?", "grok one two three four five you", "grok one two three four you",
    "a!b c.d ... !!! 123 4x x4", "YOU YOU BAD BAD", "ß漢字 you grok漢",
]


def tokens(text):
    return [(m.start(), m.end(), m[0]) for m in TOKEN.finditer((text or "").encode())]


def low(token):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in token)


def plain_toxic(text):
    raw, found = (text or "").encode(), tokens(text)
    known = {w.encode(): v for w, v in LEXICON.items()}
    hits = [known.get(low(t)) for _, _, t in found]
    strong = [k for k, h in enumerate(hits) if h and h[1]]
    weak = [k for k, h in enumerate(hits) if h and not h[1]]
    person = [low(t).decode("utf-8", "ignore") in toxicity.SECOND_PERSON for _, _, t in found]
    symbol = [t[0] < 0x80 and not t[:1].isalnum() for _, _, t in found]
    mark = [t[:1] in (b"!", b"?") for _, _, t in found]
    inner = [symbol[k] and 0 < k < len(found) - 1 and found[k - 1][1] == found[k][0] and found[k][1] == found[k + 1][0] for k in range(len(found))]
    digits = [sum(48 <= b < 58 for b in t) for _, _, t in found]
    mixed = [not symbol[k] and 0 < digits[k] < len(found[k][2]) for k in range(len(found))]
    undone = 0
    for k in range(len(found)):
        if inner[k] or mixed[k]:
            a, b = (found[k - 1][0], found[k + 1][1]) if inner[k] else found[k][:2]
            word = raw[a:b].decode("utf-8", "ignore").lower().translate(toxicity.STANDS_FOR)
            undone += LEXICON.get(word, (0, 0))[1]
    n = max(len(found), 1)
    upper, letters = (sum(f(b) for _, _, t in found for b in t) for f in (lambda b: 65 <= b <= 90, lambda b: 97 <= b | 32 <= 122))
    weight = [hits[k][0] for k in strong]
    return [
        sum(weight) / n, len(strong) / n, max(weight, default=0), math.log1p(len(strong)), len(weak) / n, math.log1p(len(weak)), sum(any(person[max(0, k - 5) : k + 6]) for k in strong) / n, sum(person) / n, upper / max(letters, 1),
        sum(mark) / n, sum(s and not m for s, m in zip(symbol, mark, strict=True)) / n, sum(i or m for i, m in zip(inner, mixed, strict=True)) / n, undone / n, math.log1p(len(found)),
    ]


def test_toxicity_features(spark):
    rng = random.Random(6)
    pieces = ["you", "grok", "Fool", "bad", "f0ol", "g.r", "!", "??", "the", "MILL", "é", "12", "a-b", "loud", ",", "  "]
    texts = TEXTS + [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["".join(rng.choice(pieces) for _ in range(12)) for _ in range(40)]
    hashes = toxicity._hash([w.encode() for w in LEXICON])
    order = np.argsort(hashes)
    values = list(LEXICON.values())
    words = hashes[order], np.array([values[k][0] for k in order]), np.array([values[k][1] for k in order])
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: [r[c] for c in toxicity.FEATURES] for r in toxicity.features(docs, words).collect()}
    for k, text in enumerate(texts):
        assert np.allclose(got[k], plain_toxic(text), atol=1e-6), (text, got[k], plain_toxic(text))


def test_quality_vectors_and_pools(spark):
    rng = random.Random(9)
    texts = ["one two three two one.", "", None, "a, b! c", "x"] + [" ".join(rng.choice(["mill", "sea", "the", "boat", "of", "3"]) for _ in range(rng.randint(1, 40))) for _ in range(20)]
    hashed = lambda t: common.word_hashes(np.frombuffer(b"".join(x for _, _, x in tokens(t)) or b"", np.uint8), *(np.array(v) for v in zip(*_packed(tokens(t)), strict=True))) if tokens(t) else np.zeros(0, np.uint64)
    total = np.zeros((quality_classifier.BUCKETS, quality_classifier.DIMENSIONS))
    rng2 = np.random.default_rng(1)
    vectors = rng2.normal(size=total.shape).astype(np.float32)
    want = []
    for t in texts:
        h = hashed(t)
        own = quality_classifier.index_vectors(h)
        rows = (h % np.uint64(quality_classifier.BUCKETS)).astype(int)
        for k in range(len(h)):
            for j in (-2, -1, 1, 2):
                if 0 <= k + j < len(h):
                    total[rows[k]] += own[k + j]
        seen = vectors[rows].astype(float)
        n = max(1, len(h))
        want.append(np.concatenate([seen.sum(0) / n, (seen[:-1] * seen[1:]).sum(0) / n]))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    strips = common.gathered(common.summed(quality_classifier.contexts(docs), "strip", "values", 8))
    assert np.allclose(np.concatenate([strips[k] for k in range(16)]).reshape(total.shape), total, atol=1e-4)
    assert np.allclose(quality_classifier.pooled(pa.array(texts), vectors), want, atol=1e-5)


def _packed(found):
    """Starts and ends of tokens laid side by side."""
    at = 0
    for _, _, t in found:
        yield at, at + len(t)
        at += len(t)


def test_draws_do_not_depend_on_files(spark, tmp_path):
    rows = spark.range(20_000).select("id", (F.col("id") % 2).alias("y"))
    rows.repartition(3).write.parquet(str(tmp_path / "a"))
    rows.repartition(11).write.parquet(str(tmp_path / "b"))
    a, b = ({r["id"] for r in common.sample(spark.read.parquet(str(tmp_path / x)), 2000).collect()} for x in "ab")
    assert a == b and 1700 < len(a) < 2300
