"""Near-duplicate documents by circulant MinHash, banding and exact verification on whole shingle sets.

Two random permutations of a universe of 2**20 places make all signature coordinates: the first scatters a shingle,
the second, shifted by k places, orders the universe for coordinate k. The values of all coordinates of a shingle are
therefore one contiguous window of the second permutation, and a signature is the minimum over windows.

Plan: (1) documents with the same shingle set form a class and only its smallest id goes on; (2) band keys are counted
with map-side combine and only shared ones stay; (3) each member of a shared key is compared with the key's smallest
member, a star rather than all pairs; (4) the links found make components; (5) keys that still hold several components
are finished by comparing, in blocks of bounded size, the members outside the key's largest component with the whole
key; (6) components of all links. Step 5 makes the result whole: no pair that shares a key and could still join two
components goes without an exact comparison.

A key or a smallest member may stand for a third of all rows: keys that many share are joined by broadcast (their number
is bounded by their share), and the set of a smallest member is dealt out in copies, one for HEAD_ROWS of its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspan.llm.common import blocks, broadcast_if_small, joined_hot, mix, ngram_hashes, small_batches, utf8, word_hashes, words, written
from foldspan.llm.components import connected_components

UNIVERSE = 1 << 20
#: With 40 bands of 6 rows, a pair of similarity 0.8 shares no band with probability (1 - 0.8**6)**40 = 5e-6.
BANDS, ROWS = 40, 6
#: Sizes of the blocks of step 5: members outside the largest component, and members of the key, and the shingles that a
#: block of either holds about at most, so that very long texts make smaller blocks.
MINOR_BLOCK, MEMBER_BLOCK, BLOCK_SHINGLES = 256, 1024, 4 << 20
#: Pairs of one smallest member that are compared with one copy of its set.
HEAD_ROWS = 4096


@lru_cache(maxsize=2)
def permutations(coordinates: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and windows of the ordering one: row i holds the values of place i under all shifts."""
    rng = np.random.default_rng(seed)
    scatter = rng.permutation(UNIVERSE).astype(np.int32)
    order = rng.permutation(UNIVERSE).astype(np.uint32)
    return scatter, np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:coordinates]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a set of 64-bit shingle hashes."""
    scatter, windows = permutations(coordinates)
    places = scatter[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    out = windows[places[:1024]].min(0)
    for k in range(1024, len(places), 1024):
        np.minimum(out, windows[places[k : k + 1024]].min(0), out=out)
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of a signature."""
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for column in values[: bands * rows].reshape(bands, rows).T:
        keys = mix((keys ^ column) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(rows))
    return keys.view(np.int64)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text of fewer words is one shingle; without words the set is empty."""
    raw, offsets = utf8(column)
    for i, j in blocks(offsets):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = words(part, at)
        hashes = word_hashes(part, starts, ends)
        grams = ngram_hashes(hashes, width)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            else:
                yield ngram_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Id, set size, set id and band keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                sizes, ids, keys, counts = [], [], [], [0]
                for s in shingle_sets(part.column(1), width):
                    sizes.append(len(s))
                    ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    if len(s):
                        keys.append(band_keys(signature(s, bands * rows), bands, rows))
                    counts.append(len(keys) * bands)
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), lists], ["id", "n_shingles", "set_id", "keys"])

    return docs.mapInArrow(run, "id long, n_shingles long, set_id binary, keys array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Id and whole shingle set, as the bytes of sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                sets = [s.tobytes() for s in shingle_sets(part.column(1), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity. An a may have very many pairs, a b has one for each band at
    most: each a's set is copied for every HEAD_ROWS of its pairs, which are dealt over the copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(p) + len(q) - len(np.union1d(p, q)) if min(len(p), len(q)) * 100 >= percent * max(len(p), len(q)) else 0
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    heads = written(pairs.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.count("*") / HEAD_ROWS).cast("int").alias("copies")), "heads")
    dealt = joined_hot(pairs, heads, "a", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"))
    left = heads.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "x")
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return dealt.join(left, ["a", "copy"]).join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def block_links(minors: tuple, members: tuple, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks of (ids, components, sets), where the components differ: for each member one link to each
    component with a similar minor, which is enough to join them. The intersections with all minors come from one inverted
    index of the minors' shingles."""
    ids, comps, sets = minors
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = []
    for i, c, s in zip(*members, strict=True):
        lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, "right")
        n = hi - lo
        hits = owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        common = np.bincount(hits, minlength=len(sets))
        found = np.flatnonzero((100 * common >= percent * (sizes + len(s) - common)) & (comps != c))
        found = found[np.unique(comps[found], return_index=True)[1]]
        out += [(min(i, ids[k]), max(i, ids[k])) for k in found]
    return out


def _finished(members: DataFrame, component: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links still open in keys that hold several components (step 5). sizes are the shingles (id, n_shingles) of each set."""
    labelled = members.join(component, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("total")).filter("parts > 1")
    mixed = written(mixed.select("key", F.col("top.component").alias("major"), "total", (F.col("total") - F.col("top.n")).alias("minor")), "mixed-keys")
    count = members.count()
    sized = joined_hot(labelled, mixed, "key", count, "total").join(sizes, "id")
    weights = sized.groupBy("key").agg(*(F.first(c).alias(c) for c in ("major", "total", "minor")), F.sum("n_shingles").alias("all"), F.sum(F.when(F.col("component") != F.col("major"), F.col("n_shingles"))).alias("few"))
    spread = lambda n, size, weight: F.ceil(F.greatest(F.col(n) / size, F.col(weight) / BLOCK_SHINGLES)).cast("int")
    weights = written(weights.select("key", "major", "total", spread("total", MEMBER_BLOCK, "all").alias("ps"), spread("minor", MINOR_BLOCK, "few").alias("qs")), "weights")
    rows = written(joined_hot(labelled, weights, "key", count, "total"), "mixed")
    block = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = rows.select("key", block("ps").alias("p"), every("qs").alias("q"), "id", "component")
    inner = rows.filter("component <> major").select("key", every("ps").alias("p"), block("qs").alias("q"), "id", "component")

    def parsed(table: pa.Table) -> tuple:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        return table.column("id").to_numpy(), table.column("component").to_numpy(), sets

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = block_links(parsed(left), parsed(right), percent) if left.num_rows and right.num_rows else []
        best = sorted(set(found))
        return pa.table({"a": pa.array([int(x) for x, _ in best], pa.int64()), "b": pa.array([int(y) for _, y in best], pa.int64())})

    keys = ("key", "p", "q")
    grouped = lambda df: df.join(sets, "id").select(*(F.col(c).alias(c) for c in (*keys, "id", "component", "shingles"))).groupBy(*keys)
    return grouped(inner).cogroup(grouped(outer)).applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Classes of documents whose word-shingle sets reach a Jaccard similarity of percent / 100.

    Returns (doc_id, n_shingles, component_id, kept): component_id is the smallest id reachable over links. Null and
    empty texts, and texts without words, have an empty set and are linked with nothing. Rows without an id come back
    unlinked, with a null component, kept. Rows that repeat an id are one document, linked where any of their texts is;
    each has its own n_shingles. Texts of any length count whole. An empty table gives an empty one. Any other columns
    are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = written(_signed(slim, width, bands, rows), "signed")
    linkable = signed.filter("id is not null and n_shingles > 0")
    classes = linkable.groupBy("set_id").agg(F.min(F.struct("id", "keys")).alias("s"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"))
    classes = written(classes.select("set_id", "s.id", "s.keys", "n", "n_shingles"), "classes")
    spread = classes.select("id", F.explode("keys").alias("key"))
    shared = written(spread.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("head")).filter("n > 1"), "shared")
    members = written(joined_hot(spread, shared, "key", bands * classes.count()).select("key", "id", "head"), "members")
    asked = written(members.select("id").distinct(), "asked")
    sets = written(_sets(slim.join(broadcast_if_small(asked), "id", "left_semi"), width).distinct(), "sets")
    star = written(members.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "star")
    links = written(_verified(star, sets, percent).distinct(), "links")
    component = connected_components(links)
    more = written(_finished(members.select("key", "id"), component, classes.groupBy("id").agg(F.max("n_shingles").alias("n_shingles")), sets, percent).distinct(), "more")
    if not more.isEmpty():
        component = connected_components(links.unionByName(more))
    labelled = written(classes.join(component, "id", "left").select("set_id", F.coalesce("component", "id").alias("component_id"), "n"), "labelled")
    out = joined_hot(linkable.drop("keys"), labelled, "set_id", signed.count()).select("id", "n_shingles", "component_id")
    alone = signed.filter("id is null or n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs, with all their columns, but only the first row of each near-duplicate class, in the order of a copy of the table
    that is written here with a key for each row. So rows are judged by themselves whether their id is null, repeated or
    unlike; rows without words stay. The keys to drop are broadcast if they are few by a checked count of bytes;
    otherwise a shuffled anti-join drops them."""
    keyed = written(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed")
    verdict = near_duplicates(keyed, "__row", text_col, **options)
    gone = written(verdict.filter("not kept").select(F.col("doc_id").alias("__row")), "gone")
    return keyed.join(broadcast_if_small(gone), "__row", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


#: The same for two-word shingles by counting common shingles, which MinHash is spared.
ORACLE = """
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM words
), classes AS (
    SELECT s, min(doc_id) AS id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), items AS (
    SELECT id, n, unnest(s) AS shingle FROM classes
), pairs AS (
    SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.shingle = b.shingle AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links AS (
    SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reached AS (
    SELECT id, id AS other FROM classes UNION SELECT reached.id, links.b FROM reached JOIN links ON links.a = reached.other
), least AS (
    SELECT id, min(other) AS component_id FROM reached GROUP BY id
)
SELECT sets.doc_id, len(sets.s) AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id, coalesce(component_id, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN least USING (id)
"""
