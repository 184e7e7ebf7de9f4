"""Benchmark decontamination: n-gram seeds join training passages to test items, and Smith-Waterman alignment scores
edited copies.

Benchmarks are handled in blocks of at most SEEDS_A_BLOCK seeds, so what is broadcast has a set bound and a larger
benchmark means more passes, not larger ones. A block takes one pass over the documents. Each place where a seed stands
gives a window, however frequent the seed is; a window is aligned if it holds so many of the item's words that it can
reach the least score, so a phrase like "of the" costs no alignment and whether a copy is found depends on itself only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspan.llm.common import blocks, ngram_hashes, runs, sliced, small_batches, utf8, word_hashes, written

SEED = 3
SEEDS_A_BLOCK = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of the score of an unchanged copy, and least matched words, of a contaminated passage.
LEAST, LEAST_WORDS = 0.5, 5
#: Words of items and of passages that are compared at a time.
_CELLS = 1_000_000


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its row, lower-cased bytes, and hashes, starts and ends of its words; symbols are no words."""
    raw, offsets = utf8(pc.utf8_lower(column))
    for i, j in blocks(offsets):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = runs(part, at)
        head = part[starts] if len(starts) else np.zeros(0, np.uint8)
        word = (head >= 0x80) | ((head >= 0x30) & (head < 0x3A)) | ((head >= 0x61) & (head < 0x7B))
        first = np.concatenate([[0], np.cumsum(word)])[first]
        starts, ends = starts[word], ends[word]
        hashes = word_hashes(part, starts, ends, lower=False)
        for k in range(j - i):
            a, b = first[k], first[k + 1]
            yield i + k, part[at[k] : at[k + 1]], hashes[a:b], starts[a:b] - at[k], ends[a:b] - at[k]


def _seeds(hashes: np.ndarray) -> np.ndarray:
    """Seeds of an item, by place; an item of fewer words is one seed."""
    return ngram_hashes(hashes, min(SEED, max(1, len(hashes))))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words, seeds): hashes of each item's words as bytes, and of its seeds. Items without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words, seeds = [], [], []
            for row, _, hashes, _, _ in _tokens(batch.column(1)):
                if len(hashes):
                    rows.append(row)
                    words.append(hashes.tobytes())
                    seeds.append(_seeds(hashes).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(words, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))], ["item_id", "words", "seeds"])

    return benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "item_id long, words binary, seeds array<long>")


def _parts(sizes: np.ndarray, most: int = _CELLS) -> Iterator[slice]:
    """Runs of entries whose sizes sum to about most, at least one entry each."""
    sums, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + most, "right")))
        yield slice(i, j)
        i = j


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry number of each element of ranges of sizes that begin at starts, and the elements."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]


class _Index:
    """Items of a block by seed: for each of the sorted seeds the places (item, q) where it stands, and all items' words."""

    def __init__(self, ids: list[int], words: list[bytes], seeds: list[np.ndarray]):
        self.ids = ids
        self.words = np.frombuffer(b"".join(words), np.uint64)
        self.lengths = np.array([len(w) // 8 for w in words], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.widths = sorted({SEED, *(int(n) for n in self.lengths if n < SEED)})
        flat = np.concatenate(seeds).view(np.uint64)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.firsts, self.counts = np.unique(flat[order], return_index=True, return_counts=True)
        item, q = _expanded(np.zeros(len(seeds), np.int64), np.array([len(x) for x in seeds], np.int64))
        self.items, self.q = item[order], q[order]

    def windows(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, lo, hi): parts of a document's words around places with a seed of the item, without those that hold too
        few of the item's words for an alignment that counts."""
        hits, places = [], []
        for n in self.widths:
            grams = ngram_hashes(hashes, n)
            at = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
            places.append(np.flatnonzero(self.seeds[at] == grams))
            hits.append(at[places[-1]])
        hit, place = np.concatenate(hits), np.concatenate(places)
        if not len(hit):
            return
        known, number = np.unique(hashes, return_inverse=True)
        span = len(hashes) + 1
        stands = np.sort(number * span + np.arange(len(hashes)))
        for part in _parts(self.counts[hit]):
            owner, entry = _expanded(self.firsts[hit[part]], self.counts[hit[part]])
            item, begins = self.items[entry], place[part][owner] - self.q[entry]
            slack = np.maximum(8, self.lengths[item] // 2)
            cell = begins // (self.lengths[item] + slack)
            order = np.lexsort((begins, cell, item))
            item, begins, cell, slack = item[order], begins[order], cell[order], slack[order]
            first = np.append(True, (item[1:] != item[:-1]) | (cell[1:] != cell[:-1]))
            last = np.append(first[1:], True)
            lo, item = np.maximum(0, begins[first] - slack[first]), item[first]
            hi = np.minimum(len(hashes), begins[last] + self.lengths[item] + slack[last])
            for some in _parts(self.lengths[item]):
                size = self.lengths[item[some]]
                owner, entry = _expanded(self.offsets[item[some]], size)
                at = np.minimum(np.searchsorted(known, self.words[entry]), len(known) - 1)
                after = np.searchsorted(stands, at * span + lo[some][owner])
                held = (known[at] == self.words[entry]) & (after < len(stands))
                held &= stands[np.minimum(after, len(stands) - 1)] < at * span + hi[some][owner]
                least = np.maximum(np.ceil(LEAST * size), np.minimum(LEAST_WORDS, size))
                for k in np.flatnonzero(np.bincount(owner, held, len(size)) >= least) + some.start:
                    yield int(item[k]), int(lo[k]), int(hi[k])


def smith_waterman(item: np.ndarray, passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local score of item against each passage, with the ends (exclusive) of the alignment in item and passage.
    All passages advance together, one word of the item at a time; a gap's row is a running maximum."""
    width = max(len(p) for p in passages)
    grid = np.zeros((len(passages), width), np.uint64)
    real = np.zeros((len(passages), width), bool)
    for k, p in enumerate(passages):
        grid[k, : len(p)], real[k, : len(p)] = p, True
    slope = -GAP * np.arange(1, width + 1, dtype=np.int32)
    last = np.zeros((len(passages), width + 1), np.int32)
    best, row, column = (np.zeros(len(passages), np.int64) for _ in range(3))
    for i, w in enumerate(item):
        step = np.where((grid == w) & real, MATCH, MISMATCH)
        now = np.maximum(np.maximum(last[:, :-1] + step, last[:, 1:] + GAP), 0)
        now = np.maximum.accumulate(now + slope, 1) - slope
        now[~real] = 0
        last[:, 1:] = now
        top = now.argmax(1)
        value = now[np.arange(len(top)), top]
        better = value > best
        best[better], row[better], column[better] = value[better], i + 1, top[better] + 1
    return best, row, column


def aligned(item: np.ndarray, passages: list[np.ndarray]) -> Iterator[tuple[int, float, int, int]]:
    """(passage number, share of the score of an unchanged copy, start, end) of each passage whose alignment counts. Matched
    words are at least half the score."""
    for part in _parts(np.array([len(p) for p in passages])):
        some = passages[part]
        best, row, column = smith_waterman(item, some)
        enough = (best >= LEAST * MATCH * len(item)) & ((best + MATCH - 1) // MATCH >= min(LEAST_WORDS, len(item)))
        for k in np.flatnonzero(enough):
            back = smith_waterman(item[: row[k]][::-1], [some[k][: column[k]][::-1]])
            yield part.start + int(k), float(best[k]) / (MATCH * len(item)), int(column[k] - back[2][0]), int(column[k])


def _found(index: _Index, hashes: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
    """(item_id, share, start, end), in words, of the alignments of a document's words with the items of index."""
    for number, group in groupby(index.windows(hashes), lambda w: w[0]):
        spans = [(lo, hi) for _, lo, hi in group]
        offset, size = index.offsets[number], index.lengths[number]
        for k, share, a, b in aligned(index.words[offset : offset + size], [hashes[lo:hi] for lo, hi in spans]):
            yield index.ids[number], share, spans[k][0] + a, spans[k][0] + b


_SCHEMA = "doc_id long, item_id long, score double, first_word long, end_word long, start long, end long"


def _aligned_docs(docs: DataFrame, shared) -> DataFrame:
    """The best alignment of each item of a broadcast index with each document (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out, ids = [], batch.column(0).to_pylist()
            for k, raw, hashes, starts, ends in _tokens(batch.column(1)):
                best: dict[int, tuple] = {}
                for item_id, share, a, b in _found(shared.value, hashes):
                    best[item_id] = max(best.get(item_id, (0.0,)), (share, -a, b))
                for item_id, (share, a, b) in best.items():
                    chars = [len(raw[:at].tobytes().decode()) for at in (int(starts[-a]), int(ends[b - 1]))]
                    out.append((ids[k], item_id, share, -a, b, *chars))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "score", "first_word", "end_word", "start", "end"])

    return docs.mapInArrow(run, _SCHEMA)


def _indexes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[_Index]:
    """The items of benchmark in blocks of about SEEDS_A_BLOCK seeds, one at a time on the driver."""
    small_batches(benchmark.sparkSession)
    items = written(_items(benchmark.filter(F.col(id_col).isNotNull()), id_col, text_col), "items")
    total = items.agg(F.sum(F.size("seeds"))).first()[0] or 0
    blocks_ = -(-total // SEEDS_A_BLOCK)
    for k in range(blocks_):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks_)) == k).toArrow()
        if rows.num_rows:
            words, seeds = rows.column("words").combine_chunks(), rows.column("seeds").combine_chunks()
            yield _Index(rows.column("item_id").to_pylist(), [w.as_buffer().to_pybytes() for w in words], [np.asarray(x.values) for x in seeds])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The best alignment of each document with each test item that reaches LEAST: (doc_id, item_id, score, first_word,
    end_word, start, end); start and end are characters of the text. Null and empty texts, texts without words and null
    ids align with nothing; equal rows give one result; rows that repeat an id with other texts give one each; a document
    may copy many items, and an item may stand in any number of documents. An item of one or two words must stand in
    full; items without an id or words are left out. Texts of any length are searched whole. Without documents or items
    there are no rows. Other columns are ignored."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    out, last, context = docs.sparkSession.createDataFrame([], _SCHEMA), None, docs.sparkSession.sparkContext
    for index in _indexes(benchmark, item_col, item_text_col):
        if last is not None:  # a block that is not the only one is searched and let go before the next is made
            out = out.unionByName(written(_aligned_docs(slim, last).distinct(), "aligned"))
            last.unpersist()
        last = context.broadcast(index)
    return out if last is None else out.unionByName(_aligned_docs(slim, last).distinct())


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs, with all their columns, but without rows that hold a passage of benchmark. Each row is judged by its own text,
    whether its id is null or repeated, in the pass that carries it through: nothing is joined back."""
    names, last = [F.col(f"`{c}`") for c in docs.columns], None
    for index in _indexes(benchmark, item_col, item_text_col):
        if last is not None:
            docs = written(docs, "clean")
            last.unpersist()
        last = shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                clean = np.ones(batch.num_rows, bool)
                for k, _, hashes, _, _ in _tokens(batch.column(batch.num_columns - 1)):
                    clean[k] = next(_found(shared.value, hashes), None) is None
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(clean))

        docs = docs.select(*names, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, docs.schema)
    return docs
