"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

A task splits its texts at white space, looks known chunks up, and hands the pieces it has not met to DuckDB: rows (word and
position in one key, token id) join the merge table, each word's leftmost pair of minimum rank is contracted, and the
recursion ends when no word changes. Decoding joins ids to the vocabulary and aggregates their bytes in order. What a task
remembers is bounded: two generations of dictionaries, the older of which is dropped. No row is shuffled; a lost executor
costs the rerun of its partitions only.

A long word would take a round of all its rows for each merge. Its rounds therefore contract every pair that is sure to be
contracted as it stands: one whose rank is the minimum, and leftmost, within twice the length of the longest token that
the word's bytes can make, since nothing farther away can reach it before; and all pairs of the word's minimum rank, left
to right, unless a token so made would at once make a pair of a lower rank. Rounds then depend on that length and not on
the word's.

A word of more than STRETCH bytes is contracted a stretch at a time, each of which begins at a token of the one before, a
good way from its end. Where both have a token in common, the earlier tokens of the one and the later ones of the other are
the word's: a list of tokens is an encoding if and only if each two neighbours are, since the first merge across a bound
would also happen between those two alone. So no query holds more rows than a stretch has bytes, whatever a word's length;
what long words are is not remembered.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspan.llm.common import KEPT, forget, returned, small_batches

#: Unicode white space, as the splitting pattern's \s has it.
_WS = "\t-\r \x85\xa0" + chr(0x1680) + chr(0x2000) + "-" + "".join(map(chr, (0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Chunks at whose ends every match of the splitting pattern also ends.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Patterns that begin so have letters with a space before them, if any, as one match.
_LETTERS = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+|"
#: Entries of one generation of a task's dictionaries.
CHUNKS, PIECES = 100_000, 200_000
#: DuckDB's memory in a task; it never writes to a local disk.
DUCKDB_MEMORY = "128MB"
#: Bytes of words handed to one recursive query, and ids to one decoding query; a word alone may have more bytes.
BYTES_A_QUERY, IDS_A_QUERY = 1 << 17, 1 << 18
#: Words of more bytes are encoded by LONG, of which so many bytes go to a query; words of more bytes than STRETCH a stretch
#: at a time, each of which begins OVERLAP bytes before the end of the one before.
LONG_WORD, LONG_A_QUERY, STRETCH, OVERLAP = 64, 1 << 16, 1 << 15, 1 << 11
#: Chunks and pieces of more characters are not remembered.
REMEMBERED_CHARS = 256
#: Rows that the rounds of one query of long words may pile up.
ROWS_A_QUERY = 500_000
#: Chunks of a text that are looked up at a time.
CHUNKS_AT_A_TIME = 1 << 16

ENCODE = """
WITH RECURSIVE step(k, id, done) AS (
    SELECT (w::BIGINT << 32) | p, id, false FROM tokens
    UNION ALL
    (WITH live AS (
        SELECT k, id FROM step WHERE NOT done
    ), pair AS (
        SELECT k, id, lead(id) OVER place AS next_id, lead(k) OVER place AS next_k FROM live WINDOW place AS (ORDER BY k)
    ), best AS (
        SELECT k >> 32 AS w, min((merged::BIGINT << 32) | (k & 4294967295)) AS pick, arg_min(next_k, (merged::BIGINT << 32) | (k & 4294967295)) AS gone
        FROM pair JOIN merges ON pair.id = merges.l AND pair.next_id = merges.r WHERE k >> 32 = next_k >> 32 GROUP BY 1
    )
    SELECT s.k, CASE WHEN s.k & 4294967295 = pick & 4294967295 THEN (pick >> 32)::INTEGER ELSE s.id END, best.w IS NULL
    FROM live s LEFT JOIN best ON s.k >> 32 = best.w WHERE best.w IS NULL OR s.k <> gone)
)
SELECT k >> 32 AS w, list(id ORDER BY k) AS ids FROM step WHERE done GROUP BY 1 ORDER BY 1
"""
LONG = """
WITH RECURSIVE step(k, id, round) AS (
    SELECT (w::BIGINT << 32) | p, id, 0 FROM tokens
    UNION ALL
    (WITH pair AS (
        SELECT k, k >> 32 AS w, id, round, lag(id) OVER place AS before_id, lead(id) OVER place AS next_id, lead(k) OVER place AS next_k,
            lead(id, 2) OVER place AS after_id, lead(k, 2) OVER place AS after_k, row_number() OVER place AS n
        FROM step WHERE round >= 0 AND round < {rounds} WINDOW place AS (ORDER BY k)
    ), ranked AS (
        SELECT pair.*, merged AS rank, min(merged) OVER (PARTITION BY w) AS least
        FROM pair LEFT JOIN merges ON id = merges.l AND next_id = merges.r AND w = next_k >> 32
    ), made AS (
        SELECT w, least, least AS l, after_id AS r FROM ranked WHERE rank = least AND w = after_k >> 32
        UNION SELECT w, least, before_id, least FROM ranked WHERE rank = least
        UNION SELECT w, least, least, least FROM ranked WHERE rank = least
    ), risky AS (
        SELECT DISTINCT w FROM made JOIN inverted USING (l, r) WHERE merged < least
    ), tied AS (
        SELECT ranked.*, rank = least AND risky.w IS NULL AS tie FROM ranked LEFT JOIN risky ON ranked.w = risky.w
    ), judged AS (
        SELECT k, id, round, least, rank,
            coalesce(rank < coalesce(min(rank) OVER (PARTITION BY w ORDER BY k ROWS BETWEEN {reach} PRECEDING AND 1 PRECEDING), 2147483647)
                AND rank <= coalesce(min(rank) OVER (PARTITION BY w ORDER BY k ROWS BETWEEN 1 FOLLOWING AND {reach} FOLLOWING), 2147483647), false)
            OR coalesce(tie AND (n - coalesce(max(CASE WHEN coalesce(tie, false) THEN 0 ELSE n END) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1, false) AS chosen
        FROM tied
    ), after AS (
        SELECT *, lag(chosen, 1, false) OVER (ORDER BY k) AS taken FROM judged
    )
    SELECT k, CASE WHEN chosen THEN rank ELSE id END, CASE WHEN least IS NULL THEN -1 ELSE round + 1 END FROM after WHERE NOT taken)
)
SELECT (k >> 32)::INTEGER AS w, (k & 4294967295)::INTEGER AS p, id, round < 0 AS done FROM step WHERE round < 0 OR round = {rounds} ORDER BY k
"""
DECODE = """
SELECT token FROM tokens JOIN vocabulary USING (id) ORDER BY (w::BIGINT << 32) | p
"""


class Remembered:
    """A dictionary of bounded size. Between batches a full generation becomes the old one, from which what is still used
    moves on."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """Keys to be added to new; the others are in it."""
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        lost = []
        for key in keys.difference(self.new):
            found = self.old.get(key)
            if found is None:
                lost.append(key)
            else:
                self.new[key] = found
        return lost


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """Tokens and ranks of a rank file."""
    with open(path, "rb") as file:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, filter(bytes.strip, file))]


def tables(ranks: list[tuple[bytes, int]]) -> tuple[pa.Table, pa.Table]:
    """The merge table (l, r, merged), every split of a token into two, and the vocabulary (id, token) by falling length."""
    known = dict(ranks)
    pairs = [(known[t[:k]], known[t[k:]], r) for t, r in ranks for k in range(1, len(t)) if t[:k] in known and t[k:] in known]
    merges = pa.table([pa.array(x, pa.int32()) for x in (zip(*pairs, strict=True) if pairs else ((), (), ()))], ["l", "r", "merged"])
    ordered = sorted(ranks, key=lambda x: (-len(x[0]), x[1]))
    return merges, pa.table([pa.array([r for _, r in ordered], pa.int32()), pa.array([t for t, _ in ordered], pa.binary())], ["id", "token"])


class Codec:
    """The merge table and vocabulary in a DuckDB connection, and what a task remembers."""

    def __init__(self, merges: pa.Table, vocabulary: pa.Table, pattern: str):
        import duckdb

        self.pattern, self.letters = regex.compile(pattern), pattern.startswith(_LETTERS)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
        self._table("merges", merges)
        self.db.execute("CREATE TABLE inverted AS SELECT * FROM merges WHERE merged < greatest(l, r)")
        self._table("vocabulary", vocabulary)
        self.vocabulary, self.byte_id = vocabulary.column("token"), np.full(256, -1, np.int32)
        for token, r in zip(vocabulary.column("token")[-256:].to_pylist(), vocabulary.column("id")[-256:].to_pylist(), strict=True):
            if len(token) == 1:
                self.byte_id[token[0]] = r
        self.lengths = np.zeros(1 + max(vocabulary.column("id").to_pylist(), default=0), np.int64)
        self.lengths[vocabulary.column("id").to_numpy()] = pc.binary_length(vocabulary.column("token")).to_numpy()
        self.chunks, self.pieces = Remembered(CHUNKS), Remembered(PIECES)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("source", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM source")
        self.db.unregister("source")

    def _query(self, w: np.ndarray, p: np.ndarray, ids: np.ndarray, sql: str) -> pa.Table:
        self.db.register("tokens", pa.table({"w": w.astype(np.int32), "p": p.astype(np.int32), "id": ids.astype(np.int32)}))
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister("tokens")

    def _long(self, raw: list[bytes]) -> list[bytes]:
        """Ids of each of a few long words; queries run until each word is done."""
        present = set().union(*raw)
        reach = 2 * next((len(t) for t in (x.as_py() for x in self.vocabulary) if present.issuperset(t)), 1)
        w, p = _places(np.array([len(x) for x in raw]))
        ids, out = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)], [b""] * len(raw)
        while len(w):
            rounds = max(1, min(32, ROWS_A_QUERY // len(w)))
            found = self._query(w, p, ids, LONG.format(rounds=rounds, reach=reach))
            w, p, ids, done = (found.column(c).to_numpy() for c in ("w", "p", "id", "done"))
            ready, whole = w[done], ids[done].astype("<u4")
            for k, a, b in zip(*np.unique(ready, return_index=True), np.append(np.flatnonzero(np.diff(ready)) + 1, len(ready)), strict=True) if len(ready) else ():
                out[k] = whole[a:b].tobytes()
            w, p, ids = w[~done], p[~done], ids[~done]
        return out

    def _stretched(self, word: bytes, size: int = STRETCH, overlap: int = OVERLAP) -> bytes:
        """Ids of one very long word."""
        ids, out, start = np.frombuffer(self._long([word[:size]])[0], "<u4"), [], 0
        while start + (ends := np.cumsum(self.lengths[ids]))[-1] < len(word):
            ends = ends + start
            begins = ends - self.lengths[ids]
            k = int(np.searchsorted(begins, ends[-1] - overlap))
            after = np.frombuffer(self._long([word[begins[k] : begins[k] + size]])[0], "<u4")
            places = begins[k] + np.cumsum(self.lengths[after]) - self.lengths[after]
            _, a, b = np.intersect1d(begins[k:], places, assume_unique=True, return_indices=True)
            met = np.flatnonzero(ids[k:][a] == after[b])
            if not len(met):  # begin farther back, and where that is no way on, take more at a time
                size, overlap = (2 * size, overlap) if k == 0 or 4 * overlap > size else (size, 2 * overlap)
                if k == 0:
                    ids = np.frombuffer(self._long([word[start : start + size]])[0], "<u4")
                continue
            a, b = k + int(a[met[0]]), int(b[met[0]])
            out.append(ids[:a])
            ids, start = after[b:], int(places[b])
        return np.concatenate([*out, ids]).astype("<u4").tobytes()

    def _short(self, raw: list[bytes]) -> list[bytes]:
        found = self._query(*_places(np.array([len(x) for x in raw])), self.byte_id[np.frombuffer(b"".join(raw), np.uint8)], ENCODE)
        lists = found.column("ids").combine_chunks()
        flat, at = np.asarray(lists.flatten(), np.uint32).astype("<u4").tobytes(), np.asarray(lists.offsets) * 4
        at = at - at[0]
        return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _merged(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        found, raw = {}, [w.encode() for w in words]
        for least, most, contract, size in ((0, LONG_WORD, self._short, BYTES_A_QUERY), (LONG_WORD, STRETCH, self._long, LONG_A_QUERY)):
            some = [k for k, x in enumerate(raw) if least < len(x) <= most]
            for part in _runs([len(raw[k]) for k in some], size):
                found.update(zip((words[k] for k in some[part]), contract([raw[k] for k in some[part]]), strict=True))
        return found | {words[k]: self._stretched(x) for k, x in enumerate(raw) if len(x) > STRETCH}

    def _split(self, chunk: str) -> list[str]:
        """The pattern's matches in a chunk; a chunk of letters alone is one, which is quick to see."""
        return [chunk] if self.letters and (chunk.isalpha() or chunk[:1] == " " and chunk[1:].isalpha()) else self.pattern.findall(chunk)

    def _encoded(self, split: list[list[str]]) -> list[bytes]:
        split_up = self._split
        new = {c: split_up(c) for c in self.chunks.missing(set().union(*split))}
        pieces = self.pieces.missing(set().union(*new.values()))
        known = self.pieces.new
        known.update(self._merged(pieces))
        found = self.chunks.new
        for c, x in new.items():
            found[c] = known[x[0]] if len(x) == 1 else b"".join([known[p] for p in x])
        out = [b"".join(map(found.__getitem__, x)) for x in split]
        for held, keys in ((found, new), (known, pieces)):
            for key in keys:
                if len(key) > REMEMBERED_CHARS:
                    del held[key]
        return out

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text. A long text is looked up a part at a time."""
        out, split = [], []
        for text in texts:
            if len(text) < CHUNKS_AT_A_TIME:
                split.append(_CHUNK.findall(text))
                continue
            out += self._encoded(split)
            split, chunks, parts = [], (m[0] for m in _CHUNK.finditer(text)), []
            while part := list(islice(chunks, CHUNKS_AT_A_TIME)):
                parts += self._encoded([part])
            out.append(b"".join(parts))
        return out + self._encoded(split)

    def decode(self, encoded: Iterable[bytes]) -> list[bytes]:
        """Bytes of each row of ids. Rows of many ids are decoded a part at a time."""
        encoded = list(encoded)
        parts = [(k, x[a : a + 4 * IDS_A_QUERY]) for k, x in enumerate(encoded) for a in range(0, max(1, len(x)), 4 * IDS_A_QUERY)]
        decoded: list[list[bytes]] = [[] for _ in encoded]
        for run in _runs([len(x) // 4 for _, x in parts], IDS_A_QUERY):
            some, sizes = parts[run], np.array([len(x) // 4 for _, x in parts[run]])
            found = self._query(*_places(sizes), np.frombuffer(b"".join(x for _, x in some), "<u4"), DECODE).column("token").cast(pa.large_binary()).combine_chunks()
            # the tokens lie one after the other, so a row's bytes are a stretch of the column's
            _, offsets, data = found.buffers() if len(found) else (None, None, None)
            at = np.frombuffer(offsets, np.int64, len(found) + 1, 8 * found.offset)[np.append(0, np.cumsum(sizes))].tolist() if len(found) else [0] * (len(some) + 1)
            raw = memoryview(data) if data is not None else b""
            for (k, _), i, j in zip(some, at[:-1], at[1:], strict=True):
                decoded[k].append(bytes(raw[i:j]))
        return [b"".join(x) for x in decoded]


def _places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the word and place in it of each row of words of these lengths."""
    ends = np.cumsum(lengths)
    return np.repeat(np.arange(len(lengths)), lengths), np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _runs(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of entries of about `most` in sum, one entry at least."""
    a, total = 0, 0
    for k, n in enumerate(sizes):
        if k > a and total + n > most:
            yield slice(a, k)
            a, total = k, 0
        total += n
    if a < len(sizes):
        yield slice(a, len(sizes))


def _codec(shared, *key: str) -> Codec:
    """One codec for a vocabulary path and pattern in a Python worker, which serves many tasks."""
    if key not in KEPT:
        forget()
        KEPT[key] = Codec(*shared.value, key[-1])
    return KEPT[key]


def _shared(docs: DataFrame, path: str):
    """The tables of the ranks, made on the driver; a vocabulary file is of fixed size."""
    small_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(tables(read_ranks(path)))


def _parts(batch: pa.RecordBatch, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes of its second column, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64)
    group = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids are little-endian unsigned 32-bit integers in a binary column. Null texts are empty:
    no tokens. Ids may be null or repeat; each row is encoded by itself. Special tokens are ordinary text. Texts and unbroken
    words of any length are encoded whole, in bounded memory; time grows in proportion. An empty table gives an empty one.
    Other columns are ignored, whatever their names."""
    shared = _shared(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, ranks_path, pattern)
        for batch in batches:
            for part in returned(_parts(batch)):
                ids = codec.encode([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) with its decoded bytes. Null ids decode to no bytes; lists of any length are decoded a
    part at a time. An empty table gives an empty one; other columns are ignored, whatever their names."""
    shared = _shared(encoded, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, ranks_path, pattern)
        for batch in batches:
            for part in returned(_parts(batch)):
                decoded = codec.decode([x or b"" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(decoded, pa.binary())], ["doc_id", "ids", "n_tokens", "decoded"])

    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text and decodes its ids, in one pass and one Python worker a task: (doc_id, ids, n_tokens, decoded). Odd
    rows and tables as for encode."""
    shared = _shared(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, ranks_path, pattern)
        for batch in batches:
            for part in returned(_parts(batch)):
                ids = codec.encode([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(codec.decode(ids), pa.binary())], ["doc_id", "ids", "n_tokens", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded binary")
