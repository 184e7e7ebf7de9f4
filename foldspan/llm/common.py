"""What the text operators share: scratch tables, checked broadcasts, and array-wise tokenising of Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only while its rows take at most so many bytes; beyond that a shuffled join is used.
BROADCAST_BYTES = 32 << 20
#: What a row takes in a broadcast table besides its columns, and the bytes of a column by type.
_ROW, _WIDTHS = 16, {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "date": 4, "long": 8, "float": 4, "double": 8, "timestamp": 8}
#: A key is hot if it has more than this share of all rows, so that there are at most 1 / HOT_SHARE hot keys, and more than
#: so many rows.
HOT_SHARE, HOT_ROWS = 1e-4, 100_000
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20
#: Bytes of text that are tokenised, and hashed, at a time.
BLOCK_BYTES, HASH_BYTES = 1 << 18, 1 << 16


@lru_cache(maxsize=1)
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="spark-scratch-")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where none is set: a temporary one on a single machine (tests), else a
    folder in the warehouse, which executors share too."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    return _temporary() if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local" else f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES between the JVM and Python, instead of a number of rows whatever their length. A
    limit that the session has set itself stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # the default
        spark.conf.set(name, BATCH_BYTES)


def written(df: DataFrame, label: str) -> DataFrame:
    """df, stored as a table in the shared folder and read again: lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, a written table of fixed-width columns, with a broadcast hint if its rows take at most limit bytes. The rows are
    counted here, from the footers of the table's files. Columns without a fixed width raise a KeyError."""
    width = _ROW + sum(_WIDTHS[f.dataType.typeName()] for f in df.schema)
    return F.broadcast(df) if df.count() * width <= limit else df


def joined_hot(rows: DataFrame, table: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """rows joined with a written table of unique keys that has the number n of rows of each key; total is that of all rows.
    Rows of hot keys meet their few table rows by broadcast, at most 1 / HOT_SHARE of them; only the others are shuffled,
    so that no task gets more than that share by a key. Both ways give the same rows."""
    hot = F.col(n) > max(HOT_ROWS, int(total * HOT_SHARE))
    few = F.broadcast(table.filter(hot))
    cold = rows.join(few.select(key), key, "left_anti").join(table.filter(~hot), key)
    return rows.join(few, key).unionByName(cold)


def sample(rows: DataFrame, most: int) -> DataFrame:
    """rows, a written table, if there are at most `most`; else about so many, each drawn by its own hash, so that the same
    rows are drawn however the table is cut into files."""
    count = rows.count()
    return rows if count <= most else rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30)) < int(most / count * (1 << 30)))


def agreed_labels(labels: DataFrame, label: str, learns: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of each id that labels mark 0 or 1 and always alike, written. Rows without an id or label, with another value,
    or for which learns does not hold teach nothing; nor do ids with both labels."""
    known = labels.filter(F.col(label).cast("int").isin(0, 1) & F.col(id_col).isNotNull())
    known = known.filter(learns) if learns is not None else known
    one = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label).cast("int")).alias("y"), F.max(F.col(label).cast("int")).alias("z"))
    return written(one.filter("y = z").select("id", "y"), "labels")


def crc_bucket(column: str, buckets: int) -> Column:
    """crc32 of a key written as text, modulo buckets."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(buckets))


#: What a Python worker keeps from task to task of one kind, such as an open encoder; tasks of other kinds drop it.
KEPT: dict = {}


def trim() -> None:
    """Gives memory that nothing uses back to the system; otherwise a worker stays as large as it ever was, also where other
    tasks' workers need the room."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def forget() -> None:
    """Drops what tasks of another kind have kept."""
    if KEPT:
        KEPT.clear()
        trim()


def returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches; what handling them has left unused is given back after every eighth, and at the end."""
    for k, batch in enumerate(batches):
        yield batch
        if k % 8 == 7:
            trim()
    trim()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in slices of so many rows, so that what is made of them stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of an Arrow column, and the offsets where each begins. Nulls count as empty."""
    forget()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


#: 1 for the white space that parts words: space and the control characters 9 to 13.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RNG = np.random.default_rng(20240917)
#: A random value for each byte and a random odd multiplier: the polynomial hash of a word.
_BYTE = np.where(_SPACE, np.uint64(0), _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
_LOWERED = _BYTE[_LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(HASH_BYTES, _STEP, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises a 64-bit hash: each input bit reaches each output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about `most` bytes, at least one document each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, and for each document the number of its first word (one more at the end)."""
    solid = ~_SPACE[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    bounds = offsets[(offsets > 0) & (offsets < len(raw))]
    first[bounds] = solid[bounds]
    last[bounds - 1] = solid[bounds - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, of its lower-cased (A-Z) bytes by default. Words are in text order and do not overlap;
    white space between them weighs nothing, so that bytes are hashed where they lie, HASH_BYTES at a time."""
    table, out, i = _LOWERED if lower else _BYTE, np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(starts, base + HASH_BYTES // 2))
        if ends[j - 1] - base > HASH_BYTES and j - i > 1:
            j -= 1
        part, at = raw[base : ends[j - 1]], starts[i:j] - base
        if len(part) <= HASH_BYTES:
            place = np.arange(len(part)) - np.repeat(at, np.diff(at, append=len(part)))
            sums = np.add.reduceat(table[part] * _POWERS[place], at)
        else:  # one long word
            sums, scale = np.zeros(1, np.uint64), np.ones(1, np.uint64)
            for k in range(0, len(part), HASH_BYTES):
                some = table[part[k : k + HASH_BYTES]]
                sums += scale * (some * _POWERS[: len(some)]).sum(dtype=np.uint64)
                scale *= _POWERS[HASH_BYTES - 1 :]
        out[i:j] = mix(sums + (ends[i:j] - starts[i:j]).astype(np.uint64))
        i = j
    return out


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in a row; element i covers words i to i + n - 1."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = mix((out ^ hashes[k : k + m]) * _STEP + np.uint64(k + 1))
    return out


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As words(), but a token is a run of letters, digits and bytes over 127, or a run of other visible characters."""
    kind = _KIND[raw]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[(offsets > 0) & (offsets < len(raw))]] = True
    cuts = np.append(np.flatnonzero(new), len(raw)) if len(raw) else np.zeros(1, np.int64)
    solid = kind[cuts[:-1]] > 0 if len(raw) else np.zeros(0, bool)
    starts, ends = cuts[:-1][solid], cuts[1:][solid]
    return starts, ends, np.searchsorted(starts, offsets)


_KIND = np.full(256, 2, np.uint8)
_KIND[_SPACE] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def spans(column: pa.Array, split=words) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a text column: first and last row, bytes, token starts and ends, and each row's first token."""
    raw, offsets = utf8(column)
    for i, j in blocks(offsets):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield i, j, part, *split(part, at)


def summed(parts: DataFrame, key: str, value: str, merge_rows: int = 16) -> DataFrame:
    """Sums binary float32 vectors by an integer key in two steps of streaming tasks; holds one vector for each key of a
    partition, however many rows there are. Rows come back once for each key and first-step task, at most merge_rows a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(x.as_buffer(), np.float32)
                total[k] = total[k] + v if k in total else v.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["k", "v"])

    slim = parts.select(F.col(key).cast("int").alias("k"), F.col(value).alias("v"))
    return slim.repartition(merge_rows).mapInArrow(run, "k int, v binary")


def gathered(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of summed() on the driver: merge_rows vectors for each key, a bound set by parameters."""
    total: dict[int, np.ndarray] = {}
    for k, v in parts.toLocalIterator():
        x = np.frombuffer(bytes(v), np.float32).astype(np.float64)
        total[k] = total[k] + x if k in total else x
    return total
