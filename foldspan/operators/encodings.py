"""Sequence encodings: one-hot as sparse vectors, property scales as dense ones, and feature matrices of base and mutant."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspan.schemas import ALPHABET, AMINO_ACIDS

#: Blocks of positions that are made at a time.
BLOCKS_A_BATCH = 1024
SPARSE = "struct<size: int, indices: array<int>, values: array<float>>"


def max_length(df: DataFrame, seq: str = "seq", given: int | None = None) -> int:
    """The given length, or that of the longest sequence."""
    return given if given is not None else (df.agg(F.max(F.length(seq))).first()[0] or 0)


def _letters(seq: Column, n: int) -> Column:
    return F.split(F.left(F.upper(seq), F.lit(n)), "")


def one_hot(seq: Column, n: int) -> Column:
    """Sparse vector of n x 20 places: upper-cased, cut or padded to n; unknown letters are all zeros."""
    place = F.transform(_letters(seq, n), lambda c, i: F.when((c != "") & F.contains(F.lit(ALPHABET), c), i * len(ALPHABET) + F.instr(F.lit(ALPHABET), c) - 1).cast("int"))
    kept = F.array_compact(place)
    return F.struct(F.lit(n * len(ALPHABET)).alias("size"), kept.alias("indices"), F.array_repeat(F.lit(1.0).cast("float"), F.size(kept)).alias("values"))


def scaled(seq: Column, n: int, scales: dict[str, list[float]]) -> Column:
    """Dense vector of n x scales: each residue's property scales (such as the nineteen of Georgiev), zeros for unknown
    letters and padding. scales is a parameter, read from wherever the published table is kept."""
    width = len(next(iter(scales.values())))
    zeros = F.array(*[F.lit(0.0).cast("float")] * width)
    table = F.create_map(*(x for a, v in scales.items() for x in (F.lit(a), F.array(*(F.lit(float(y)).cast("float") for y in v)))))
    padded = F.slice(F.concat(F.transform(_letters(seq, n), lambda c: F.coalesce(F.element_at(table, c), zeros)), F.array_repeat(zeros, n)), 1, n)
    return F.flatten(padded)


def read_scales(spark: SparkSession, path: str) -> dict[str, list[float]]:
    """Property scales by residue letter from a CSV with a header, the letter first: at most one row a letter of the alphabet."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path).limit(len(ALPHABET) + 1).collect()
    found = {str(r[0]).strip().upper(): [float(x) for x in r[1:]] for r in rows}
    if len(found) != len(rows) or not set(found) <= set(ALPHABET):
        raise ValueError(f"{path}: one row for each residue letter is expected")
    return found


def scaled_blocks(df: DataFrame, key: str, scales: dict[str, list[float]], seq: str = "seq", n: int | None = None, width: int = 64) -> DataFrame:
    """(key, block, values): a sequence's property scales, width positions to a row, zeros for unknown letters. Together the
    blocks are scaled()'s vector without the padding of whole blocks: a row has at most width x scales values however long
    the longest sequence is, and short sequences have few rows. n cuts sequences; an empty one has no rows. Letters are looked
    up in arrays, a batch of blocks at a time, and each sequence is gone through once."""
    text = F.upper(F.col(seq)) if n is None else F.left(F.upper(F.col(seq)), F.lit(n))
    size = len(next(iter(scales.values())))
    table = np.zeros((129, size), np.float32)
    for letter, values in scales.items():
        table[ord(letter)] = values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                letters = np.frombuffer(batch.column(1)[row].as_py().encode("utf-32-le"), "<u4")
                for at in range(0, len(letters), width * BLOCKS_A_BATCH):  # a sequence of any length in parts
                    part = letters[at : at + width * BLOCKS_A_BATCH]
                    blocks = -(-len(part) // width)
                    values = np.zeros((blocks * width, size), np.float32)
                    values[: len(part)] = table[np.minimum(part, 128)]
                    yield batch.slice(row, 1).column(0).take(pa.array(np.zeros(blocks, np.int64))), at // width, values

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, rows, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            flat = np.concatenate(rows).ravel()
            offsets = np.arange(0, len(flat) + 1, width * size, dtype=np.int32)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(np.concatenate(numbers)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "block", "values"])

        for k, first, values in run(batches):
            keys.append(k), numbers.append(np.arange(first, first + len(k), dtype=np.int32)), rows.append(values)
            held += len(k)
            if held >= BLOCKS_A_BATCH:
                yield out()
                keys, numbers, rows, held = [], [], [], 0
        if held:
            yield out()

    parts = df.select(key, text.alias("_s")).filter(F.length("_s") > 0)
    kind = parts.schema[key].dataType.simpleString()
    return parts.mapInArrow(packed, f"`{key}` {kind}, block int, values array<float>")


def block_matrix(df: DataFrame, key: str, scales: dict[str, list[float]], base: str | None = None, seq: str = "seq", width: int = 64) -> DataFrame:
    """(key, side, block, values): dense features of mutants, or of base and mutant, in blocks of positions. A side's blocks
    stand for its own positions, so neither is padded to the other."""
    sides = [("mutant", seq)] if base is None else [("base", base), ("mutant", seq)]
    parts = [scaled_blocks(df, key, scales, c, width=width).select(key, F.lit(name).alias("side"), "block", "values") for name, c in sides]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def encode(df: DataFrame, name: str, seq: str = "seq", n: int | None = None, scales: dict | None = None) -> DataFrame:
    """df with its sequences encoded by name; an unknown name raises."""
    known = {"one_hot": lambda c, m: one_hot(c, m), "georgiev": lambda c, m: scaled(c, m, scales or {})}
    if name not in known:
        raise ValueError(f"unknown encoding {name!r}; known: {sorted(known)}")
    return df.withColumn("encoding", known[name](F.col(seq), max_length(df, seq, n)))


def feature_matrix(df: DataFrame, base: str | None = None, seq: str = "seq", n: int | None = None) -> DataFrame:
    """Flat one-hot features of mutants, or of base beside mutant; each side is padded to its own longest sequence."""
    mutant = one_hot(F.col(seq), max_length(df, seq, n))
    if base is None:
        return df.withColumn("features", mutant)
    left = one_hot(F.col(base), max_length(df, base, n))
    both = df.withColumns({"__a": left, "__b": mutant})
    joined = F.struct((F.col("__a.size") + F.col("__b.size")).alias("size"), F.concat("__a.indices", F.transform("__b.indices", lambda i: i + F.col("__a.size"))).alias("indices"), F.concat("__a.values", "__b.values").alias("values"))
    return both.withColumn("features", joined).drop("__a", "__b")


def composition(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Shares of polarity groups and mean hydropathy of each sequence's known residues, a row a sequence that has some. Letters
    are counted in the row, so nothing is shuffled."""
    known = df.select(key, F.upper(seq).alias("__seq")).filter(F.col("__seq").rlike(f"[{ALPHABET}]"))
    count = lambda a: F.length("__seq") - F.length(F.replace("__seq", F.lit(a), F.lit("")))
    counted = known.select(key, F.array(*map(count, map(F.lit, AMINO_ACIDS))).alias("__n"))
    total = lambda weights: F.aggregate(F.zip_with("__n", F.array(*(F.lit(float(w)) for w in weights)), lambda n, w: n * w), F.lit(0.0), lambda s, x: s + x)
    sums = {"residues": total([1] * len(AMINO_ACIDS)), "kd_mean": total([v[2] for v in AMINO_ACIDS.values()])}
    sums |= {n: total([v[1] == g for v in AMINO_ACIDS.values()]) for g, n in (("np", "nonpolar"), ("p~", "neutral"), ("p+", "basic"), ("p-", "acidic"))}
    rows = counted.select(key, *(c.alias(n) for n, c in sums.items()))
    return rows.select(key, F.col("residues").cast("long").alias("residues"), *((F.col(n) / F.col("residues")).alias(n) for n in sums if n != "residues"))
