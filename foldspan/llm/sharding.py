"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A row's place on the ring is the hash of its text, so that equal texts stay together as long as a shard has room. Each arc
between virtual nodes belongs to the shard of the node at its end. A shard takes the rows of its own arcs up to its load;
what overflows a full shard continues clockwise to the next node whose shard has room. Which rows overflow is decided by
counts of arc cells alone, a table whose size is set by the ring's parameters: the driver sees these counts, never rows.
Rows are numbered inside cells, and a cell holds a slice of an arc's places, in the order of places. A place with more
than HOT_SHARE of all rows, a text that many share, has cells of its own, one for each slice of its ids, so that many
tasks number them; they follow each other, so a full shard cuts through one text at most for each arc that overflows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldspan.llm.common import HOT_SHARE, written

NODES = 64
#: Slices of an arc by place, and of a hot place by id.
PLACES, SALTS = 8, 32
_BITS = 12


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes in ring order; places are below 2**63. More shards only add nodes."""
    place = lambda s, k: int.from_bytes(hashlib.blake2b(f"{s}/{k}".encode(), digest_size=8).digest(), "big") >> 1
    return sorted((place(s, k), s) for s in range(shards) for k in range(nodes))


def loads(rows: int, shards: int, spare: float = 0.0) -> list[int]:
    """Most rows of each shard. Without spare room they add up to all rows, so that counts are at most one apart."""
    if spare:
        return [-int(-rows * (1 + spare) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def flows(owners: list[int], counts: list[int], most: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, from, to, shard): which of an arc's rows, by rank, go where. Own arcs first, in ring order; then what is left
    of each arc walks clockwise."""
    room, out, left = list(most), [], []
    for arc, (shard, n) in enumerate(zip(owners, counts, strict=True)):
        take = min(n, room[shard])
        room[shard] -= take
        if take:
            out.append((arc, 0, take, shard))
        if take < n:
            left.append((arc, take, n))
    for arc, at, n in left:
        for k in range(1, len(owners) + 1):
            shard = owners[(arc + k) % len(owners)]
            take = min(n - at, room[shard])
            if take:
                out.append((arc, at, at + take, shard))
                at, room[shard] = at + take, room[shard] - take
            if at == n:
                break
    return out


def _arc(place: Column, cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds the arc of each place: nodes before it, counted from the first node of its 2**-12 of the ring."""
    found = rows.join(F.broadcast(cells), F.shiftrightunsigned(place, 63 - _BITS).cast("int") == F.col("__cell"))
    return found.withColumn("arc", F.col("__before") + F.size(F.filter("__marks", lambda m: m < place))).drop("__cell", "__before", "__marks")


def assigned(docs: DataFrame, shards: int = 8, spare: float = 0.0, nodes: int = NODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row; slot counts a shard's rows from 0 without gaps.

    Null texts count as empty. Null ids are placed by their text like others. Rows equal in id and text share a place and
    take neighbouring slots. Texts of any length count whole. An empty table gives an empty one. Other columns are ignored,
    whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("place"))
    marks = ring(shards, nodes)
    spark, width = docs.sparkSession, 1 << (63 - _BITS)
    inside: list[list[int]] = [[] for _ in range(1 << _BITS)]
    for place, _ in marks:
        inside[place // width].append(place)
    before, cells = 0, []
    for k, x in enumerate(inside):
        cells.append((k, before, x))
        before += len(x)
    cells = spark.createDataFrame(cells, "__cell int, __before int, __marks array<long>")
    rows = _arc(F.col("place"), cells, rows).withColumn("arc", F.pmod("arc", F.lit(len(marks))))
    rows = written(rows, "ring")
    total = rows.count()
    hot = written(rows.groupBy("place").count().filter(F.col("count") > max(SALTS, int(total * HOT_SHARE))).select("place", F.lit(True).alias("hot")), "hot")
    slice_ = F.pmod(F.xxhash64("place"), F.lit(PLACES)).cast("int").alias("part")
    heat = F.when(F.col("hot"), F.col("place")).otherwise(-1).alias("heat")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS))).otherwise(0).cast("int").alias("salt")
    rows = rows.join(F.broadcast(hot), "place", "left").select("doc_id", "size", "text_crc32", "place", "arc", slice_, heat, salt)
    cell = ["arc", "part", "heat", "salt"]
    counted = sorted((*(r[c] for c in cell), r["count"]) for r in rows.groupBy(*cell).count().collect())
    arcs, offsets = [0] * len(marks), []
    for arc, part, heat, salt, n in counted:
        offsets.append((arc, part, heat, salt, arcs[arc]))
        arcs[arc] += n
    filled, pieces = [0] * shards, []
    for arc, a, b, shard in flows([s for _, s in marks], arcs, loads(sum(arcs), shards, spare)):
        pieces.append((arc, a, b, shard, filled[shard] - a))
        filled[shard] += b - a
    order = Window.partitionBy(*cell).orderBy("place", "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1)
    offsets = spark.createDataFrame(offsets, "arc int, part int, heat long, salt int, offset long")
    pieces = spark.createDataFrame(pieces, "arc int, a long, b long, shard int, shift long").groupBy("arc").agg(F.collect_list(F.struct("a", "b", "shard", "shift")).alias("pieces"))
    ranked = ranked.join(F.broadcast(offsets), cell).withColumn("rank", F.col("rank") + F.col("offset"))
    found = ranked.join(F.broadcast(pieces), "arc").withColumn("piece", F.filter("pieces", lambda p: (p["a"] <= F.col("rank")) & (F.col("rank") < p["b"])).getItem(0))
    return found.select("doc_id", "size", "text_crc32", F.col("piece.shard").alias("shard"), (F.col("rank") + F.col("piece.shift")).alias("slot"))
