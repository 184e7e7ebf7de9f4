"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspan.llm.common import joined_hot, written


def _large(edges: DataFrame, total: int) -> DataFrame:
    """Each vertex links its larger neighbours to its smallest neighbour (or itself). total is the number of edges."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
    return joined_hot(edges.filter("b > a"), least, "a", total).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small(edges: DataFrame, total: int) -> DataFrame:
    """Each vertex links itself and its smaller neighbours to the smallest of these. edges have a < b."""
    least = written(edges.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n")), "least")
    linked = joined_hot(edges, least, "b", total).select(F.col("m").alias("x"), F.col("a").alias("y")).union(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
    return linked.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge sets (up to a hash collision)."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for each vertex of links (a, b) but the smallest of its component, which stands for it.

    Only aggregates and joins on vertices: a vertex with very many neighbours is combined map-side and joined by broadcast,
    and its rows are never gathered. Each round is written to the shared folder. The rounds end when the edges form stars;
    their number grows with the logarithm of the longest chain.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    edges = written(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        edges = written(_large(edges, mark[0]), "edges")
        edges = written(_small(edges, mark[0]), "edges")
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
