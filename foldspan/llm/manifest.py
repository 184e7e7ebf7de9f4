"""Merkle manifest of a dataset: a persistent tree whose tampered versions share every untouched node.

Leaves of a group, sorted, fall into aligned blocks of BLOCK = ARITY ** DEPTH. A task builds the tree of one block; a
tampered leaf makes a new version of it by path copying: the leaf and its ancestors in the block are new nodes, all others
are the old ones. Block roots are the leaves of the next, smaller tree, which is built the same way, until one node is left;
then the subroots of all groups make one more tree. What a version needs of these upper trees is the path of its block, the
siblings on each level, which comes down the trees once for each block and not for each version; so versions, however many
a group has, are continued to their own roots in the tasks of their blocks.

A group of any size spreads over tasks, rows are placed by range and counts, and each step is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.llm.common import written
from foldspan.llm.ordering import numbered

#: Children of a node, levels of a block's tree, and so leaves of a block.
ARITY, DEPTH = 8, 3
BLOCK = ARITY**DEPTH
#: Bytes of a digest.
WIDTH = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value as it enters a leaf's digest: - if null, else its bytes' number, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(nodes: list[bytes]) -> bytes:
    """The digest of a run of digests, which are concatenated as lowercase hexadecimal text."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


class Node:
    """A node that never changes; versions share it."""

    __slots__ = ("digest", "children")

    def __init__(self, digest_: bytes, children: tuple[Node, ...] = ()):
        self.digest, self.children = digest_, children

    @classmethod
    def over(cls, children: tuple[Node, ...]) -> Node:
        return cls(digest([c.digest for c in children]), children)


def height(total: int) -> int:
    """Levels above the leaves in the tree of a block, of a group of so many nodes: all of them where blocks above follow."""
    if total > BLOCK:
        return DEPTH
    levels = 0
    while total > 1:
        total, levels = -(-total // ARITY), levels + 1
    return levels


def built(leaves: list[bytes], levels: int) -> Node:
    """The root of the tree over a block's leaves."""
    nodes = [Node(x) for x in leaves]
    for _ in range(levels):
        nodes = [Node.over(tuple(nodes[k : k + ARITY])) for k in range(0, len(nodes), ARITY)]
    return nodes[0]


def replaced(root: Node, at: int, leaf: bytes, levels: int) -> Node:
    """The root of the version in which one leaf differs: its ancestors are copied, all else is shared."""
    if not levels:
        return Node(leaf)
    span = ARITY ** (levels - 1)
    k, rest = divmod(at, span)
    return Node.over((*root.children[:k], replaced(root.children[k], rest, leaf, levels - 1), *root.children[k + 1 :]))


def siblings(root: Node, at: int, levels: int) -> list[bytes]:
    """For each level, the lowest first: the place in the run, as one byte, and the digests of the others of the run."""
    out, node = [], root
    for level in range(levels - 1, -1, -1):
        k, at = divmod(at, ARITY**level)
        out.append(bytes([k]) + b"".join(c.digest for j, c in enumerate(node.children) if j != k))
        node = node.children[k]
    return out[::-1]


def continued(value: bytes, path: list[bytes]) -> bytes:
    """The root that a version reaches through the levels of a path."""
    for step in path:
        others = [step[a : a + WIDTH] for a in range(1, len(step), WIDTH)]
        value = digest([*others[: step[0]], value, *others[step[0] :]])
    return value


def _blocks(nodes: DataFrame, keep: dict[str, str]) -> DataFrame:
    """(group, block, total, digest, leaves, and a list of each of the columns keep) of nodes (group, pos, total, digest)."""
    kinds = {"long": pa.int64(), "binary": pa.binary()}

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        leaves, total = rows.column("digest").to_pylist(), rows.column("total")[0].as_py()
        out = {"grp": [key[0].as_py()], "block": [key[1].as_py()], "total": [total], "digest": [built(leaves, height(total)).digest], "leaves": [b"".join(leaves)]}
        return pa.table(out | {c: pa.array([rows.column(c).to_pylist()], pa.list_(kinds[kind])) for c, kind in keep.items()})

    schema = "grp string, block long, total long, digest binary, leaves binary" + "".join(f", {c} array<{kind}>" for c, kind in keep.items())
    slim = nodes.select("grp", "pos", "total", "digest", *keep, F.floor(F.col("pos") / BLOCK).alias("block"))
    return written(slim.groupBy("grp", "block").applyInArrow(run, schema), "blocks")


def _leaves(packed: bytes) -> list[bytes]:
    return [packed[a : a + WIDTH] for a in range(0, len(packed), WIDTH)]


def paths(nodes: DataFrame) -> DataFrame:
    """(grp, pos, path, top) of written nodes (grp, pos, total, digest): the siblings of each node on the way to the one node
    that remains of its group, and that node. One pass for each BLOCK-fold of the largest group."""
    if (nodes.agg(F.max("total")).first()[0] or 0) <= 1:
        return nodes.select("grp", "pos", F.array().cast("array<binary>").alias("path"), F.col("digest").alias("top"))
    blocks = _blocks(nodes, {})
    above = paths(blocks.select("grp", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), "digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                leaves, levels = _leaves(r["leaves"]), height(r["total"])
                root, n = built(leaves, levels), len(leaves)
                place = pa.array(range(r["block"] * BLOCK, r["block"] * BLOCK + n), pa.int64())
                ways = pa.array([siblings(root, k, levels) + r["path"] for k in range(n)], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([r["grp"]] * n), place, ways, pa.array([r["top"]] * n, pa.binary())], ["grp", "pos", "path", "top"])

    joined = blocks.withColumnRenamed("block", "pos").join(above, ["grp", "pos"]).withColumnRenamed("pos", "block")
    return written(joined.select("grp", "block", "total", "leaves", "path", "top").mapInArrow(run, "grp string, pos long, path array<binary>, top binary"), "paths")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of documents (doc_id, source, lang,
    n_chars, text).

    Nulls count as such in leaves; rows without a language are a group of their own, before all others; null ids come first
    in their group and are never tampered with. Rows of one group and id stand in the order of their leaves; equal rows are
    interchangeable. Texts of any length are hashed whole. An empty table gives an empty one. Other columns are ignored,
    whatever their names.
    """
    row = lambda text: F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, LOWER))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(row(F.col("text"))).alias("digest"),
        F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.unhex(row(tampered))).alias("tampered"),
    )
    leaves = written(leaves, "leaves")
    blocks = _blocks(numbered(leaves, "grp", "doc_id", "digest"), {"doc_id": "long", "tampered": "binary"})
    below = written(paths(blocks.select("grp", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), "digest")), "below")
    subroots = written(below.filter("pos = 0").select(F.col("grp").alias("lang"), F.col("top").alias("digest"), F.lit("").alias("grp")), "subroots")
    placed = written(numbered(subroots, "grp", "lang"), "subroots-placed")
    upper = placed.select("lang", "pos").join(paths(placed.select("grp", "pos", "total", "digest")), "pos")
    upper = written(upper.select(F.col("lang").alias("grp"), F.col("path").alias("upper"), F.col("top").alias("root")), "upper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _rows(batch.slice(k, 1).to_pylist()[0])

    whole = blocks.withColumnRenamed("block", "pos").join(below, ["grp", "pos"]).join(upper, "grp")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return whole.select("total", "leaves", "doc_id", "tampered", "path", "top", "upper", "root").mapInArrow(run, schema)


def _rows(r: dict) -> pa.RecordBatch:
    """The manifest rows of one block."""
    leaves, levels, way = _leaves(r["leaves"]), height(r["total"]), r["path"] + r["upper"]
    first, root = built(leaves, levels), r["root"].hex()
    rest = b"".join(step[1:] for step in way).hex()
    proofs, folded = [], []
    for k, changed in enumerate(r["tampered"]):
        own = b"".join(step[1:] for step in siblings(first, k, levels)).hex()
        proofs.append(hashlib.sha256((own + rest).encode()).hexdigest())
        version = first if changed is None else replaced(first, k, changed, levels)
        folded.append(root if version is first else continued(version.digest, way).hex())
    n = len(leaves)
    columns = [pa.array(r["doc_id"], pa.int64()), [x.hex() for x in leaves], [r["top"].hex()] * n, [root] * n, proofs, folded, [x == root for x in folded]]
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


#: One run of a list of nodes becomes one node; DuckDB has no crc32, so it is computed from its polynomial.
ORACLE = """
WITH RECURSIVE docs AS (
    SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
        lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 3 = 0 AS tampers
    FROM documents
), fields AS (
    SELECT doc_id, lang, tampers, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
        text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
    FROM docs
), leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN tampers THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS now
    FROM fields
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS total FROM leaves
), tree AS (
    SELECT grp, 0 AS level, pos, total, leaf AS node FROM placed
    UNION ALL
    SELECT grp, min(level) + 1, pos // 8, (min(total) + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE total > 1 GROUP BY grp, pos // 8
), subroots AS (
    SELECT grp, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS gpos, count(*) OVER () AS total FROM tree WHERE total = 1
), uptree AS (
    SELECT 0 AS level, gpos AS pos, total, subroot AS node FROM subroots
    UNION ALL
    SELECT min(level) + 1, pos // 8, (min(total) + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM uptree WHERE total > 1 GROUP BY pos // 8
), walk AS (
    SELECT grp, pos AS leaf_pos, 0 AS level, pos, total, now AS node, '' AS proof FROM placed
    UNION ALL
    SELECT w.grp, leaf_pos, w.level + 1, w.pos // 8, (w.total + 7) // 8, sha256(s.before || node || s.after), proof || s.before || s.after
    FROM walk w JOIN LATERAL (
        SELECT coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (WHERE t.pos < w.pos), '') AS before, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (WHERE t.pos > w.pos), '') AS after
        FROM tree t WHERE t.grp = w.grp AND t.level = w.level AND t.pos // 8 = w.pos // 8
    ) s ON true WHERE w.total > 1
), upwalk AS (
    SELECT w.grp, leaf_pos, 0 AS level, gpos AS pos, s.total, node, proof FROM walk w JOIN subroots s USING (grp) WHERE w.total = 1
    UNION ALL
    SELECT w.grp, leaf_pos, w.level + 1, w.pos // 8, (w.total + 7) // 8, sha256(s.before || node || s.after), proof || s.before || s.after
    FROM upwalk w JOIN LATERAL (
        SELECT coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (WHERE t.pos < w.pos), '') AS before, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (WHERE t.pos > w.pos), '') AS after
        FROM uptree t WHERE t.level = w.level AND t.pos // 8 = w.pos // 8
    ) s ON true WHERE w.total > 1
)
SELECT p.doc_id, p.leaf, s.subroot, u.node AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = u.node AS verified
FROM placed p JOIN subroots s USING (grp) JOIN upwalk w ON w.grp = p.grp AND w.leaf_pos = p.pos AND w.total = 1, (SELECT node FROM uptree WHERE total = 1) u
"""
