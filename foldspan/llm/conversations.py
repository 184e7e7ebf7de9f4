"""Repair of conversation structure by depth-first branch-and-bound.

A repaired conversation is empty, or turns of user and assistant in turn, with one system row before them at most. Edits
keep, rerole or delete a row or insert an empty one; the cheapest list of edits is wanted, and of equally cheap ones the
least as text. What the edits cost depends on a row's role initial and fault alone, so a run of rows is a signature, one
letter a row. The search goes over signatures: an explicit stack, children in the order of their letters, the cheapest end
of each suffix from each state as lower bound, an incumbent (cost, audit) that a first dive finds, and for each node (rows
done, state) the least cost seen there. Of equally cheap ways to one node the first visited is the least as text, since two
ways that have done the same rows are never a beginning of each other unless one has inserted more, and so cost more.

A conversation may hold any share of all rows. Rows are sorted by range and cut into segments; a conversation of one
segment is searched at once, each segment of a longer one from every state to every state, and these tables are joined
FAN at a time until one is left. Repeated rows are found by first places, counted before they are shuffled. Only the hash
of the repaired text, which by its definition reads it from end to end, is made by one task for each conversation; it
streams, and holds the audit and one batch of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldspan.llm.common import written
from foldspan.llm.ordering import in_sequence

#: Bits of the rows of a segment, and segment tables joined at a time.
SEGMENT_BITS, FAN = 12, 64
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after system, after user, after assistant. Where an inserted or reroled row leads from each, and what
#: a kept row does.
STATES, NEXT = (0, 1, 2, 3), (2, 2, 3, 2)
KEPT_TO = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
NAMES, WHOLE = {2: "user", 3: "assistant"}, frozenset((0, 3))
_NEVER = 1 << 60
_BLANK = " \t\n\x0b\x0c\r"
LEGAL = frozenset(("su", "ua", "au"))


def edits(letter: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) of one row, in the order of the edits' letters. Signature letters: the role's initial or x,
    in capitals if the row is truncated; d for rows that must go."""
    out = [("D", DELETE, state)]
    if letter != "d":
        extra, role = TRUNCATED * letter.isupper(), letter.lower()
        if (state, role) in KEPT_TO:
            out.append(("K", extra, KEPT_TO[state, role]))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


def bounds(signature: str, ends: frozenset[int]) -> list[list[int]]:
    """For each number of rows done and each state the least cost of any way to an end."""
    last = [0 if q in ends else _NEVER for q in STATES]
    out = [_inserted(last)]
    for letter in reversed(signature):
        after = out[-1]
        out.append(_inserted([min(cost + after[to] for _, cost, to in edits(letter, q)) for q in STATES]))
    return out[::-1]


def _inserted(least: list[int]) -> list[int]:
    two, three = min(least[2], INSERT + least[3]), min(least[3], INSERT + least[2])
    return [min(least[0], INSERT + two), min(least[1], INSERT + two), two, three]


def cheapest(signature: str, start: int = 0, ends: frozenset[int] = WHOLE) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from a state to one of the ends, the least as text among equals; None without any."""
    low, n = bounds(signature, ends), len(signature)
    if low[0][start] >= _NEVER:
        return None

    def children(i: int, q: int) -> list[tuple[str, int, int, int]]:
        rows = [(e, c, i + 1, to) for e, c, to in edits(signature[i], q)] if i < n else []
        return sorted([*rows, ("I", INSERT, i, NEXT[q])])

    def audit(node) -> str:
        letters = []
        while node:
            node, letter = node
            letters.append(letter)
        return "".join(reversed(letters))

    i, q, g, way = 0, start, 0, None  # the first dive
    while i < n or q not in ends:
        e, c, i, q = min(children(i, q), key=lambda x: (x[1] + low[x[2]][x[3]], x[0]))
        g, way = g + c, (way, e)
    best, proved = (g, audit(way)), False
    seen: dict[tuple[int, int], int] = {}
    stack = [(0, start, 0, None)]
    while stack:
        i, q, g, way = stack.pop()
        bound = g + low[i][q]
        if bound > best[0] or proved and bound == best[0] or seen.get((i, q), _NEVER) <= g:
            continue
        seen[i, q] = g
        if i == n and q in ends:
            best, proved = min(best, (g, audit(way))), True
        stack.extend((j, to, g + c, (way, e)) for e, c, j, to in reversed(children(i, q)))
    return best


@lru_cache(maxsize=1 << 16)
def remembered(signature: str) -> tuple[int, str]:
    """cheapest() of a short conversation; many are alike."""
    return cheapest(signature)


def table(signature: str) -> dict[str, list]:
    """The cheapest edits of a segment from every state to every state that it can reach."""
    found = [(a, b, x) for a, b in product(STATES, STATES) if (x := cheapest(signature, a, frozenset((b,))))]
    return {"a": [f[0] for f in found], "b": [f[1] for f in found], "cost": [f[2][0] for f in found], "audit": [f[2][1] for f in found]}


def joined(first: dict, second: dict) -> dict:
    """The table of two segments that follow each other."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for a, m, c, x in zip(first["a"], first["b"], first["cost"], first["audit"], strict=True):
        for m2, b, c2, y in zip(second["a"], second["b"], second["cost"], second["audit"], strict=True):
            if m == m2 and ((a, b) not in best or (c + c2, x + y) < best[a, b]):
                best[a, b] = c + c2, x + y
    return {"a": [k[0] for k in best], "b": [k[1] for k in best], "cost": [v[0] for v in best.values()], "audit": [v[1] for v in best.values()]}


def counted(first: dict, second: dict) -> dict:
    """The counts of two runs of rows that follow each other. Turns rise, so equal ones lie side by side."""
    if not first["n"] or not second["n"]:
        return second if second["n"] else first
    out = {c: first[c] + second[c] for c in ("n", "blank", "duplicate", "truncated")}
    met = first["last"] + second["first"] not in LEGAL
    both = [x for x in (first, second) if x["turns"]]
    return out | {
        "illegal": first["illegal"] + second["illegal"] + met, "first": first["first"], "last": second["last"],
        "turns": sum(x["turns"] for x in both) - (len(both) == 2 and first["high"] == second["low"]), "low": both[0]["low"] if both else None, "high": both[-1]["high"] if both else None,
    }


COUNTS = {"n": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "first": "string", "last": "string", "turns": "long", "low": "long", "high": "long"}
_SCHEMA = "grp string, conv_id long, seg long, signature string, " + ", ".join(f"{c} {t}" for c, t in COUNTS.items())
_TABLE = {"a": "array<int>", "b": "array<int>", "cost": "array<long>", "audit": "array<string>"}
_KINDS = {"string": pa.string(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _fields(schema: str) -> pa.Schema:
    return pa.schema([(c, _KINDS[t]) for c, t in (x.split(" ") for x in schema.split(", "))])


def damaged(rows: DataFrame) -> DataFrame:
    """(grp, conv_id, turn, role, text, live) of conversations as the damage rule leaves them; a dropped row stays as one that
    is not live, so that its conversation is not lost. Null roles and texts are one space, and so are null keys in the rule."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rule = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    role, text = shown("role"), shown("text")
    some = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("grp"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(rule == 4, "user").otherwise(role).alias("role"), F.when(rule == 1, "").when(rule == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (rule != 0).alias("live"), F.explode(F.sequence(F.lit(1), F.when(rule == 3, 2).otherwise(1))).alias("copy"),
    )
    return some.drop("copy")


def _segments(sequence: DataFrame) -> DataFrame:
    """The counts and signature of each segment of each conversation."""
    body = F.rtrim("text", F.lit(_BLANK))
    segment = F.shiftright("_seq", SEGMENT_BITS).alias("seg")
    marked = sequence.select("grp", segment, "_seq", F.lit(1).alias("kind"), "conv_id", "turn", "live", F.substring("role", 1, 1).alias("initial"), (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    firsts = sequence.filter(F.col("live") & (body != "")).groupBy("grp", key.alias("key")).agg(F.min("_seq").alias("_seq")).select("grp", segment, "_seq", F.lit(0).alias("kind"))
    both = marked.unionByName(firsts, allowMissingColumns=True).repartition("grp", "seg").sortWithinPartitions("grp", "seg", "_seq", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, letters, counts, out = None, None, [], {}, []
        for batch in batches:
            for grp, seg, seq, kind, conv_id, turn, live, initial, blank, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (grp, seg) != key:
                    if key:
                        out.append((*key, conv, "".join(letters), counts))
                    key, letters, counts = (grp, seg), [], dict.fromkeys(COUNTS, 0) | {"first": "", "last": "", "low": None, "high": None}
                if not kind:
                    first = grp, seq
                    continue
                conv = conv_id
                if not live:
                    continue
                fault = "blank" if blank else "duplicate" if first != (grp, seq) else "truncated" if cut else None
                if fault:
                    counts[fault] += 1
                letters.append("d" if fault in ("blank", "duplicate") else (initial if initial in ("s", "u", "a") else "x").upper() if fault else initial if initial in ("s", "u", "a") else "x")
                if counts["n"]:
                    counts["illegal"] += counts["last"] + initial not in LEGAL
                else:
                    counts["first"] = initial
                counts["n"], counts["last"] = counts["n"] + 1, initial
                if turn is not None:
                    counts["turns"] += turn != counts["high"]
                    counts["low"], counts["high"] = turn if counts["low"] is None else counts["low"], turn
            yield from _packed(out)
            out = []
        if key:
            yield from _packed([(*key, conv, "".join(letters), counts)])

    return written(both.mapInArrow(run, _SCHEMA), "segments")


def _packed(found: list) -> Iterator[pa.RecordBatch]:
    if found:
        rows = [{"grp": g, "seg": s, "conv_id": c, "signature": x, **counts} for g, s, c, x, counts in found]
        yield pa.RecordBatch.from_pylist(rows, schema=_fields(_SCHEMA))


def _verdicts(segments: DataFrame) -> DataFrame:
    """(grp, conv_id, counts, cost, audit) of each conversation, from its segments."""
    schema = "grp string, conv_id long, " + ", ".join(f"{c} {t}" for c, t in COUNTS.items()) + ", cost long, audit string"
    number = segments.groupBy("grp").agg(F.count(F.lit(1)).alias("parts"))
    long_ = written(number.filter("parts > 1"), "long")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["cost"], r["audit"] = (remembered if len(r["signature"]) <= 64 else cheapest)(r["signature"])
            yield pa.RecordBatch.from_pylist(rows, schema=_fields(schema))

    out = segments.join(long_, "grp", "left_anti").mapInArrow(alone, schema)
    most = long_.agg(F.max("parts")).first()[0]
    if not most:
        return out
    tabled = schema.replace(", cost long, audit string", "") + ", at long, " + ", ".join(f"{c} {t}" for c, t in _TABLE.items())

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([r | table(r["signature"])], schema=_fields(tabled))

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        first, *rest = rows.sort_by("at").to_pylist()
        for r in rest:
            first = first | counted(first, r) | joined(first, r)
        return pa.Table.from_pylist([first | {"at": key[1].as_py()}], schema=_fields(tabled))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                r["cost"], r["audit"] = min((c, x) for a, b, c, x in zip(r["a"], r["b"], r["cost"], r["audit"], strict=True) if a == 0 and b in WHOLE)
                yield pa.RecordBatch.from_pylist([r], schema=_fields(schema))

    place = F.row_number().over(Window.partitionBy("grp").orderBy("seg")) - 1
    tables = written(segments.join(long_, "grp").withColumn("at", place.cast("long")).mapInArrow(every, tabled), "tables")
    while most > 1:
        tables = written(tables.groupBy("grp", F.floor(F.col("at") / FAN)).applyInArrow(merged, tabled), "tables")
        most = -(-most // FAN)
    return out.unionByName(tables.mapInArrow(whole, schema))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of (conv_id,
    turn, role, text) after the damage.

    Null conversation ids are one conversation. Rows of one turn stand in the order of role and text, null turns first.
    Equal rows, of any number, follow each other. Roles with other initials are never kept; an empty role has none. Texts of
    any length count whole. A conversation without rows left has zeros, an empty audit and the hash of nothing. An empty
    table gives an empty one. Other columns are ignored, whatever their names.
    """
    sequence = in_sequence(damaged(rows), "grp", "turn", "role", "text")
    verdicts = _verdicts(_segments(sequence))
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(0).cast("long")
    heads = verdicts.select("grp", F.lit(-1).cast("long").alias("_seq"), F.struct("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit").alias("head"))
    texts = sequence.filter("live").select("grp", "_seq", "role", "text")
    stream = heads.unionByName(texts, allowMissingColumns=True).repartition("grp").sortWithinPartitions("grp", "_seq")
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for batch in batches:
            out = []
            for head, role, text in zip(*(batch.column(c).to_pylist() for c in ("head", "role", "text")), strict=True):
                if head:
                    if open_:
                        out.append(open_.closed())
                    open_ = Repair(head)
                else:
                    open_.row(role, text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_fields(schema))
        if open_:
            yield pa.RecordBatch.from_pylist([open_.closed()], schema=_fields(schema))

    return stream.select("head", "role", "text").mapInArrow(run, schema)


class Repair:
    """Applies an audit to the rows of a conversation as they come, and hashes what it leaves."""

    def __init__(self, head: dict):
        self.head, self.hash, self.at, self.state, self.any = head, hashlib.sha256(), 0, 0, False

    def _leave(self, role: str, text: str) -> None:
        self.hash.update(("\n" * self.any + role + ":" + text).encode())
        self.any = True

    def _insert(self) -> None:
        audit = self.head["audit"]
        while self.at < len(audit) and audit[self.at] == "I":
            self.state, self.at = NEXT[self.state], self.at + 1
            self._leave(NAMES[self.state], "")

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit, self.at = self.head["audit"][self.at], self.at + 1
        if edit == "K":
            self.state = KEPT_TO[self.state, role[0]]
            self._leave(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._leave(NAMES[self.state], text)

    def closed(self) -> dict:
        self._insert()
        return self.head | {"repaired_sha256": self.hash.hexdigest()}


#: The same by dynamic programming over rows and states; moves are the rows inserted before an edit.
ORACLE = """
WITH RECURSIVE ruled AS (
    SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)),
        lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS rule
    FROM conversations
), damaged AS (
    SELECT coalesce('=' || conv_id, '') AS grp, turn, CASE WHEN rule = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
        CASE rule WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
        unnest(range(CASE rule WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM ruled
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), seen AS (
    SELECT *, row_number() OVER (PARTITION BY grp, role, text ORDER BY i) AS nth FROM placed
), faults AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS initial FROM seen
), convs AS (
    SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS grp FROM conversations
), moves AS (
    SELECT * FROM (VALUES (0, 0, 0, []::VARCHAR[]), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
        (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])) t(q, n, mid, inserted)
), ops AS (
    SELECT * FROM (VALUES ('D', 0, NULL, 0), ('D', 1, NULL, 1), ('D', 2, NULL, 2), ('D', 3, NULL, 3), ('K', 0, 's', 1), ('K', 0, 'u', 2), ('K', 1, 'u', 2), ('K', 3, 'u', 2), ('K', 2, 'a', 3),
        ('R', 0, NULL, 2), ('R', 1, NULL, 2), ('R', 2, NULL, 3), ('R', 3, NULL, 2)) t(op, mid, initial, q2)
), way AS (
    SELECT grp, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'text': []::VARCHAR[]} AS best FROM convs
    UNION ALL
    SELECT way.grp, f.i, o.q2, min({'cost': best.cost + 3 * m.n + CASE o.op WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN f.fault = 'truncated' AND o.op <> 'D' THEN 3 ELSE 0 END,
        'audit': best.audit || repeat('I', m.n) || o.op, 'text': list_concat(best.text, m.inserted, CASE o.op WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE o.q2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END)})
    FROM way JOIN faults f ON f.grp = way.grp AND f.i = way.i + 1 JOIN moves m USING (q) JOIN ops o ON o.mid = m.mid AND (o.initial IS NULL OR o.initial = f.initial) AND (o.op = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
    GROUP BY way.grp, f.i, o.q2
), counts AS (
    SELECT grp, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated FROM faults GROUP BY grp
), pairs AS (
    SELECT grp, initial || lead(initial) OVER (PARTITION BY grp ORDER BY i) AS pair FROM faults
), illegal AS (
    SELECT grp, count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY grp
), ends AS (
    SELECT way.grp, min({'cost': best.cost + 3 * m.n, 'audit': best.audit || repeat('I', m.n), 'text': list_concat(best.text, m.inserted)}) AS best
    FROM way LEFT JOIN counts USING (grp) JOIN moves m USING (q) WHERE way.i = coalesce(counts.n, 0) AND m.mid IN (0, 3) GROUP BY way.grp
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.text, chr(10))) AS repaired_sha256
FROM convs LEFT JOIN counts USING (grp) LEFT JOIN illegal USING (grp) JOIN ends USING (grp)
"""
