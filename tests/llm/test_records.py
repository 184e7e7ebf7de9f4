"""Manifest, conversation repair and fingerprints, against SQL and brute force."""

import hashlib
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from foldspan.llm import conversations, fingerprints, manifest, registry
from oracle import connect, same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, grp int"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["op11_manifest", "op12_conversations"])
def test_queries_equal_sql(spark, name):
    same(connect(SF), registry.queries()[name](spark, SF), registry.oracle_sql()[name])


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(nodes):
    return [H(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]


def others(nodes, at):
    """Siblings of a node on all levels, each with its place in the run."""
    out = []
    while len(nodes) > 1:
        run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
        out.append((at % 8, run[: at % 8] + run[at % 8 + 1 :]))
        nodes, at = up(nodes), at // 8
    return out, nodes[0]


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    groups = defaultdict(list)
    for r in rows:
        low = None if r["text"] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])
        tampers = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        groups[r["lang"]].append((r["doc_id"], leaf(r, r["text"]), leaf(r, low if tampers else r["text"])))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for x in groups.values():
        x.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    subroots = [others([r[1] for r in groups[x]], 0)[1] for x in langs]
    for k, x in enumerate(langs):
        above, root = others(subroots, k)
        for at, (doc_id, own, changed) in enumerate(groups[x]):
            way = others([r[1] for r in groups[x]], at)[0] + above
            node = changed
            for place, run in way:
                node = H(*run[:place], node, *run[place:])
            yield (doc_id, own, subroots[k], root, H(*(y for _, run in way for y in run)), node, node == root)


def test_manifest_of_odd_rows(spark):
    rows = [(k, f"Text {k} ÄB" if k % 3 else f"low {k}", "en", "s", k) for k in range(1200)]
    rows += [(5, "A", None, None, None), (None, "B", None, "x", 1), (None, None, None, None, None), (9, "ß" * 9, "ﬁ", "s", 1), (9, "", "de", "", 0)]
    rows += [(7, "Copy", "fr", "s", 4)] * 20 + [(6, None, "fr", "s", 4), (-3, "Neg", "fr", "s", 4)] + [(k, "x", f"l{k}", "s", 1) for k in range(70)]
    docs = spark.createDataFrame([(*r, "digest", 1) for r in rows], DOCS)
    got = sorted(map(repr, map(tuple, manifest.manifest(docs).collect())))
    assert got == sorted(map(repr, plain_manifest([r.asDict() for r in docs.collect()])))
    assert manifest.manifest(docs.limit(0)).count() == 0
    assert manifest.manifest(docs.limit(1)).count() == 1


def test_versions_share_untouched_nodes():
    leaves = [bytes([k % 256]) * 32 for k in range(100)]
    first = manifest.built(leaves, 3)
    other = manifest.replaced(first, 77, b"x" * 32, 3)
    assert other.digest == manifest.built([*leaves[:77], b"x" * 32, *leaves[78:]], 3).digest
    assert sum(a is b for a, b in zip(first.children, other.children, strict=True)) == len(first.children) - 1
    way = manifest.siblings(first, 77, 3)
    assert manifest.continued(leaves[77], way) == first.digest and manifest.continued(b"x" * 32, way) == other.digest


def test_paths_over_three_steps_of_blocks(spark):
    """More nodes than BLOCK blocks hold, so that the blocks' own tree has blocks; and a group of one node beside them."""
    n = 300_000
    nodes = spark.range(n).select(F.lit("a").alias("grp"), F.col("id").alias("pos"), F.lit(n).cast("long").alias("total"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    nodes = nodes.unionByName(nodes.limit(1).select(F.lit("b").alias("grp"), F.lit(0).cast("long").alias("pos"), F.lit(1).cast("long").alias("total"), "digest"))
    found = manifest.paths(manifest.written(nodes, "nodes"))
    some = {(r["grp"], r["pos"]): r for r in found.filter(F.col("pos").isin(0, 1, 4097, 262_144, n - 1)).collect()}
    level = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)]
    for at in (0, 1, 4097, 262_144, n - 1):
        r = some["a", at]
        assert manifest.continued(bytes.fromhex(level[at]), [bytes(x) for x in r["path"]]) == bytes(r["top"])
    want = others(level, n - 1)
    assert [x[1:].hex() for x in map(bytes, some["a", n - 1]["path"])] == ["".join(run) for _, run in want[0]] and bytes(some["a", 0]["top"]).hex() == want[1]
    assert some["b", 0]["path"] == [] and found.count() == n + 1


def exhaustive(signature, most=4):
    """The least (cost, audit) of all lists of edits with a few inserts."""
    out = []

    def go(i, q, cost, audit, inserts):
        if i == len(signature) and q in (0, 3):
            out.append((cost, audit))
        if inserts < most:
            go(i, conversations.NEXT[q], cost + 3, audit + "I", inserts + 1)
        if i < len(signature):
            for e, c, to in conversations.edits(signature[i], q):
                go(i + 1, to, cost + c, audit + e, inserts)

    go(0, 0, 0, "", 0)
    return min(out)


def dynamic(signature):
    """The same for any length, by the best way to each state."""
    best = {0: (0, "")}

    def inserted(b):
        b = dict(b)
        for _ in range(4):
            for q, (c, x) in list(b.items()):
                to = conversations.NEXT[q]
                b[to] = min(b.get(to, (1 << 60, "")), (c + 3, x + "I"))
        return b

    for letter in signature:
        after = {}
        for q, (c, x) in inserted(best).items():
            for e, k, to in conversations.edits(letter, q):
                after[to] = min(after.get(to, (1 << 60, "")), (c + k, x + e))
        best = after
    return min(v for q, v in inserted(best).items() if q in (0, 3))


def test_search_finds_the_cheapest_and_least():
    rng = random.Random(3)
    for _ in range(200):
        s = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(0, 4)))
        assert conversations.cheapest(s) == exhaustive(s), s
    for _ in range(500):
        s = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(0, 40)))
        assert conversations.cheapest(s) == dynamic(s), s
    for _ in range(100):
        s = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(0, 30)))
        k = rng.randint(0, len(s))
        both, whole = conversations.joined(conversations.table(s[:k]), conversations.table(s[k:])), conversations.table(s)
        assert sorted(zip(*both.values(), strict=True)) == sorted(zip(*whole.values(), strict=True))


def plain_repair(rows):
    """All columns of repaired() for one conversation, row by row."""
    shown = lambda v: " " if v is None else str(v)
    out = []
    for conv_id, turn, role, text in rows:
        rule = zlib.crc32(f"{shown(conv_id)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        out += [(turn, "user" if rule == 4 else role, text)] * (0 if rule == 0 else 2 if rule == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults, signature = set(), Counter(), ""
    for _, role, text in out:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        signature += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
    cost, audit = dynamic(signature)
    state, left, kept = 0, iter(out), []
    for e in audit:
        if e != "I":
            _, role, text = next(left)
        if e == "K":
            state = conversations.KEPT_TO[state, role[0]]
            kept.append(f"{role}:{text}")
        elif e in "RI":
            state = conversations.NEXT[state]
            kept.append(conversations.NAMES[state] + ":" + (text if e == "R" else ""))
    turns = [t for t, _, _ in out if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (rows[0][0], gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_repair_of_odd_and_long_conversations(spark):
    rng = random.Random(5)
    say = ["Yes.", "No", "", " ", "So!", "x?\n", None, "yes.", "Long " * 3000 + "."]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "", None, "u2", "ä"]), rng.choice(say)) for c in (None, *range(1, 60)) for _ in range(rng.randint(1, 9))]
    rows += [(1000, k // 2, ("user", "assistant")[k % 2], "same." if k % 5 == 0 else f"text {k}" + "." * (k % 7 > 0)) for k in range(9000)]
    rows += [(1001, 1, "user", "again.")] * 5000 + [(2000 + k, 0, "user", "x.") for k in range(300)]
    frame = spark.createDataFrame([(*r, "signature", 1) for r in rows], "conv_id long, turn long, role string, text string, grp string, seg int")
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    got = {r["conv_id"]: tuple(r) for r in conversations.repaired(frame.repartition(5)).collect()}
    assert len(got) == len(groups) and any(x[7] == "" and x[2:7] == (0, 0, 0, 0, 0) for x in got.values())
    for k, x in groups.items():
        assert got[k] == plain_repair(x), k
    assert conversations.repaired(frame.limit(0)).count() == 0


def plain_prints(texts, rare=fingerprints.RARE, common=fingerprints.COMMON):
    """A fingerprint of each text, with the lexicon of them all."""
    signed = lambda x: struct.unpack("<q", struct.pack("<Q", x))[0]
    hash_ = lambda word: signed(xxhash.xxh64(word.encode(), seed=42).intdigest())
    words = lambda t: sorted({hash_(w) for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w})
    counts = Counter(w for t in texts for w in words(t))
    band = {w for w, n in counts.items() if max(2, rare * len(texts)) <= n <= common * len(texts)}

    def short(terms):
        h = 42
        for t in terms:
            h = xxhash.xxh64(struct.pack("<q", t), seed=h & (1 << 64) - 1).intdigest()
        return h >> 32

    def deal(terms, low, families):
        (classes, used), rest = families[0], families[1:]
        for r in range(used):
            some = [t for t in terms if t >> low & classes - 1 == r]
            yield short(some) if some else -1
            if rest:
                yield from deal(some, low + 10, rest)

    def made(text):
        every = words(text)
        known = [w for w in every if w in band]
        return [short(known or every), *deal(known, 20, fingerprints.FAMILIES)]

    return made


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(120)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(80)] + ["", None, " \n", "Déjà vu 漢字 🙂 x", "one"] + [" ".join(vocabulary) * 60]
    rows = [(3 * k - 9, t) for k, t in enumerate(texts)] + [(None, "null one two"), (3, "a second text of this id"), (3, "a second text of this id")]
    docs = spark.createDataFrame([(*r, "known", 1) for r in rows], "doc_id long, text string, id string, own int")
    made = plain_prints([t or "" for _, t in rows])
    shown = lambda x: "".join("-" * 8 if h < 0 else f"{h:08x}" for h in x)

    def like(a, b):
        pairs = [(x, y) for x, y in zip(a, b, strict=True) if x >= 0 or y >= 0]
        return sum(x == y for x, y in pairs) / len(pairs)

    by_id = defaultdict(list)
    for k, t in rows:
        by_id[-(1 << 63) if k is None else k].append(t or "")
    ids = sorted(by_id)
    key = lambda t: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64(t.encode(), seed=42).intdigest()))[0]
    want = []
    for k, t in rows:
        t, at = t or "", ids.index(-(1 << 63) if k is None else k)
        after = min(by_id[ids[(at + 1) % len(ids)]], key=key)
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b = made(t), made(edited)
        want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), like(a, b), like(a, made(after))))
    got = [tuple(r) for r in fingerprints.fingerprinted(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert len(made("x")) == fingerprints.HASHES
    assert fingerprints.fingerprinted(docs.limit(0)).count() == 0
    lone = fingerprints.fingerprinted(docs.filter("doc_id = -9")).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1


def test_a_lexicon_too_wide_is_refused(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "LEXICON_BYTES", 8)
    with pytest.raises(ValueError, match="narrower"):
        fingerprints.buckets(spark.range(5).select(F.col("id").alias("term")))
