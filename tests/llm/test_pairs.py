import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspan.llm import common, decontamination, minhash, sharding
from foldspan.llm.components import connected_components

DOCS = "doc_id long, text string, lang string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in texts], DOCS)


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute_components(texts, width, percent):
    sets, parent = {i: shingles(t, width) for i, t in texts}, {i: i for i, _ in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def prose(rng, n):
    return [f"w{rng.randint(0, 400)}" for _ in range(n)]


def edited(rng, words, share):
    return [f"x{rng.randint(0, 9999)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(spark, width):
    rng, texts = random.Random(width), []
    for g in range(6):
        base = prose(rng, rng.choice([6, 40, 150]))
        texts += [" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06]))) for _ in range(14)]
    texts += [" ".join(prose(rng, 50)) for _ in range(20)] + ["", None, " \t", "one", "One", "two words", "TWO  words\n", "a a a a a a a"]
    texts = [(3 * k + 5, t) for k, t in enumerate(texts)]
    rng.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, texts), width=width).collect()}
    assert got == brute_components(texts, width, 80)


def test_hot_keys_heads_and_blocks_change_nothing(spark, monkeypatch):
    """One class of near copies holds most rows, with bounds so small that every key is hot and every block is cut."""
    for module, name, value in ((common, "HOT_ROWS", 2), (minhash, "HEAD_ROWS", 3), (minhash, "MINOR_BLOCK", 2), (minhash, "MEMBER_BLOCK", 3), (minhash, "BLOCK_SHINGLES", 40)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(12)
    base = prose(rng, 60)
    texts = [" ".join(edited(rng, base, rng.choice([0, 0.02, 0.05, 0.08]))) for _ in range(50)] + [" ".join(base)] * 9 + [" ".join(prose(rng, 30)) for _ in range(8)] + [None, ""]
    texts = list(enumerate(texts, 1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute_components(texts, 5, 80)


def test_a_member_has_one_link_to_a_component():
    same = np.arange(20, dtype=np.uint64)
    minors = (np.array([10, 11, 12, 13]), np.array([10, 10, 10, 13]), [same] * 4)
    members = (np.array([1, 2, 13]), np.array([1, 1, 13]), [same] * 3)
    assert minhash.block_links(minors, members, 80) == [(1, 10), (1, 13), (2, 10), (2, 13), (10, 13)]


def test_repeats_nulls_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 2), (None, "a b c d e f", "x", 3), (4, "a b c d e f", "x", 4)], "doc_id long, text string, id string, shingles int")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (4, 1, False)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns and kept.count() == 1 and minhash.deduplicated(df.limit(0)).count() == 0


def test_an_id_with_two_texts_is_linked_through_both(spark):
    one, two = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, [(5, one), (5, two), (7, one), (3, two + " b20"), (9, "c d e")])).collect()}
    assert got == {(5, 3), (7, 3), (3, 3), (9, 9)}


def test_deduplication_judges_rows(spark):
    """Null ids, repeated ids with unlike texts, rows without words, and clashing names of columns."""
    one, two = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    rows = [(None, one, "x"), (None, one, "x"), (1, one, "x"), (1, two, "x"), (2, two, "x"), (None, None, None), (3, "", "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    assert sorted(str(r["text"]) for r in minhash.deduplicated(df).collect()) == ["", "None", "None", one, two]


def test_signature_is_one_window_of_each_shingle():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    scatter, windows = minhash.permutations(240)
    want = windows[scatter[(s % minhash.UNIVERSE).astype(int)]].min(0)
    assert (minhash.signature(s, 240) == want).all()
    half = np.concatenate([s[:1000], rng.integers(0, 1 << 63, 1000).astype(np.uint64)])
    agree = (minhash.signature(s[:2000], 240) == minhash.signature(half, 240)).mean()
    assert abs(agree - 1000 / 3000) < 0.12


def test_chains_become_components(spark):
    links = [(k, k + 1) for k in range(60) if k % 20] + [(100, 7), (100, 30)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    graph = defaultdict(set)
    for a, b in links:
        graph[a].add(b)
        graph[b].add(a)
    for i in graph:
        seen, todo = {i}, [i]
        while todo:
            todo += [x for x in graph[todo.pop()] if x not in seen and not seen.add(x)]
        assert got.get(i, i) == min(seen)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_alignment(a, b):
    score, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            step = decontamination.MATCH if a[i - 1] == b[j - 1] else decontamination.MISMATCH
            score[i][j] = max(0, score[i - 1][j - 1] + step, score[i - 1][j] + decontamination.GAP, score[i][j - 1] + decontamination.GAP)
            best = max(best, score[i][j])
    return best


def test_alignment_equals_the_plain_recurrence():
    rng = random.Random(3)
    for _ in range(60):
        item = [rng.randint(0, 4) for _ in range(rng.randint(1, 12))]
        passages = [[rng.randint(0, 4) for _ in range(rng.randint(1, 15))] for _ in range(4)]
        got = decontamination.smith_waterman(np.array(item, np.uint64), [np.array(p, np.uint64) for p in passages])[0]
        assert got.tolist() == [plain_alignment(item, p) for p in passages]


def test_copies_of_items_are_found(spark):
    rng = random.Random(5)
    items = {k: prose(rng, 30) for k in range(4)}
    edit = items[1][:]
    edit[9], edit[20] = "changed", "other"
    del edit[14]
    texts = {
        10: "Start here. " + " ".join(items[0]) + " and the end.", 11: "é " * 300 + " ".join(edit).upper() + " tail", 12: " ".join(prose(rng, 200)), 13: " ".join(items[2][:8]) + " " + " ".join(prose(rng, 50)),
        14: " ".join(items[0]) + " gap " * 300 + " ".join(items[3]), 15: "", 16: None,
    }
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(90, ""), (91, None), (92, "solo")], "item_id long, text string")
    docs = frame(spark, [*texts.items(), (10, texts[10])])
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, benchmark).collect()}
    assert set(got) == {(10, 0), (11, 1), (14, 0), (14, 3)}
    assert got[10, 0]["score"] == 1.0 and 0.7 < got[11, 1]["score"] < 1
    assert texts[10][got[10, 0]["start"] : got[10, 0]["end"]] == " ".join(items[0])
    assert texts[11][got[11, 1]["start"] : got[11, 1]["end"]] == " ".join(edit).upper()
    assert sorted(r["doc_id"] for r in decontamination.decontaminated(docs, benchmark).collect()) == [12, 13, 15, 16]
    odd = spark.createDataFrame([(None, texts[10], 1), (None, texts[12], 2), (10, texts[12], 3), (10, texts[10], 4), (None, None, 5)], "doc_id long, text string, item_id int")
    clean = decontamination.decontaminated(odd, benchmark)
    assert clean.columns == odd.columns and sorted(r["item_id"] for r in clean.collect()) == [2, 3, 5]
    assert decontamination.contaminated(odd, benchmark).filter("doc_id = 10").count() == 1
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == 0 and decontamination.contaminated(docs.limit(0), benchmark).count() == 0


def test_a_copy_is_found_whatever_stands_in_other_documents(spark):
    rng = random.Random(8)
    item = [f"item{k}" for k in range(20)]
    edit = ["changed" if k % 5 == 4 else w for k, w in enumerate(item)]
    texts = [(1, " ".join(prose(rng, 20) + item))] + [(k, " ".join(prose(rng, 20) + edit + prose(rng, 5))) for k in range(2, 14)]
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(prose(rng, 25)))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontamination.contaminated(frame(spark, texts), benchmark).filter("item_id = 7").collect()}
    assert set(got) == set(range(1, 14)) and got[1] == 1.0 and all(got[k] < 1 for k in range(2, 14))


def test_windows_lose_no_alignment(spark):
    """Every window around every shared seed, aligned one by one, over so few words that most seeds are frequent; nothing
    beyond the alignments of whole documents is found."""
    rng = random.Random(9)
    items = {k: [f"w{rng.randint(0, 5)}" for _ in range(rng.randint(1, 14))] for k in range(12)}
    texts = {k: [f"w{rng.randint(0, 5)}" for _ in range(rng.randint(1, 30))] for k in range(60)}
    least, most = set(), set()
    for d, text in texts.items():
        for i, item in items.items():
            size, n = len(item), min(3, len(item))
            counts = lambda best: best >= size and (best + 1) // 2 >= min(5, size)  # noqa: B023, E731
            begins = {p - q for p in range(len(text) - n + 1) for q in range(size - n + 1) if text[p : p + n] == item[q : q + n]}
            if any(counts(plain_alignment(item, text[max(0, b - 8) : b + size + 8])) for b in begins):
                least.add((d, i))
            if counts(plain_alignment(item, text)):
                most.add((d, i))
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame(spark, [(k, " ".join(w)) for k, w in texts.items()]), benchmark).collect()}
    assert len(least) > 50 and least <= got <= most


def test_blocks_of_items_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(15)
    items = {k: prose(rng, 15) for k in range(12)}
    texts = [(k, " ".join(prose(rng, 20) + items[k % 12] + prose(rng, 9))) for k in range(30)]
    benchmark, docs = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string"), frame(spark, texts)
    whole = sorted(map(tuple, decontamination.contaminated(docs, benchmark).collect()))
    monkeypatch.setattr(decontamination, "SEEDS_A_BLOCK", 40)
    assert sorted(map(tuple, decontamination.contaminated(docs, benchmark).collect())) == whole and len(whole) >= 30
    assert decontamination.decontaminated(docs, benchmark).count() == 0


def test_edited_copies_are_found(spark):
    """Of the copies with up to three words in ten changed that an alignment of whole texts takes for copies, nearly all are
    found; no text without a copy is."""
    rng = random.Random(16)
    items = {k: prose(rng, rng.randint(12, 40)) for k in range(25)}
    texts = {k: prose(rng, 30) + edited(rng, items[k % 25], rng.choice([0.1, 0.2, 0.3])) + prose(rng, 30) for k in range(150)}
    texts |= {k: prose(rng, 80) for k in range(150, 200)}
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame(spark, [(k, " ".join(w)) for k, w in texts.items()]), benchmark).collect()}
    want = {(d, i) for d, w in texts.items() for i, x in items.items() if plain_alignment(x, w) >= len(x)}
    assert len(want) > 100 and got <= want and len(got) >= 0.97 * len(want)


def brute_shards(rows, shards, nodes):
    """One row at a time: own shard while it has room, then clockwise; arcs in ring order, first their own, then what is left."""
    marks = sharding.ring(shards, nodes)
    room, out = sharding.loads(len(rows), shards), {}
    arcs = defaultdict(list)
    for doc, arc in rows:
        arcs[arc].append(doc)
    left = []
    for arc in sorted(arcs):
        for doc in arcs[arc]:
            s = marks[arc][1]
            if room[s]:
                room[s] -= 1
                out[doc] = s
            else:
                left.append((arc, doc))
    for arc, doc in left:
        k = next(k for k in range(1, len(marks) + 1) if room[marks[(arc + k) % len(marks)][1]])
        s = marks[(arc + k) % len(marks)][1]
        room[s] -= 1
        out[doc] = s
    return Counter(out.values())


def test_shards_are_balanced_and_gapless(spark):
    texts = [(k, "hot" if k % 3 == 0 else f"text {k % 250}") for k in range(1000)] + [(None, None), (5000, "")]
    rows = [r.asDict() for r in sharding.assigned(frame(spark, texts), 8).collect()]
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == 1002 and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    homes = defaultdict(set)
    for r in rows:
        homes[r["text_crc32"]].add(r["shard"])
    assert sum(len(x) > 1 for x in homes.values()) < 20
    clash = frame(spark, texts).withColumn("place", F.lit("x")).withColumn("arc", F.lit("x"))
    assert sorted((r["shard"], r["slot"]) for r in sharding.assigned(clash, 8).collect()) == sorted((r["shard"], r["slot"]) for r in rows)
    assert [r["size"] for r in rows if r["doc_id"] is None] == [1]
    assert sharding.assigned(frame(spark, texts).limit(0)).count() == 0


def test_rows_stand_where_the_ring_puts_them(spark):
    """Each row against the ring, one at a time: on its arc's shard, or clockwise past shards that are full; texts of several
    rows stay together but for one text at most an arc that overflows, whatever their number."""
    texts = [(k, f"text {k % 200}") for k in range(2000)] + [(k, "hot") for k in range(2000, 3000)]
    rows = [r.asDict() for r in sharding.assigned(frame(spark, texts), 8).collect()]
    marks = sharding.ring(8)
    places = {r["id"]: r["place"] for r in frame(spark, texts).select(F.col("doc_id").alias("id"), F.shiftrightunsigned(F.xxhash64("text"), 1).alias("place")).collect()}
    arc = {k: sum(m < p for m, _ in marks) % len(marks) for k, p in places.items()}
    own = Counter(marks[a][1] for a in arc.values())
    full = {s for s in range(8) if own[s] >= 3000 // 8}
    for r in rows:
        home = marks[arc[r["doc_id"]]][1]
        assert r["shard"] == home or home in full
    for s in range(8):
        assert Counter(r["shard"] for r in rows)[s] == 375
    split = {places[r["doc_id"]] for r in rows} - {p for p in set(places.values()) if len({r["shard"] for r in rows if places[r["doc_id"]] == p}) == 1}
    assert len(split) <= 2 * len(full) + 6


def test_flows_equal_one_row_at_a_time():
    rng = random.Random(1)
    for _ in range(20):
        owners = [s for _, s in sharding.ring(4, 5)]
        counts = [rng.choice([0, 1, 3, 40]) for _ in owners]
        rows = [(f"{a}/{k}", a) for a, n in enumerate(counts) for k in range(n)]
        got = Counter()
        for _, a, b, s in sharding.flows(owners, counts, sharding.loads(len(rows), 4)):
            got[s] += b - a
        assert got == brute_shards(rows, 4, 5)


def test_one_more_shard_moves_little(spark):
    texts = [(k, f"text number {k}") for k in range(3000)]
    first = {r["doc_id"]: r["shard"] for r in sharding.assigned(frame(spark, texts), 8).collect()}
    second = {r["doc_id"]: r["shard"] for r in sharding.assigned(frame(spark, texts), 9).collect()}
    assert sum(first[k] != second[k] for k in first) / len(first) < 0.4
