"""Log-bilinear language model trained in numpy with noise-contrastive estimation.

Outputs have two levels. The first holds the end token, clusters of the most frequent words, and TAIL classes of all other
words by their ending; the second holds the words of a cluster, so that a token costs about two square roots of the
vocabulary. Within a tail class a word has its add-one share of the class's training tokens. The vector predicted for a
place is the sum over the CONTEXT words before it of their vectors times a diagonal matrix for their distance; scores on
either level are matrix products, and the softmax over each is exact, so token probabilities add up to one.

Counts cover every training document: tasks count words, a shuffle sums them. Words of their own are as many as the
counts give, up to WORDS; clusters follow as their square root. Training runs where the data lie: each task takes
noise-contrastive steps over its documents from shared parameters, and averages of the results, weighted by tokens, make
the next round's parameters, so the model depends a little on how the files are split. The frequent words' counts, a list
of bounded length, are broadcast; counts of all other words reach their documents by a join on the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.llm.common import gathered, mix, small_batches, spans, summed, word_hashes, written

#: Most words with outputs of their own, classes of the others, and sizes of vectors and contexts.
WORDS, TAIL, SIZE, CONTEXT = 8191, 64, 16, 6
#: Words whose counts are broadcast: about so many of the most frequent.
FREQUENT = 200_000
#: Noise outputs of a step on the first level and noise words of each target on the second, targets of a step, rounds, and
#: AdaGrad's rate and first squares.
NOISE, INNER, BATCH, ROUNDS, RATE, START = 48, 3, 4096, 2, 0.15, 1e-7
#: Tokens scored at a time, of these the ones whose first level stays in a core's cache, and tokens of the documents that are
#: laid out at a time.
SCORED, CACHED, LAID_OUT = 1 << 16, 2048, 1 << 16


def _classes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tail class of a word by its last two bytes."""
    low = raw[ends - 1].astype(np.uint64)
    before = np.where(ends - starts > 1, raw[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    return (mix(low * np.uint64(256) + before) % np.uint64(TAIL)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, class, n): tokens of each word hash in docs (id, text); each task counts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kinds, counts = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(kinds), pa.array(counts)], ["word", "class", "n"])

        for batch in batches:
            for _, _, raw, starts, ends, _ in spans(batch.column(1)):
                hashes = word_hashes(raw, starts, ends)
                new, at, n = np.unique(hashes, return_index=True, return_counts=True)
                merged = np.concatenate([held, new])
                kind = np.concatenate([kinds, _classes(raw, starts[at], ends[at]).astype(np.int32)])
                held, first, place = np.unique(merged, return_index=True, return_inverse=True)
                kinds = kind[first]
                counts = np.bincount(place, np.concatenate([counts, n]), len(held)).astype(np.int64)
                if len(held) > 1_000_000:
                    yield table()
                    held, kinds, counts = held[:0], kinds[:0], counts[:0]
        yield table()

    found = docs.mapInArrow(run, "word long, class int, n long")
    return found.groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


class Vocabulary:
    """What a task needs of the corpus: frequent words with counts and codes, clusters, and tokens and words of tail classes.

    Codes: 0 is the end token, 1 to words are words by falling count, then come tail classes, then the padding of contexts.
    Clusters are runs of words with about equal sums of the roots of their counts; first[c] is the place of cluster c's
    first word.
    """

    def __init__(self, counts: DataFrame, documents: int):
        level = F.floor(F.log2(F.col("n")) * 64).cast("int")
        heights = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
        wanted, room = F.lit(False), FREQUENT
        for height, n in heights:  # whole levels of counts while they fit, and of the next one a share of the words by hash
            if n > room:
                wanted |= (level == height) & (F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < int(1_000_000 * room / n))
                break
            wanted, room = level >= height, room - n
        rows = counts.filter(wanted).toArrow()
        word = rows.column("word").to_numpy().view(np.uint64)
        number, kinds = rows.column("n").to_numpy(), rows.column("class").to_numpy()
        order = np.lexsort((word, -number))
        own = order[:WORDS]
        self.words = len(own)
        output = np.full(len(word), -1, np.int64)
        output[own] = 1 + np.arange(self.words)
        self.class_tokens, self.class_words = np.zeros(TAIL), np.zeros(TAIL)
        for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
            self.class_tokens[r["class"]], self.class_words[r["class"]] = r["n"], r["words"]
        self.documents = documents
        self.tokens = int(self.class_tokens.sum()) + documents
        self.distinct = int(self.class_words.sum()) + (documents > 0)
        np.subtract.at(self.class_tokens, kinds[own], number[own])
        np.subtract.at(self.class_words, kinds[own], 1)
        mass = np.sqrt(number[own]) / max(1.0, np.sqrt(number[own]).sum())
        clusters = int(np.ceil(np.sqrt(self.words)))
        cut = np.floor(clusters * (np.cumsum(mass) - mass / 2)).astype(np.int64)
        self.first = np.append(np.flatnonzero(np.append(True, cut[1:] != cut[:-1])), self.words) if self.words else np.zeros(1, np.int64)
        self.clusters = len(self.first) - 1
        #: First-level output of each code, and its unigram shares.
        self.outer = np.concatenate([[0], 1 + np.repeat(np.arange(self.clusters), np.diff(self.first)), 1 + self.clusters + np.arange(TAIL)]).astype(np.int16)
        heads = np.add.reduceat(number[own], self.first[:-1]) if self.clusters else np.zeros(0)
        self.unigram = np.concatenate([[documents], heads, self.class_tokens]) + 1.0
        self.unigram /= self.unigram.sum()
        #: Share of each word in its cluster.
        self.inner = number[own] / np.repeat(heads, np.diff(self.first)) if self.words else np.zeros(0)
        sort = np.argsort(word)
        self.word, self.number, self.output = word[sort], number[sort], output[sort]
        #: log10 of the denominator of a word's share of its tail class.
        self.class_log = np.log10(self.class_tokens + self.class_words + 1)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.word, hashes), len(self.word) - 1)
        return np.where(self.word[at] == hashes, at, -1)


def coded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Each document as codes, with what its frequent words add to the scores and its other words to look up."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                ids, numbers, others = [], [np.zeros((4, 0))], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for i, j, raw, starts, ends, first in spans(part.column(1)):
                    hashes, owner = word_hashes(raw, starts, ends), np.repeat(np.arange(j - i), np.diff(first))
                    place, kind = v.look_up(hashes), _classes(raw, starts, ends)
                    found = place >= 0
                    number = np.where(found, v.number[place], 0) if len(v.word) else np.zeros(len(hashes))
                    output = np.where(found, v.output[place], -1) if len(v.word) else np.full(len(hashes), -1)
                    grouped = output < 0
                    logs = np.where(found, np.log10(number + 1.0), 0)
                    share = np.where(grouped, logs - v.class_log[kind], 0)
                    codes = np.insert(np.where(grouped, 1 + v.words + kind, output).astype("<i2"), first[1:], 0).tobytes()
                    at = (2 * (first + np.arange(j - i + 1))).tolist()
                    ids += [codes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                    numbers.append(np.stack([np.diff(first), *(np.bincount(owner, x, j - i) for x in (found, logs, share))]))
                    lost = np.flatnonzero(~found)
                    lost = lost[np.lexsort((hashes[lost], owner[lost]))]
                    edge = np.flatnonzero(np.append(True, (hashes[lost][1:] != hashes[lost][:-1]) | (owner[lost][1:] != owner[lost][:-1]))) if len(lost) else lost
                    others.append((hashes[lost[edge]].view(np.int64), np.diff(np.append(edge, len(lost))), i + owner[lost[edge]]))
                tokens, known, base, within = np.concatenate(numbers, axis=1)
                rare, counts, rows = (np.concatenate(x) for x in zip(*others, strict=True))
                lists = pa.StructArray.from_arrays([pa.array(rare), pa.array(counts.astype(np.int32))], ["word", "n"])
                at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=part.num_rows))])
                columns = [pa.array(ids, pa.binary()), pa.array(tokens.astype(np.int64) + 1), pa.array(known.astype(np.int64) + (v.documents > 0)), pa.array(base + np.log10(v.documents + 1.0)), pa.array(within), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), lists)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *columns], ["row", "doc_id", "learns", "outputs", "n_tokens", "known", "base", "within", "rare"])

    schema = "row long, doc_id long, learns boolean, outputs binary, n_tokens long, known long, base double, within double, rare array<struct<word: long, n: int>>"
    return docs.select("row", "text", "id", "learns").mapInArrow(run, schema)


def start(v: Vocabulary) -> dict[str, np.ndarray]:
    """First parameters: r vectors of codes in contexts, c diagonals of distances, o and i outputs of the first and second
    level. Predicted vectors end in a one, so the last column of o and i holds biases. These are unigram shares, so that
    training begins at the unigram model."""
    rng = np.random.default_rng(3)
    p = {"r": rng.normal(0, 0.1, (2 + v.words + TAIL, SIZE)), "c": np.full((CONTEXT, SIZE), 1 / CONTEXT), "o": rng.normal(0, 0.1, (len(v.unigram), SIZE)), "i": rng.normal(0, 0.1, (v.words, SIZE))}
    p["o"][:, -1], p["i"][:, -1] = np.log(v.unigram), np.log(v.inner)
    return {k: x.astype(np.float32) for k, x in p.items()}


def _packed(p: dict) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p.values()]).astype(np.float32)


def _unpacked(x: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k, v in like.items():
        out[k], at = x[at : at + v.size].reshape(v.shape).astype(np.float32), at + v.size
    return out


def laid_out(column: pa.Array, pad: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents of a column of codes: the first document, the codes in one line with CONTEXT pads before each
    document, the places of targets in it, and each document's first target."""
    sizes = np.asarray(pc.binary_length(column), np.int64) // 2
    group = (np.cumsum(sizes) - sizes) // LAID_OUT
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)] if len(sizes) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        first = np.concatenate([[0], np.cumsum(sizes[a:b])])
        line = np.full(first[-1] + CONTEXT * (b - a), pad, np.int16)
        at = np.arange(first[-1]) + np.repeat(CONTEXT * np.arange(1, b - a + 1), sizes[a:b])
        line[at] = np.concatenate([np.frombuffer(x.as_buffer(), "<i2") for x in column.slice(a, b - a)])
        yield a, line, at, first


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return table.take(at, axis=0, mode="clip")


def predicted(p: dict, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the codes of a line, and those predicted at each place from the CONTEXT codes before it, ending in a one."""
    seen = _rows(p["r"], line)
    h = np.zeros_like(seen)
    for k in range(1, CONTEXT + 1):
        h[k:] += seen[:-k] * p["c"][k - 1]
    h[:, -1] = 1
    return seen, h


def _stepped(p: dict, squares: dict, name: str, rows: np.ndarray, values: np.ndarray) -> None:
    """An AdaGrad step up the sums of value rows by row number, for the rows at hand only."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    edge = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    at, g = rows[edge], np.add.reduceat(_rows(values, order), edge)
    total = _rows(squares[name], at) + g * g
    squares[name][at] = total
    p[name][at] += np.float32(RATE) * g / np.sqrt(total)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -30, 30)))


def _drawn(words: np.ndarray, cluster: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Noise for each word: INNER other targets of its cluster, which stand in it by their share. Targets in the order of
    their clusters are turned about inside each cluster by a random number of places."""
    order = np.argsort(cluster, kind="stable")
    edge = np.flatnonzero(np.append(True, cluster[order][1:] != cluster[order][:-1]))
    size = np.diff(np.append(edge, len(order)))
    head, n = np.repeat(edge, size), np.repeat(size, size)
    turn = np.repeat(rng.integers(0, 1 << 30, (len(edge), INNER)), size, axis=0)
    out = np.empty((len(words), INNER), words.dtype)
    out[order] = words[order[head[:, None] + ((np.arange(len(order)) - head)[:, None] + turn) % n[:, None]]]
    return out


def nce_steps(p: dict, squares: dict, line: np.ndarray, at: np.ndarray, v: Vocabulary, rng: np.random.Generator) -> None:
    """One noise-contrastive step for each BATCH targets, in place. On the first level all meet the same NOISE outputs; on the
    second each word meets INNER words of its own cluster."""
    log_noise, log_inner = np.log(NOISE * v.unigram).astype(np.float32), np.log(INNER * v.inner).astype(np.float32)
    for k in range(0, len(at), BATCH):
        lo, places = at[k] - CONTEXT, at[k : k + BATCH] - (at[k] - CONTEXT)
        part = line[lo : lo + places[-1] + 1]
        seen, h = predicted(p, part)
        h, code = _rows(h, places), part[places]
        n, t = np.float32(1 / len(code)), v.outer[code]
        noise = rng.choice(len(v.unigram), NOISE, p=v.unigram).astype(np.int16)
        mine = _rows(p["o"], t)
        good = _sigmoid(log_noise[t] - np.einsum("bs,bs->b", h, mine)) * n
        bad = _sigmoid(h @ p["o"][noise].T - log_noise[noise]) * n
        back = good[:, None] * mine - bad @ p["o"][noise]
        steps = [("o", np.concatenate([t, noise]), np.concatenate([good[:, None] * h, -(bad.T @ h)]))]
        few = np.flatnonzero((code > 0) & (code <= v.words))
        if len(few):
            w, g = code[few] - np.int16(1), _rows(h, few)
            drawn, mine = _drawn(w, t[few], rng), _rows(p["i"], w)
            theirs = _rows(p["i"], drawn)
            up = _sigmoid(log_inner[w] - np.einsum("bs,bs->b", g, mine)) * n
            down = _sigmoid(np.einsum("bs,bks->bk", g, theirs) - log_inner[drawn]) * n
            back[few] += up[:, None] * mine - np.einsum("bk,bks->bs", down, theirs)
            steps.append(("i", np.concatenate([w, *drawn.T]), np.concatenate([up[:, None] * g, *(-x[:, None] * g for x in down.T)])))
        back[:, -1] = 0
        whole = np.zeros_like(seen)
        whole[places] = back
        turned, diagonal = np.zeros_like(seen), np.zeros_like(p["c"])
        for j in range(1, CONTEXT + 1):
            turned[:-j] += whole[j:] * p["c"][j - 1]
            diagonal[j - 1] = np.einsum("bs,bs->s", whole[j:], seen[:-j])
        for name, rows, values in (*steps, ("r", part, turned), ("c", np.arange(CONTEXT), diagonal)):
            _stepped(p, squares, name, rows, values)


def trained(rows: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters after ROUNDS of training in all tasks and averaging, weighted by tokens. Each task has noise of its own."""
    p, context = start(vocabulary), rows.sparkSession.sparkContext
    for turn in range(ROUNDS):
        shared = context.broadcast((p, vocabulary))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            begin, v = shared.value
            own, seen = {k: x.copy() for k, x in begin.items()}, 0
            rng = np.random.default_rng([17, turn, TaskContext.get().partitionId()])
            squares = {k: np.full(x.shape, START, np.float32) for k, x in own.items()}
            for batch in batches:
                for _, line, at, _ in laid_out(batch.column(0), len(own["r"]) - 1):
                    nce_steps(own, squares, line, at, v, rng)
                    seen += len(at)
            weighted = np.append(_packed(own) * np.float32(seen), np.float32(seen))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([weighted.tobytes()], pa.binary())], ["k", "v"])

        total = gathered(summed(rows.select("outputs").mapInArrow(run, "k int, v binary"), "k", "v", 8)).get(0)
        shared.destroy()
        if total is None or not total[-1]:
            return p
        p = _unpacked(total[:-1] / total[-1], p)
    return p


def _log_softmax(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """log of the softmax of each row at its own column; overwrites z. Rows are shifted by their greatest value only where
    exp could leave the range of floats otherwise."""
    value = z[np.arange(len(z)), own]
    if len(z) and (z.max() > 60 or z[:, 0].min() < -60):
        top = z.max(1)
        z -= top[:, None]
    else:
        top = np.float32(0)
    np.exp(z, out=z)
    return value - top - np.log(z @ np.ones(z.shape[1], z.dtype))


def log_probabilities(p: dict, v: Vocabulary, line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural logarithm of the model's probability of each target."""
    out, outer = np.empty(len(at)), p["o"].T.copy()
    for k in range(0, len(at), SCORED):
        lo, places = at[k] - CONTEXT, at[k : k + SCORED] - (at[k] - CONTEXT)
        part = line[lo : lo + places[-1] + 1]
        h, code = _rows(predicted(p, part)[1], places), part[places]
        cluster = v.outer[code]
        logs = np.concatenate([_log_softmax(h[i : i + CACHED] @ outer, cluster[i : i + CACHED]) for i in range(0, len(h), CACHED)]).astype(np.float64)
        order = np.argsort(cluster, kind="stable")
        edges = np.searchsorted(cluster[order], np.arange(1, v.clusters + 2))
        for c in range(v.clusters):
            rows, a, b = order[edges[c] : edges[c + 1]], v.first[c], v.first[c + 1]
            if len(rows) and b - a > 1:
                logs[rows] += _log_softmax(_rows(h, rows) @ p["i"][a:b].T, code[rows].astype(np.int64) - 1 - a)
        out[k : k + SCORED] = logs
    return out


def _scores(rows: DataFrame, p: dict, vocabulary: Vocabulary) -> DataFrame:
    """Adds log10 of the model's probability of each document's codes."""
    shared = rows.sparkSession.sparkContext.broadcast((p, vocabulary))
    names = [c for c in rows.columns if c != "outputs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, v = shared.value
        for batch in batches:
            out = [np.zeros(0)]
            for _, line, at, first in laid_out(batch.column(batch.schema.names.index("outputs")), len(p["r"]) - 1):
                out.append(np.add.reduceat(log_probabilities(p, v, line, at), first[:-1]) / np.log(10))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(n)) for n in names), pa.array(np.concatenate(out))], [*names, "model"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "outputs")
    return rows.mapInArrow(run, f"{schema}, model double")


def scored(docs: DataFrame, learns: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Model and add-one unigram scores of each document.

    learns: a condition on the columns of docs, true for the documents learnt from (all by default). Returns (doc_id,
    learns, n_tokens, n_known, train_tokens, base_score, score); scores are log10 probabilities, the end token included.
    A null text is empty: its end token only. Each row is scored by itself; ids may be null or repeat, and equal rows have
    equal scores. Texts of any length are scored whole. With nothing to learn from, every token is unknown and scores come
    from the add-one terms alone. An empty table gives an empty one. Other columns of docs are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    learns = F.coalesce(learns, F.lit(False)) if learns is not None else F.lit(True)
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"), learns.alias("learns"))
    train = slim.filter("learns")
    counts = written(word_counts(train.select("id", "text")), "counts")
    vocabulary = Vocabulary(counts, train.count())
    table = written(coded(slim, vocabulary), "coded")
    p = trained(table.filter("learns"), vocabulary)
    rare = table.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n")
    # a word beyond the frequent ones has less than 1 / FREQUENT of all training tokens: no key of this join is hot
    found = rare.join(counts.select("word", F.col("n").alias("c")), "word")
    more = found.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("also"))
    scores = _scores(table.drop("rare"), p, vocabulary).join(more, "row", "left").na.fill(0, ["more", "also"])
    whole = float(np.log10(vocabulary.tokens + vocabulary.distinct + 1))
    return scores.select(
        "doc_id",
        "learns",
        "n_tokens",
        (F.col("known") + F.col("also")).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("model") + F.col("within") + F.col("more")).alias("score"),
    )
