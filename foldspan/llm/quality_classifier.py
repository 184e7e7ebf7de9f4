"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network whose
probabilities are calibrated by a temperature.

Every token (a run of letters and digits, or of symbols) hashes to one of BUCKETS rows and has a sparse random index
vector made from its hash. A row's word vector sums the index vectors of the tokens two places before and after it, over
all documents: each task sums its texts into one matrix of fixed size, and matrices are added in streaming tasks. The
table broadcast for pooling therefore has a size set by parameters, whatever the corpus. A document's features are the
mean of its word vectors and the mean product of neighbouring ones. The network is fitted in one task on at most about
TRAIN_ROWS labelled documents, drawn by chance when there are more; the driver sees its parameters only. Documents are
pooled and scored in the same pass, which carries their rows through, so that no verdict is joined back by id.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.llm.common import agreed_labels, gathered, mix, runs, sample, sliced, small_batches, spans, summed, word_hashes, written

BUCKETS, DIMENSIONS, NONZERO = 1 << 15, 32, 4
#: Bound of the labelled rows that the network is fitted on.
TRAIN_ROWS = 100_000
HIDDEN, STEPS, BATCH, RATE = 32, 3000, 256, 0.01
_SIDES = (-2, -1, 1, 2)
_CHUNK = 1 << 16


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """The sparse random vector of each token: NONZERO entries of 1 or -1 at places taken from its hash."""
    out = np.zeros((len(hashes), DIMENSIONS), np.float32)
    rows = np.arange(len(hashes))
    for k in range(NONZERO):
        h = mix(hashes + np.uint64(k + 1))
        out[rows, (h % np.uint64(DIMENSIONS)).astype(np.int64)] += np.where(h >> np.uint64(63), np.float32(1), np.float32(-1))
    return out


def _ids(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def contexts(docs: DataFrame) -> DataFrame:
    """Sums of context vectors by hash row, one matrix for each task, cut into 16 strips (strip, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, DIMENSIONS), np.float32)
        for batch in batches:
            for _, _, raw, starts, ends, first in spans(batch.column(1), runs):
                hashes = word_hashes(raw, starts, ends)
                known, place = np.unique(hashes, return_inverse=True)
                vectors = index_vectors(known)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for c in range(0, len(hashes), _CHUNK):
                    at = np.arange(c, min(c + _CHUNK, len(hashes)))
                    around = np.zeros((len(at), DIMENSIONS), np.float32)
                    for k in _SIDES:
                        near = np.clip(at + k, 0, len(hashes) - 1)
                        around += vectors[place[near]] * ((near == at + k) & (owner[near] == owner[at]))[:, None]
                    rows = _ids(hashes[at])
                    order = np.argsort(rows, kind="stable")
                    rows = rows[order]
                    edge = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                    total[rows[edge]] += np.add.reduceat(around[order], edge)
        strips = total.reshape(16, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(16, dtype=np.int32)), pa.array([x.tobytes() for x in strips], pa.binary())], ["strip", "values"])

    return docs.mapInArrow(run, "strip int, values binary")


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all hash rows, with the common direction taken out."""
    strips = gathered(summed(contexts(docs.select(F.lit(0).alias("id"), "text")), "strip", "values", 8))
    if not strips:
        return np.zeros((BUCKETS, DIMENSIONS), np.float32)
    total = np.concatenate([strips[k] for k in range(16)]).reshape(BUCKETS, DIMENSIONS)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    unit = np.divide(total, norm, out=np.zeros_like(total), where=norm > 0)
    unit -= unit[norm[:, 0] > 0].mean(0) * (norm > 0) if (norm > 0).any() else 0
    norm = np.linalg.norm(unit, axis=1, keepdims=True)
    return np.divide(unit, norm, out=np.zeros_like(unit), where=norm > 0).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector and mean product of neighbouring word vectors of each text; zeros without words."""
    out = np.zeros((len(texts), 2 * DIMENSIONS), np.float32)
    for i, j, raw, starts, ends, first in spans(texts, runs):
        rows = _ids(word_hashes(raw, starts, ends))
        for c in range(0, len(rows), _CHUNK):
            end = min(c + _CHUNK, len(rows))
            seen = vectors[rows[c : end + 1]]
            at = np.arange(c, end)
            owner = np.searchsorted(first, at, "right") - 1
            edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            out[i + owner[edge], :DIMENSIONS] += np.add.reduceat(seen[: end - c], edge)
            last = at + 1 >= first[owner + 1]
            following = np.concatenate([seen[1 : end - c + 1], np.zeros((max(0, end - c + 1 - len(seen)), DIMENSIONS), np.float32)])
            out[i + owner[edge], DIMENSIONS:] += np.add.reduceat(seen[: end - c] * following * ~last[:, None], edge)
        out[i:j] /= np.maximum(np.diff(first)[:, None], 1)
    return out


def _forward(model: dict, x: np.ndarray) -> np.ndarray:
    """Logits: one tanh layer, one linear one."""
    return np.tanh(((x - model["mean"]) / model["scale"]) @ model["w1"] + model["b1"]) @ model["w2"] + model["b2"]


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_forward(model, x).astype(np.float64) / model["temperature"], -60, 60)))


def fitted(x: np.ndarray, y: np.ndarray, seed: int = 11) -> dict:
    """Network by Adam on nine tenths of the rows, temperature by least log loss on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, rest = order[: len(x) // 10], order[len(x) // 10 :]
    size, mean = x.shape[1], y[rest].mean()
    model = {"mean": x[rest].mean(0), "scale": x[rest].std(0) + 1e-6, "w1": rng.normal(0, size**-0.5, (size, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": np.zeros(HIDDEN), "b2": np.log((mean + 1e-3) / (1 - mean + 1e-3))}
    z = (x - model["mean"]) / model["scale"]
    names = ("w1", "b1", "w2", "b2")
    first, second, t = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    while t < STEPS:
        for batch in np.array_split(rng.permutation(rest), max(1, len(rest) // BATCH)):
            h = np.tanh(z[batch] @ model["w1"] + model["b1"])
            error = (1 / (1 + np.exp(-np.clip(h @ model["w2"] + model["b2"], -30, 30))) - y[batch]) / len(batch)
            back = np.outer(error, model["w2"]) * (1 - h**2)
            step = {"w1": z[batch].T @ back + 1e-4 * model["w1"], "b1": back.sum(0), "w2": h.T @ error + 1e-4 * model["w2"], "b2": error.sum()}
            t += 1
            for n in names:
                first[n], second[n] = 0.9 * first[n] + 0.1 * step[n], 0.999 * second[n] + 0.001 * step[n] ** 2
                model[n] = model[n] - RATE * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.999**t)) + 1e-8)
    logits, truth = _forward(model, x[held]), y[held]
    loss = lambda temperature: np.mean(np.logaddexp(0, logits / temperature) - truth * logits / temperature)
    model["temperature"] = min(np.geomspace(0.25, 8, 60), key=loss) if len(held) >= 20 else 1.0
    return model


def _fitted_in_task(rows: DataFrame) -> tuple[dict | None, float]:
    """The model of rows (y, features), none without both labels, and the mean label or 0.5. One task reads the rows, whose
    number is bounded; only parameters come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, parts = [np.zeros(0, np.int32)], [np.zeros((0, 2 * DIMENSIONS), np.float32)]
        for batch in batches:
            marks.append(np.asarray(batch.column(0)))
            parts.append(np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1))
        y, x = np.concatenate(marks).astype(np.float32), np.concatenate(parts)
        model = fitted(x, y) if 0 < y.sum() < len(y) else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model, float(y.mean()) if len(y) else 0.5))], pa.binary())], ["model"])

    found = rows.select("y", "features").repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(found["model"])) if found else (None, 0.5)


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", learns: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, dict | None, float]:
    """Word vectors of all docs, the network, and the mean label. See scored."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    vectors = word_vectors(slim)
    marked = sample(agreed_labels(labels, label, learns), TRAIN_ROWS)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.FixedSizeListArray.from_arrays(pa.array(pooled(batch.column(1), shared.value).ravel()), 2 * DIMENSIONS).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["y", "features"])

    # at most about TRAIN_ROWS rows of two numbers are broadcast; ids that repeat in docs may make more rows, drawn from again
    rows = slim.join(F.broadcast(marked), "id").select("y", "text").mapInArrow(run, "y int, features array<float>")
    model, mean = _fitted_in_task(sample(written(rows, "pooled"), TRAIN_ROWS))
    shared.destroy()
    return vectors, model, mean


def _mapped(docs: DataFrame, model: tuple, columns: list, schema: str, out: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """out(batch, scores) of docs' columns, the last of which is the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network, mean = shared.value
        for batch in sliced(batches):
            score = probability(network, pooled(batch.column(batch.num_columns - 1), vectors)) if network else np.full(batch.num_rows, mean)
            yield out(batch, score)

    return docs.select(*columns).mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", learns: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for each document, by itself.

    Labels are joined on doc_id and used only where learns holds (a condition on doc_id; all by default). Null and empty
    texts have zero features and a score like any other; a text of any length is pooled whole, in pieces. Equal texts have
    equal scores. Null ids are scored and never learnt from; ids that repeat are scored row by row, and each row is learnt
    from; ids with both labels are not. Without rows of both labels the score is the mean label, or 0.5. An empty table
    gives an empty one. Other columns of docs are ignored, whatever their names.
    """

    def out(batch: pa.RecordBatch, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    columns = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")]
    return _mapped(docs, trained(docs, labels, label, learns, id_col, text_col), columns, "doc_id long, score double, predicted int", out)


def kept(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, but without rows that the classifier, taught by all labels, takes for bad. Each row is
    judged by its own text, whether its id is null, repeated or labelled. Without rows of both labels every row stays."""
    vectors, network, _ = trained(docs, labels, label, None, id_col, text_col)
    if not network:
        return docs
    out = lambda batch, score: batch.select(range(batch.num_columns - 1)).filter(pa.array(score >= 0.5))
    return _mapped(docs, (vectors, network, 1.0), [*(F.col(f"`{c}`") for c in docs.columns), F.col(text_col).cast("string").alias("__text")], docs.schema, out)
