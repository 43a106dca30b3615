"""Quality of documents: random-indexing word vectors, pooled, and a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from kgaudit.llm.arrow import map_texts, text_ranges
from kgaudit.llm.exprs import fold, narrow
from kgaudit.llm.hashing import mix, run_hashes
from kgaudit.llm.learning import labelled_sample, sigmoid, with_fold

FOLDS, HELD = 5, 0
# Labelled documents of either label that a model is fitted on.
SAMPLE = 8000
# Words share this many vectors by a hash; the last ones belong to shapes of words.
WORDS, SHAPES, DIM, TERNARY, REACH = 1 << 14, 4, 64, 8, 2
HIDDEN = 32
SLICES = 64
_VOCAB = WORDS + SHAPES
_STEP = 1 << 22
_TOGETHER = 1 << 16


def _byte_classes() -> np.ndarray:
    """0 white space, 1 letters and all bytes beyond ASCII, 2 digits, 3 anything else."""
    kinds = np.full(256, 3, np.int8)
    kinds[[0x20, *range(0x09, 0x0E)]] = 0
    kinds[128:] = 1
    for lo, hi, kind in ((65, 90, 1), (97, 122, 1), (48, 57, 2)):
        kinds[lo : hi + 1] = kind
    return kinds


KINDS = _byte_classes()


def word_ids(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of letters, digits or signs: its word's number, and its shape's.

    Words are lower-cased (A-Z) before they are hashed. The shapes: words in lower case, words
    with a capital first, words in capitals, and everything else.
    """
    raw = text.encode("utf-8", "surrogatepass")
    words, shapes = [], []
    for at in range(0, len(raw), _STEP):  # a run across a seam counts as two
        data = np.frombuffer(raw, np.uint8, min(_STEP, len(raw) - at), at)
        kinds = KINDS[data]
        starts = np.flatnonzero(np.diff(kinds, prepend=np.int8(-1)))
        ends = np.append(starts[1:], len(data))
        real = kinds[starts] > 0
        starts, ends = starts[real], ends[real]
        upper = (data >= 65) & (data <= 90)
        capitals = np.concatenate(([0], np.cumsum(upper)))
        small = np.concatenate(([0], np.cumsum((data >= 97) & (data <= 122))))
        has_upper, has_lower = capitals[ends] > capitals[starts], small[ends] > small[starts]
        letters = kinds[starts] == 1
        shapes.append(np.where(letters, np.where(has_upper, np.where(has_lower, 1, 2), 0), 3))
        words.append((run_hashes(np.where(upper, data + 32, data).astype(np.uint8), starts, ends) % np.uint64(WORDS)).astype(np.int64))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(shapes) + WORDS


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the few non-zero entries of each word's index vector."""
    h = mix(np.arange(_VOCAB * TERNARY, dtype=np.uint64) + np.uint64(1)).reshape(_VOCAB, TERNARY)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def dense_vectors() -> np.ndarray:
    """The index vectors as rows, and a last row of zeros for the places between two texts.

    Small integers: a word's context in one place adds up ten vectors of eight signs at most.
    """
    place, sign = index_vectors()
    out = np.zeros((_VOCAB + 1, DIM), np.int8)
    np.add.at(out, (np.arange(_VOCAB)[:, None], place), sign.astype(np.int8))
    return out


def _add_by(table: np.ndarray, to: np.ndarray, rows: np.ndarray) -> None:
    """Add ``rows`` to the rows ``to`` of ``table``: sorted first, so that each row of the table is touched once."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    start = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
    table[to[start]] += np.add.reduceat(rows[order], start, axis=0, dtype=np.int64)


def add_contexts(table: np.ndarray, words: np.ndarray, shapes: np.ndarray, vectors: np.ndarray, own: slice = slice(None)) -> None:
    """Add the index vectors of each word's neighbours, and of its own and their shapes, to its context vector; to its shape's the word's own.

    Texts that follow one another are kept apart by ``REACH`` words of the number ``_VOCAB``.
    Only the words in ``own`` are added to; the others are there as neighbours.
    """
    of_word, near = vectors[words], vectors[shapes]
    both = of_word + near
    for o in range(1, REACH + 1):
        near[:-o] += both[o:]
        near[o:] += both[:-o]
    _add_by(table, words[own], near[own])
    _add_by(table, shapes[own], of_word[own])


def _together(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """Words and shapes of about ``_TOGETHER`` words of whole texts, kept apart by gaps, and which of them are meant.

    A longer text comes in several parts, each with the ``REACH`` words on either side of it.
    """
    gap, words, shapes, size = np.full(REACH, _VOCAB), [], [], 0
    for text in texts:
        w, s = word_ids(text)
        if len(w) > _TOGETHER:
            for at in range(0, len(w), _TOGETHER):
                first, end = max(0, at - REACH), at + _TOGETHER
                yield w[first : end + REACH], s[first : end + REACH], slice(at - first, end - first)
            continue
        words += [w, gap]
        shapes += [s, gap]
        size += len(w) + REACH
        if size >= _TOGETHER:
            yield np.concatenate(words), np.concatenate(shapes), slice(None)
            words, shapes, size = [], [], 0
    if words:
        yield np.concatenate(words), np.concatenate(shapes), slice(None)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all words: their normalised context in the texts of ``docs`` and their own index vector.

    Each task adds up a table of its own; the tables are summed slice by slice, first those of
    about ``SLICES`` tasks and then their sums. A table has ``WORDS`` rows, whatever the texts hold.
    """

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, vectors, any_row = np.zeros((_VOCAB + 1, DIM), np.int64), dense_vectors(), False
        for batch in batches:
            any_row = any_row or batch.num_rows > 0
            for part in text_ranges(texts := batch.column("text").to_pylist()):
                for words, shapes, own in _together(texts[part.start : part.stop]):
                    add_contexts(table, words, shapes, vectors, own)
        if any_row:
            parts = np.array_split(table[:_VOCAB].astype(np.float32), SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "part"])

    def total(table: pa.Table) -> pa.Table:
        part = sum(np.frombuffer(b, np.float32) for b in table.column("part").to_pylist())
        return pa.table({"slice": table.column("slice")[:1], "part": pa.array([part.tobytes()], pa.binary())})

    kind = "slice int, part binary"
    parts = docs.select("text").mapInArrow(contexts, kind)
    some = parts.withColumn("bucket", F.floor(F.spark_partition_id() / SLICES)).groupBy("slice", "bucket").applyInArrow(total, kind)
    rows = some.groupBy("slice").applyInArrow(total, kind).collect()  # SLICES rows
    table = np.zeros((_VOCAB, DIM), np.float32)
    for r, part in zip(sorted(rows, key=lambda r: r["slice"]), np.array_split(np.arange(_VOCAB), SLICES), strict=False):
        table[part] = np.frombuffer(r["part"], np.float32).reshape(-1, DIM)
    table -= table.mean(0)
    own = dense_vectors()[:_VOCAB].astype(np.float32)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return (unit(table) + unit(own)).astype(np.float32)


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    """A document's features: the mean of its word vectors, of its shapes' vectors, and how words repeat."""
    words, shapes = word_ids(text)
    if not len(words):
        return np.zeros(DIM + SHAPES + 5, np.float32)
    ids, counts = np.unique(words, return_counts=True)
    mean = counts.astype(np.float32) @ vectors[ids] / len(words)
    kinds = np.bincount(shapes - WORDS, minlength=SHAPES) / len(words)
    again = np.mean(words[1:] == words[:-1]) if len(words) > 1 else 0.0
    apart = np.mean(words[2:] == words[:-2]) if len(words) > 2 else 0.0
    stats = [len(ids) / np.sqrt(len(words)), counts.max() / len(words), again, apart, np.log1p(len(words))]
    return np.concatenate([mean, kinds, stats]).astype(np.float32)


@dataclass
class Network:
    """Standardised input, one hidden layer of rectified units, a logit and a temperature."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.mean) / self.spread) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def gradients(params: list[np.ndarray], z: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float) -> list[np.ndarray]:
    """Of the weighted mean log loss plus half the squared weights times ``decay``, by (w1, b1, w2, b2)."""
    w1, b1, w2, b2 = params
    pre = z @ w1 + b1
    hidden = np.maximum(pre, 0)
    error = (sigmoid(hidden @ w2 + b2) - y) * weight / len(y)
    back = np.outer(error, w2) * (pre > 0)
    return [z.T @ back + decay * w1, back.sum(0), hidden.T @ error + decay * w2, np.array([error.sum()])]


def fit_network(x: np.ndarray, y: np.ndarray, prior: float, seed: int = 7, epochs: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Fit by Adam on a part of the rows, then calibrate the temperature on the others.

    ``prior`` is the share of label 1 among the labelled rows outside the held-out fold; rows are weighted so that the
    sample's own balance doesn't matter. With one label only, or no row, the network is constant.
    """
    n = x.shape[1]
    if len(y) < 4 or y.min() == y.max():
        p = min(max(prior, 0.01), 0.99)
        return Network(np.zeros(n), np.ones(n), np.zeros((n, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 6 + 1], order[len(y) // 6 + 1 :]
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    mean, spread = x[used].mean(0), x[used].std(0) + 1e-3
    net = Network(mean, spread, rng.normal(0, np.sqrt(2 / n), (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), 0.0)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - mean) / spread
    for epoch in range(epochs):
        step_size = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
        for rows in np.array_split(rng.permutation(used), max(1, len(used) // batch)):
            t += 1
            for i, g in enumerate(gradients(params, z[rows], y[rows], weight[rows], decay)):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] -= step_size * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits = net.logits(x[held])

    def loss(temperature: float) -> float:
        p = np.clip(sigmoid(logits / temperature), 1e-9, 1 - 1e-9)
        return float(-(weight[held] * np.where(y[held] == 1, np.log(p), np.log(1 - p))).sum())

    net.temperature = min(np.exp(np.linspace(np.log(0.25), np.log(8), 141)).tolist(), key=loss)
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.network.scores(np.stack([pooled(t, self.vectors) for t in texts]).astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, each: int = SAMPLE, label: str = "quality", folds: int = FOLDS, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """A model of ``label``, from at most ``each`` labelled documents of either label outside the held-out fold.

    Word vectors come from the texts of all documents, without labels. They and the pooled
    features are made by Spark's tasks; the driver gets the table of word vectors and a row of
    features per sampled document.
    """
    sample = labelled_sample(docs, labels, label, folds, held, each, id_col, text_col)
    vectors = word_vectors(narrow(docs, id_col, text_col))

    def start():
        return lambda texts: [[pooled(t, vectors).tolist() for t in texts]]

    made = map_texts(sample, start, StructType([StructField("features", ArrayType(FloatType()))])).toArrow().sort_by("doc_id")
    learnt = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col), folds) != held))
    counted = {r["v"]: r["count"] for r in learnt.groupBy(F.col(label).cast("int").alias("v")).count().collect()}
    prior = counted.get(1, 0) / max(1, sum(counted.values())) if counted else 0.5
    y = np.array(made.column("label").to_pylist(), np.float64)
    x = np.array(made.column("features").to_pylist(), np.float64).reshape(len(y), -1) if len(y) else np.zeros((0, DIM + SHAPES + 5))
    return QualityModel(vectors, fit_network(x, y, prior))


def quality_scores(docs: DataFrame, model: QualityModel, cut: float = 0.3, folds: int = FOLDS, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 where score >= ``cut``) of every whole text.

    A null text counts as an empty one; empty texts and texts of white space score like a
    document of zero features. A null id is in fold 0. Rows are scored independently, so
    repeated rows come back repeated; an empty table gives an empty result.
    """

    def start():
        return lambda texts: [model.scores(texts)]

    scored = map_texts(narrow(docs, id_col, text_col), start, StructType([StructField("score", DoubleType())]))
    return with_fold(scored, folds, held, cut)


def drop_poor(docs: DataFrame, model: QualityModel, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns."""
    # The row travels as one column, so that no name of its columns can clash.
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = map_texts(rows, lambda: (lambda texts: [model.scores(texts)]), StructType([StructField("score", DoubleType())]))
    return scored.filter(F.col("score") >= cut).select("row.*")
