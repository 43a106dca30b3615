"""Toxicity by a subsequence string kernel, a support vector machine and Nystrom landmarks.

The kernel compares two short strings by their common subsequences of three characters, each
weighted by LAMBDA to the power of its span; so inserted and left-out characters cost a little,
not everything. An exponential makes it local. Its strings are windows of a text: a word, a word
without its signs, or a run of single characters. A support vector machine on the landmarks' kernel
values tells insulting windows from others, and a document is as toxic as its worst windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from kgaudit.llm.arrow import map_texts
from kgaudit.llm.exprs import narrow
from kgaudit.llm.hashing import mix, shingle_set
from kgaudit.llm.learning import labelled_sample, logistic, sigmoid, with_fold
from kgaudit.session import checkpointed

FOLDS, HELD = 3, 1
# Labelled documents of either label that a model is fitted on.
SAMPLE = 6000
# Windows of either label, and landmarks.
WINDOWS, LANDMARKS = 1500, 320
# A window is an insulting example if its share of toxic documents is no chance find: if the log
# likelihood ratio exceeds the logarithm of the number of windows by SURE.
SURE = 1.0
# Shingle hashes by which near copies in the sample are told.
SIGNS = 3
# Copies of each window with an inserted character.
GAPPED = 3
# Rounds that each add the clean windows which the machine takes for insults most.
ROUNDS = 3
LAMBDA, SPAN, SHARPNESS = 0.8, 6, 3.5
# Windows less like any insulting landmark than this are harmless without further comparison.
NEAR = 0.4
# Longer words are compared in overlapping windows of this length.
LENGTH = 24
MEMO_ENTRIES = 300_000
_SIGNS = ".,;:!?\"'()[]{}…-*_~|#$%&"
_APART = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")
# What a document's probability is made of: its largest margins, the numbers of words above
# some levels, and the number of words.
TOP, LEVELS, FLOOR = 3, (0.0, 0.5, 1.0), -1.5
FEATURES = TOP + len(LEVELS) + 1


def _parts(points: np.ndarray) -> list[np.ndarray]:
    """Of each character, three numbers: as the first, second and third of a subsequence. Their sum's upper bits number it."""
    return [(mix(points.astype(np.uint64) + np.uint64(0x110000 * k)) >> np.uint64(32)).astype(np.uint32) for k in (1, 2, 3)]


_COMBOS: dict[int, tuple] = {}


def _combos(length: int) -> tuple:
    """Positions and weights of the subsequences of three characters of a string."""
    if length not in _COMBOS:
        found = [(i, j, k) for i in range(length) for j in range(i + 1, length) for k in range(j + 1, min(length, i + SPAN))]
        i, j, k = np.array(found, np.int64).T
        _COMBOS[length] = (i, j, k, LAMBDA ** (k - i + 1.0))
    return _COMBOS[length]


def features(windows: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of windows of equal length: their places in ``windows``, subsequence numbers and weights.

    Each row lists its subsequences in order; of repeated ones the first carries the sum and
    the others nothing, and a row's weights have norm 1, so that an inner product of two rows
    is the normalised kernel. Windows under three characters have no subsequences and are left out.
    """
    by: dict[int, list[int]] = {}
    for at, w in enumerate(windows):
        if len(w) > 2:
            by.setdefault(len(w), []).append(at)
    for length, places in by.items():
        i, j, k, weight = _combos(length)
        for start in range(0, len(places), 2048):
            own = places[start : start + 2048]
            points = np.frombuffer("".join(windows[p] for p in own).encode("utf-32-le", "surrogatepass"), np.uint32)
            one, two, three = (x.reshape(len(own), length) for x in _parts(points))
            number = (one[:, i] + two[:, j] + three[:, k]) >> np.uint32(11)
            order = np.argsort(number, axis=1, kind="stable")
            number, value = np.take_along_axis(number, order, 1), weight[order]
            new = np.ones(number.shape, bool)
            new[:, 1:] = number[:, 1:] != number[:, :-1]
            at = np.flatnonzero(new)
            total = np.zeros(number.size)
            total[at] = np.add.reduceat(value.ravel(), at)
            total = total.reshape(number.shape)
            yield np.array(own), number, total / np.sqrt((total**2).sum(1, keepdims=True))


class Landmarks:
    """Kernel values of windows with fixed landmarks, of which the first ``n_bad`` are insults.

    The kernel is exp(SHARPNESS * (k - 1)) for the normalised subsequence kernel k.
    """

    def __init__(self, words: list[str], n_bad: int):
        self.words = words
        groups = [(p[:, None] + 0 * n, n, v) for p, n, v in features(words)]
        word, number, value = (np.concatenate([g[i].ravel() for g in groups]) if groups else np.zeros(0) for i in range(3))
        held = np.unique(number)
        self.row = np.zeros(1 << 21, np.int32)  # row 0: subsequences that no landmark has
        self.row[held.astype(np.int64)] = np.arange(1, len(held) + 1)
        self.dense = np.zeros((len(held) + 1, len(words)), np.float32)
        np.add.at(self.dense, (self.row[number.astype(np.int64)], word.astype(np.int64)), value)
        self.bad = (self.dense[:, :n_bad] > 0).any(1)

    def values(self, windows: list[str], near: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(places, kernel values) of the windows whose k with some insult can reach ``near``.

        The norm of the weights that a window has on the insults' subsequences is no less than
        its k with any of them (Cauchy and Schwarz), so the others need not be compared.
        """
        places, values = [np.zeros(0, np.int64)], [np.zeros((0, len(self.words)), np.float32)]
        for place, number, value in features(windows):
            row = self.row[number]
            if near:
                close = np.sqrt((value**2 * self.bad[row]).sum(1)) >= near
                place, row, value = place[close], row[close], value[close]
            places.append(place)
            for at in range(0, len(place), 64):
                k = np.einsum("nf,nfl->nl", value[at : at + 64].astype(np.float32), self.dense[row[at : at + 64]])
                values.append(np.exp(SHARPNESS * (k - 1)))
        return np.concatenate(places), np.concatenate(values)

    def all_values(self, windows: list[str]) -> np.ndarray:
        out = np.zeros((len(windows), len(self.words)))
        places, values = self.values(windows)
        out[places] = values
        return out


def windows_of(word: str) -> list[str]:
    """The windows of a lower-cased word: without signs around it, without any, and cut if long."""
    bare = word.strip(_SIGNS)
    forms = {bare, "".join(ch for ch in bare if ch.isalnum())}
    out = []
    for f in forms:
        out += [f] if len(f) <= LENGTH else [f[i : i + LENGTH] for i in range(0, len(f) - LENGTH // 2, LENGTH // 2)]
    return out


def words_of(text: str) -> set[str]:
    """The distinct lower-cased words of a whole text; runs of single characters count as words too."""
    low = text.lower()
    return set(low.split()) | {"".join(m.split()) for m in _APART.findall(low)}


_SCORERS: dict[str, object] = {}


@dataclass
class ToxicModel:
    """Landmarks, their weights in the machine, its bias, and the logistic step to a probability."""

    landmarks: list[str]
    n_bad: int
    alpha: np.ndarray
    bias: float
    link: np.ndarray

    @property
    def name(self) -> bytes:
        """A digest of what the margins depend on."""
        return hashlib.sha256(repr((self.landmarks, self.n_bad, self.bias)).encode("utf-8", "surrogatepass") + self.alpha.tobytes()).digest()

    def scorer(self):
        """A function from texts to features; kept by the worker from task to task, with the margins of the words it has seen."""
        if _SCORERS.get("name") != self.name:
            _SCORERS.clear()
            _SCORERS.update(name=self.name, worst=self._scorer())
        return _SCORERS["worst"]

    def _scorer(self):
        landmarks = Landmarks(self.landmarks, self.n_bad)
        known: dict[str, float] = {}

        def margins(words: list[set[str]]) -> list[dict[str, float]]:
            if len(known) > MEMO_ENTRIES:
                known.clear()
            new = list({w for ws in words for w in ws if w not in known})
            cut = [windows_of(w) for w in new]
            flat = [f for c in cut for f in c]
            margin = np.full(len(flat), FLOOR)
            places, values = landmarks.values(flat, NEAR)
            margin[places] = values @ self.alpha + self.bias
            at = 0
            for w, c in zip(new, cut, strict=True):
                known[w] = max(margin[at : at + len(c)].tolist(), default=FLOOR)
                at += len(c)
            return known

        def worst(texts: list[str]) -> np.ndarray:
            """Of each text's distinct words: the largest margins, and how many lie above each level."""
            words = [words_of(t) for t in texts]
            known = margins(words)
            out = np.zeros((len(texts), FEATURES))
            for i, ws in enumerate(words):
                margin = np.maximum(np.fromiter((known[w] for w in ws), np.float64, len(ws)), FLOOR)
                best = np.sort(np.concatenate((margin, [FLOOR] * TOP)))[::-1][:TOP]
                above = [np.log1p((margin > level).sum()) for level in LEVELS]
                out[i] = [*best, *above, np.log1p(len(ws))]
            return out

        return worst

    def scores(self, top: np.ndarray) -> np.ndarray:
        return sigmoid(top @ self.link[:-1] + self.link[-1])


def _without_copies(sample: DataFrame) -> DataFrame:
    """The sampled documents that share none of ``SIGNS`` smallest shingle hashes with one of a smaller id and their label. Stored.

    Near copies mostly share one; counted apart, they would make any word of theirs look typical.
    """

    def signs(text: str) -> list[int]:
        items = shingle_set(text)
        return [int(mix(items + np.uint64(k)).min().view(np.int64)) if len(items) else k for k in range(SIGNS)]

    signed = map_texts(sample, lambda: lambda texts: [[signs(t) for t in texts]], StructType([StructField("signs", ArrayType(LongType()))]))
    each = checkpointed(signed.select("doc_id", "label", F.posexplode("signs").alias("no", "sign")))
    first = each.groupBy("label", "no", "sign").agg(F.min("doc_id").alias("first"))
    copies = each.join(first, ["label", "no", "sign"]).filter("doc_id <> first").select("doc_id")
    return checkpointed(sample.join(copies, "doc_id", "left_anti").repartition(24, "doc_id"))


def word_table(sample: DataFrame) -> DataFrame:
    """word, toxic, clean: in how many sampled documents of either label a word stands. Stored."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                found = sorted({f for w in words_of(text) for f in windows_of(w) if len(f) > 2})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())], names=["word", "label"])

    counted = sample.select("text", "label").mapInArrow(words, "word string, label int")
    return checkpointed(counted.groupBy("word").agg(F.sum("label").cast("bigint").alias("toxic"), F.sum(1 - F.col("label")).cast("bigint").alias("clean")))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine under the squared hinge loss, by Newton steps on its support vectors.

    ``weight`` tells how much each row counts; both labels count the same in total.
    """
    for side in (y > 0, y < 0):
        weight = np.where(side, weight / (2 * max(1e-9, weight[side].sum())), weight)
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = np.eye(x.shape[1]) * ridge / 10
    keep[-1, -1] = 1e-6
    w, before = np.zeros(x.shape[1]), None
    for _ in range(steps):
        support = y * (x @ w) < 1
        if before is not None and (support == before).all():
            break
        own = x[support] * weight[support][:, None]
        w, before = np.linalg.solve(own.T @ x[support] + keep, own.T @ y[support]), support
    return w[:-1], float(w[-1])


def _gapped(words: list[str], seed: int) -> list[str]:
    """Each word with one character put in somewhere, so that the machine sees gaps."""
    rng = np.random.default_rng(seed)
    signs = "abcdefghijklmnopqrstuvwxyz0123456789.-*"
    at, which = rng.random(len(words)), rng.integers(0, len(signs), len(words)).tolist()
    cut = [1 + int(a * (len(w) - 1)) for a, w in zip(at.tolist(), words, strict=True)]
    return [w[:i] + signs[k] + w[i:] for w, i, k in zip(words, cut, which, strict=True)]


def _window_model(bad: dict[str, int], good: dict[str, int], hard: dict[str, int]) -> ToxicModel:
    """The machine for given windows, without its logistic step.

    The windows come with the number of documents that they stand in. An example counts as
    the root of it, so that chance finds among rare windows don't outweigh common insults.
    """
    counts = lambda words: [words[w] for w in words]
    weight = np.sqrt(np.array(counts(bad) * (1 + GAPPED) + counts(good) * (1 + GAPPED) + counts(hard), np.float64))
    bad, good, hard = list(bad), list(good), list(hard)
    rng = np.random.default_rng(3)
    drawn = lambda words, n: [words[i] for i in sorted(rng.permutation(len(words))[:n])]
    # Half of the landmarks are insulting windows, the surest ones and others drawn from all; the rest are drawn too.
    near = drawn(hard, LANDMARKS // 4)
    sure = bad[: LANDMARKS // 4]
    worst = sure + drawn(bad[LANDMARKS // 4 :], LANDMARKS // 4)
    own = [*worst, *near, *[w for w in drawn(good, LANDMARKS // 4) if w not in near]]
    marks = Landmarks(own, len(worst))
    inner = marks.all_values(own)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nystrom: a window's features are K(window, landmarks) @ root
    positive, negative = bad + _gapped(bad * GAPPED, 1), good + _gapped(good * GAPPED, 2) + hard
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    weights, bias = _machine(marks.all_values(positive + negative) @ root, y, weight)
    return ToxicModel(own, len(worst), root @ weights, bias, np.zeros(FEATURES + 1))


def _margin_start(model: ToxicModel):
    def start():
        worst = model.scorer()
        return lambda words: [worst(words)[:, 0]]

    return start


def fit(docs: DataFrame, labels: DataFrame, each: int = SAMPLE, label: str = "toxic", folds: int = FOLDS, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """A model from at most ``each`` labelled documents of either label outside the held-out fold.

    A toxic document holds insults somewhere, and a clean one hardly any. So windows that stand
    in toxic documents far more often than chance allows are the machine's positive examples
    (a clean document that quotes one, or a wrong label, doesn't matter), and those of clean
    documents the negative ones; both also come with an inserted character. The probability is
    fitted on whole documents. The driver gets ``WINDOWS`` windows of either kind, the surest or
    most frequent first, and two rows of numbers per sampled document.

    Without both labels the score is the constant share of label 1 (0.5 for no labels at all).
    """
    sample = _without_copies(labelled_sample(docs, labels, label, folds, held, each, id_col, text_col))
    counted = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    total = sum(counted.values())
    table = word_table(sample)
    share = min(max(counted.get(1, 0) / total, 1e-6), 1 - 1e-6) if total else 0.5
    n = F.col("toxic") + F.col("clean")
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * p))).otherwise(0.0)
    marked = table.withColumn("sure", F.when(F.col("toxic") > n * share, part("toxic", share) + part("clean", 1 - share)).otherwise(0.0))
    insulting = F.col("sure") >= float(np.log(max(1, table.count()))) + SURE
    clean = marked.filter((F.col("clean") > 0) & ~insulting)
    taken = lambda rows: {r["word"]: r["toxic"] + r["clean"] for r in rows.select("word", "toxic", "clean").limit(WINDOWS).collect()}
    bad = taken(marked.filter(insulting).orderBy(F.desc("sure"), "word"))
    good = taken(clean.orderBy(F.desc("clean"), "word")) | taken(clean.orderBy(F.xxhash64("word"), "word"))
    if not bad or not good:
        p = min(max(counted.get(1, 0) / total if total else 0.5, 0.01), 0.99)
        return ToxicModel([], 0, np.zeros(0), FLOOR, np.array([0.0] * FEATURES + [np.log(p / (1 - p))]))
    hard: dict[str, int] = {}
    for _ in range(ROUNDS):
        model = _window_model(bad, good, hard)
        margins = map_texts(clean.select(F.col("word").alias("text"), "word", "toxic", "clean"), _margin_start(model), StructType([StructField("margin", DoubleType())]))
        hard |= taken(margins.orderBy(F.desc("margin"), "word"))
    model = _window_model(bad, good, hard)

    def start():
        worst = model.scorer()
        gaps = lambda t: " ".join(_gapped([w for w in t.split() if len(w) > 1], len(t)))
        return lambda texts: [worst(texts).tolist(), worst([gaps(t) for t in texts]).tolist()]

    # The logistic step sees each document as it is, and with a character put into every word.
    kinds = StructType([StructField(c, ArrayType(DoubleType())) for c in ("plain", "gapped")])
    made = map_texts(sample, start, kinds).toArrow().sort_by("doc_id")
    seen = np.array(made.column("plain").to_pylist() + made.column("gapped").to_pylist(), np.float64).reshape(-1, FEATURES)
    truth = np.array(made.column("label").to_pylist() * 2, np.float64)
    model.link = logistic(seen, truth, ridge=1e-4)
    return model


def toxicity_scores(docs: DataFrame, model: ToxicModel, cut: float = 0.7, folds: int = FOLDS, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 where score >= ``cut``) of every whole text.

    A null text counts as an empty one, and a text without words scores as one whose words are
    all harmless. A null id is in fold 0. Repeated rows come back repeated; an empty table gives
    an empty result.
    """

    def start():
        worst = model.scorer()
        return lambda texts: [model.scores(worst(texts))]

    scored = map_texts(narrow(docs, id_col, text_col), start, StructType([StructField("score", DoubleType())]))
    return with_fold(scored, folds, held, cut)
