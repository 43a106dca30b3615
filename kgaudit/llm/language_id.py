"""Language of documents by rank-order profiles of character n-grams and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from kgaudit.llm.arrow import map_texts, text_ranges
from kgaudit.llm.exprs import fold, narrow

FOLDS, HELD = 4, 2
# n-grams of a profile, and the longest n-gram.
PROFILE, LONGEST = 300, 3
UNKNOWN = "und"
# Rows of counts that a task holds before it adds them up.
_HELD = 1 << 20
_SHIFT = np.uint64(21)


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


_table: list[np.ndarray] = []


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text and their counts.

    Letters are lower-cased; anything else separates words, and one separator stands before
    and after each word. An n-gram has up to ``LONGEST`` characters, of which at least one is
    a letter and none in the middle a separator. It is coded as 21 bits per character.
    """
    if not _table:
        _table.append(_letters())
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_table[0][points], points, 1).astype(np.uint64)  # 1: separator
    if not (c > 1).any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = np.concatenate(([1], c, [1])).astype(np.uint64)
    c = c[np.concatenate(([True], (c[1:] > 1) | (c[:-1] > 1)))]
    two = (c[:-1] << _SHIFT) | c[1:]
    three = ((two[:-1] << _SHIFT) | c[2:])[c[1:-1] > 1]
    return np.unique(np.concatenate((c[c > 1], two, three)), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties in the order of their codes."""
    return grams[np.lexsort((grams, -counts))[:most]]


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all whole texts of ``rows`` (lang, text). Tasks add up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def added(parts: list) -> tuple[np.ndarray, np.ndarray]:
            grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return grams, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for part in text_ranges(texts):
                for i in part:
                    own = held.setdefault(langs[i], [])
                    own.append(ngrams(texts[i]))
                    if sum(len(p[0]) for p in own[-64:]) > _HELD or len(own) > 256:
                        own[:] = [added(own)]
        for lang, parts in held.items():
            grams, n = added(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = rows.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held: int = HELD) -> dict[str, np.ndarray]:
    """The ranked n-grams of each language, over all documents outside the held-out fold.

    Documents without a language teach nothing. The driver gets ``PROFILE`` rows a language.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    learnt = own.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = gram_counts(learnt).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= PROFILE)
    out: dict[str, list] = {}
    for r in top.orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(g, np.int64).view(np.uint64) for lang, g in out.items()}


class Matcher:
    """Out-of-place distances of documents to the profiles."""

    def __init__(self, learnt: dict[str, np.ndarray]):
        self.langs = sorted(learnt)
        self.sorted = [(np.sort(learnt[x]), np.argsort(learnt[x], kind="stable")) for x in self.langs]

    def match(self, text: str) -> tuple[str, float]:
        """The language whose profile is least out of place (ties: the first by name), and 1 - its distance.

        A document n-gram costs the difference of its two ranks, at most ``PROFILE``, which is
        also the cost of one that the profile lacks. The distance is divided by its largest value.
        """
        own = ranked(*ngrams(text))
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        rank, best = np.arange(len(own)), (2.0, UNKNOWN)
        for lang, (grams, ranks) in zip(self.langs, self.sorted, strict=True):
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            cost = np.where(grams[at] == own, np.minimum(np.abs(ranks[at] - rank), PROFILE), PROFILE)
            best = min(best, (float(cost.sum()) / (PROFILE * len(own)), lang))
        return best[1], 1.0 - best[0]


def languages(docs: DataFrame, learnt: dict[str, np.ndarray], folds: int = FOLDS, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text.

    A null text, and one without a letter, is ``und`` with score 0; so is every text if no
    language was learnt. A null id is in fold 0. Repeated rows come back repeated; an empty
    table gives an empty result.
    """

    def start():
        matcher = Matcher(learnt)

        def match(texts: list[str]) -> list[list]:
            found = [matcher.match(t) for t in texts]
            return [[f[0] for f in found], [f[1] for f in found]]

        return match

    added = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    found = map_texts(narrow(docs, id_col, text_col), start, added)
    return found.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")
