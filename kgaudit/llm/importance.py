"""Importance resampling towards a target text, on hashed n-grams.

A document's words, joined by single blanks, are scanned once, which gives the running CRC at
every word's end. CRCs are linear over GF(2): shifting the CRC of one prefix by the bytes that
follow and adding that of a longer prefix cancels what the two share, so the CRC of any run of
words comes from two stored numbers, without reading its bytes again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from kgaudit.llm.arrow import map_texts
from kgaudit.llm.exprs import narrow
from kgaudit.session import checkpointed, numbered

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
_POLYNOMIAL = 0xEDB88320
_ALL = np.uint32(0xFFFFFFFF)
# Bytes of one text that are scanned together; cut between words.
SLAB = 1 << 22


def _step_table() -> np.ndarray:
    """What one byte does to a CRC register, by the bit rule of the polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), t >> np.uint32(1)).astype(np.uint32)
    return t


_STEP = _step_table()


def _apply(tables: np.ndarray, reg: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit registers, given by what it does to each of the four bytes."""
    return tables[0][reg & 255] ^ tables[1][(reg >> 8) & 255] ^ tables[2][(reg >> 16) & 255] ^ tables[3][reg >> 24]


def _shift_tables(powers: int = 40) -> list[np.ndarray]:
    """Maps that shift a register by 1, 2, 4, ... zero bytes; each is the square of the one before."""
    every = np.array([[v << 8 * j for v in range(256)] for j in range(4)], np.uint32)
    out = [_STEP[every & 255] ^ (every >> np.uint32(8))]
    for _ in range(powers - 1):
        out.append(_apply(out[-1], out[-1]))
    return out


_SHIFTS = _shift_tables()


def shifted(reg: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Registers shifted by their own numbers of zero bytes."""
    reg, bit = reg.copy(), 0
    while (left := by >> bit).any():
        at = np.flatnonzero(left & 1)
        reg[at] = _apply(_SHIFTS[bit], reg[at])
        bit += 1
    return reg


def running_crcs(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC registers (started at zero, not complemented) of the prefixes of ``data`` up to each of ``ends``.

    The bytes are laid out in rows that are scanned side by side; the registers at the rows'
    ends are then carried from row to row.
    """
    n = len(data)
    bits = max(4, (n.bit_length() + 1) // 2)
    width = 1 << bits
    rows = n // width + 1
    grid = np.zeros(rows * width, np.uint8)
    grid[:n] = data
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    local = np.zeros((width + 1, rows), np.uint32)
    for c in range(width):
        reg = local[c]
        local[c + 1] = _STEP[(reg ^ grid[c]) & 255] ^ (reg >> np.uint32(8))
    t0, t1, t2, t3 = (t.tolist() for t in _SHIFTS[bits])
    start, reg = [], 0
    for last in local[width].tolist():
        start.append(reg)
        reg = t0[reg & 255] ^ t1[(reg >> 8) & 255] ^ t2[(reg >> 16) & 255] ^ t3[reg >> 24] ^ last
    row, column = ends >> bits, ends & (width - 1)
    return local[column, row] ^ shifted(np.array(start, np.uint32)[row], column)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes, and whether a byte belongs to a word: digits, a to z, all beyond ASCII."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    return lower, word


_LOWER, _IS_WORD = _classes()


def run_crcs(data: np.ndarray, owner_ends: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each length 1 to ``longest``: (owner, CRC-32) of every run of so many words.

    ``data`` holds the bytes of several owners one after the other, each followed by a byte that
    is no word; ``owner_ends`` are the places of those bytes.
    """
    low = _LOWER[data]
    inside = _IS_WORD[low]
    after = np.zeros(len(low), bool)
    after[1:] = inside[:-1] & ~inside[1:]  # the first byte behind a word becomes its blank
    joined = np.where(inside, low, 32)[inside | after]
    blank = np.flatnonzero(joined == 32)
    if not len(blank):
        return [(np.zeros(0, np.int64), np.zeros(0, np.uint32))] * longest
    owner = np.searchsorted(owner_ends, np.flatnonzero(after), "left")
    starts = np.concatenate(([0], blank[:-1] + 1))
    end = running_crcs(joined, blank)
    begin = np.zeros(len(end), np.uint32)
    begin[1:] = _STEP[(end[:-1] ^ np.uint32(32)) & 255] ^ (end[:-1] >> np.uint32(8))  # past the blank
    # A CRC starts from all ones; the prefix before the run is shifted over the run and cancels.
    carried = shifted(begin ^ _ALL, blank - starts)
    out = [(owner, carried ^ end ^ _ALL)]
    for k in range(1, longest):
        more = len(owner) - k
        if more <= 0:
            out.append((owner[:0], end[:0]))
            continue
        carried = shifted(carried[:more], blank[k:] - blank[k - 1 : -1])
        same = owner[:more] == owner[k:]
        out.append((owner[:more][same], (carried ^ end[k:] ^ _ALL)[same]))
    return out


def _slabs(raw: bytes, longest: int) -> Iterator[tuple[bytes, int]]:
    """(bytes, words that came before): a long text cut between words, each slab after the last words of the one before."""
    at, again = 0, 0
    while at < len(raw):
        stop = min(at + SLAB, len(raw))
        while stop < len(raw) and _IS_WORD[_LOWER[raw[stop]]]:
            stop += 1
        yield raw[at - again : stop], again
        at, again = stop, 0
        seen = 0
        while at < len(raw) and seen < longest - 1 and again < at:  # back over the last words
            again += 1
            if _IS_WORD[_LOWER[raw[at - again]]] and (again == at or not _IS_WORD[_LOWER[raw[at - again - 1]]]):
                seen += 1


def feature_buckets(texts: list[str], buckets: int, longest: int) -> tuple[list[int], list[bytes]]:
    """Of each text: its number of words, and the buckets of its features as little-endian numbers."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    words, found = [0] * len(raws), [b""] * len(raws)
    small = [i for i, r in enumerate(raws) if len(r) <= SLAB]
    if small:
        ends = np.cumsum([len(raws[i]) + 1 for i in small]) - 1
        runs = run_crcs(np.frombuffer(b"\n".join(raws[i] for i in small) + b"\n", np.uint8), ends, longest)
        parts = []
        for owner, crc in runs:
            data = (crc % np.uint32(buckets)).astype(kind)
            cuts = np.searchsorted(owner, np.arange(len(small) + 1)) * data.itemsize
            parts.append((data.tobytes(), cuts.tolist()))
        count = np.bincount(runs[0][0], minlength=len(small)).tolist()
        for k, i in enumerate(small):
            words[i], found[i] = count[k], b"".join(data[cuts[k] : cuts[k + 1]] for data, cuts in parts)
    for i, raw in enumerate(raws):
        if len(raw) > SLAB:
            for part, again in _slabs(raw, longest):
                # A run belongs to the slab in which it ends.
                runs = run_crcs(np.frombuffer(part + b"\n", np.uint8), np.array([len(part)]), longest)
                old = len(run_crcs(np.frombuffer(part[:again] + b"\n", np.uint8), np.array([again]), 1)[0][0]) if again else 0
                words[i] += len(runs[0][0]) - old
                found[i] += b"".join((crc[max(0, old - k) :] % np.uint32(buckets)).astype(kind).tobytes() for k, (_, crc) in enumerate(runs))
    return words, found


def featured(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, features (packed buckets of all runs of words) of each document. Stored, so that texts are scanned once."""

    def start():
        return lambda texts: list(feature_buckets(texts, buckets, longest))

    added = StructType([StructField("n_words", LongType()), StructField("features", BinaryType())])
    return checkpointed(map_texts(narrow(docs, id_col, text_col), start, added))


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the whole table ``rows`` (features) are in each bucket; each task adds up its own first."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("features").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share in the target and in the corpus, one added to each count."""
    n, s, t = len(corpus), corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighted(rows: DataFrame, gain: np.ndarray, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, long_enough of ``rows`` (doc_id, n_words, features): the floored mean gain of the features."""
    kind, size = ("<u2", 2) if len(gain) <= 1 << 16 else ("<u4", 4)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[np.frombuffer(f, kind)].sum()) if f else 0 for f in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n"), pa.array(sums, pa.int64())], names=["doc_id", "n_words", "n", "total"])

    schema = StructType([rows.schema["doc_id"], StructField("n_words", LongType()), StructField("n", LongType()), StructField("total", LongType())])
    sized = rows.select("doc_id", "n_words", "features", (F.octet_length("features") / size).cast("bigint").alias("n"))
    summed = sized.mapInArrow(weigh, schema)
    weight = F.when(F.col("n") > 0, F.expr("(total - pmod(total, n)) div n")).otherwise(F.lit(0)).cast("bigint")
    return summed.select("doc_id", F.col("n").alias("n_features"), weight.alias("weight"), (F.col("n_words") >= least_words).alias("long_enough"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """A draw of ``percent`` % of the documents, without replacement, by their likeness to ``target``.

    Returns doc_id, n_features, weight, score, rank of every document. Features are all runs of
    one to ``longest`` words; a document's weight is the mean gain of its features, its score
    the weight plus Gumbel noise that a hash of ``seed`` and the id fixes. Of the documents with
    at least ``least_words`` words the highest scores are drawn and ranked from 1, equal ones by
    the smaller id; the others' rank is null. Ranks come from ranges of scores, not one sort.

    A null or empty text has no features and weight 0. A null id counts as the empty string in
    the hash and comes last among equal scores. Repeated rows are documents of their own, in the
    order of their features' number and weight. An empty table gives an empty result, an empty
    target gains of the corpus alone.
    """
    rows = featured(docs, buckets, longest, id_col, text_col)
    aim = featured(target.select(F.lit(0).alias("doc_id"), F.col(target_col).alias("text")), buckets, longest)
    gain = gains(bucket_counts(rows, buckets), bucket_counts(aim, buckets))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")
    scored = checkpointed(weighted(rows, gain, least_words).withColumn("score", F.col("weight") + noise))
    many = scored.filter("long_enough")
    drawn = many.count() * percent // 100
    keyed = many.select("doc_id", "n_features", "weight", "score", (-F.col("score")).alias("down"), F.col("doc_id").isNull().alias("nameless"))
    ranked = numbered(keyed, [], ["down", "nameless", "doc_id", "n_features", "weight"], "rank")
    cols = ["doc_id", "n_features", "weight", "score"]
    in_draw = ranked.select(*cols, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return in_draw.unionByName(scored.filter(~F.col("long_enough")).select(*cols, F.lit(None).cast("bigint").alias("rank")))
