"""Packing token pieces into windows of fixed size by best-fit decreasing."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from kgaudit.llm.arrow import map_texts
from kgaudit.llm.exprs import narrow
from kgaudit.llm.tokenizing import load_tokenizer, piece_ids, piece_memo, pieces
from kgaudit.session import checkpointed

WINDOW = 1024
# Short pieces that one task packs together. More leave less padding, and take longer.
SHARD_PIECES = 8192


class CapacityTree:
    """Open windows by remaining capacity: a segment tree over the capacities 0 to ``size``.

    A node counts the open windows below it; a query walks to the smallest capacity that is
    large enough and has one.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        node = capacity + self.leaves
        while node:
            self.counts[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the tightest window with room for ``need``."""
        node = need + self.leaves
        if not self.counts[node]:
            # Up to the first right neighbour that holds an open window, then down to its left edge.
            while node > 1 and (node & 1 or not self.counts[node ^ 1]):
                node >>= 1
            if node <= 1:
                return None
            node ^= 1
            while node < self.leaves:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            self.counts[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each piece: the longest first, each into the tightest open window."""
    tree = CapacityTree(window)
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            capacity, at, opened = window, opened, opened + 1
        else:
            capacity, at = found
        number[i], offset[i] = at, window - capacity
        if capacity > need:
            tree.add(capacity - need, at)
    return number, offset


def token_pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of each document and ``end_id``, cut into full windows and a rest.

    Returns doc_id, start, length, ids_crc32 (of the piece's little-endian 32-bit ids),
    doc_tokens, stored once. No piece is empty: each document has at least its end id.
    """

    def begin():
        tokenizer = load_tokenizer(path)
        memo = piece_memo(path, piece_ids)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * window

        def cut(texts: list[str]) -> list[list]:
            parts = [pieces(t) for t in texts]
            known = iter(memo.of([p for p in parts if p is not None]))
            crcs, sizes = [], []
            for t, p in zip(texts, parts, strict=True):
                if p is None:
                    ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() + end
                else:
                    ids = b"".join(next(known)) + end
                crcs.append([zlib.crc32(ids[i : i + step]) for i in range(0, len(ids), step)])
                sizes.append(len(ids) // 4)
            return [crcs, sizes]

        return cut

    added = StructType([StructField("crcs", ArrayType(LongType())), StructField("doc_tokens", LongType())])
    done = map_texts(narrow(docs, id_col, text_col), begin, added)
    rows = done.select("doc_id", "doc_tokens", F.posexplode("crcs").alias("no", "ids_crc32"))
    start = F.col("no").cast("bigint") * window
    return checkpointed(rows.select("doc_id", start.alias("start"), F.least(F.lit(window), F.col("doc_tokens") - start).cast("bigint").alias("length"), "ids_crc32", "doc_tokens"))


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 0, shard_pieces: int = SHARD_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in windows of at most ``window`` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document longer
    than a window is first cut into full windows, each a sequence of its own (odd ids); its
    rest and the short documents are dealt evenly to shards of about ``shard_pieces`` pieces,
    whatever their keys, and each shard is packed by best-fit decreasing (even ids).

    A null or empty text consists of its end id. Repeated rows and null ids are documents of
    their own. An empty table gives an empty result.
    """
    cut = token_pieces(docs, path, window, end_id, id_col, text_col)
    cols = cut.columns
    whole = cut.filter(F.col("length") == window).select(*cols, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    short = cut.filter(F.col("length") < window)
    shards = short.count() // shard_pieces + 1
    # The row's place in the stored table deals it out, so that no key can fill a shard.
    dealt = short.select(*cols, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).alias("shard"))

    def fill(table: pa.Table) -> pa.Table:
        number, offset = best_fit(table.column("length").to_numpy(), window)
        sequence = 2 * (number * shards + table.column("shard")[0].as_py())
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    packed = dealt.groupBy("shard").applyInArrow(fill, whole.schema)
    return whole.unionByName(packed)
