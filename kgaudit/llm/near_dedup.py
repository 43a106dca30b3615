"""Near duplicates by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from kgaudit.llm.arrow import map_texts
from kgaudit.llm.components import components
from kgaudit.llm.exprs import narrow, unused
from kgaudit.llm.hashing import mix, shingle_set
from kgaudit.session import checkpointed

WIDTH = 5
# A pair of similarity 0.75 shares none of the bands with a probability of
# (1 - 0.75^4)^48, about 1e-8.
BANDS, ROWS = 48, 4
# In a bucket of up to this many members, each one outside its largest component is paired with
# all others; larger buckets are compared block by block.
SMALL = 64
# Members of a block in large buckets; blocks are compared with one another on full sets.
BLOCK = 512
# Shingles that a comparison of two blocks looks at together.
_SLICE = 8192
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 48) - 1)


def similarity_sketch(items: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes.

    Round i throws every element into one bin by the round's own hash; a bin keeps the
    smallest (round, value). After ``bins`` rounds, each bin that is still free gets a round
    in which all elements go to it. So every coordinate is filled, and two sets agree in a
    coordinate with the probability of their similarity, concentrated as if the coordinates
    were drawn without replacement. Rounds stop once all bins are filled, after about
    bins * log(bins) throws; several are taken at once for a small set.
    """
    out = np.full(bins, _FREE, np.uint64)
    together = max(1, math.ceil(bins * (math.log(bins) + 1) / len(items)))
    first = 0
    while first < bins and (out == _FREE).any():
        rounds = np.arange(first, min(first + together, bins), dtype=np.uint64)
        h = mix(items[None, :] + (rounds[:, None] + np.uint64(1)) * _GOLDEN)
        place = ((h >> np.uint64(48)) * np.uint64(bins)) >> np.uint64(16)
        np.minimum.at(out, place.ravel().astype(np.intp), ((rounds[:, None] << np.uint64(48)) | (h & _LOW)).ravel())
        first += len(rounds)
        together = max(1, together // 4)
    for b in np.flatnonzero(out == _FREE):
        last = np.array([bins + b], np.uint64)
        out[b] = ((last << np.uint64(48)) | (mix(items + (last + np.uint64(1)) * _GOLDEN) & _LOW)).min()
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band, which covers the band's number and its coordinates."""
    key = np.arange(bands, dtype=np.uint64) * _GOLDEN
    for row in sketch.reshape(bands, -1).T:
        key = mix((key ^ row) * _GOLDEN + np.uint64(1))
    return key.view(np.int64)


def signatures(rows: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the set; null for an empty one), bands. Stored."""

    def start():
        def sign(texts: list[str]) -> list[list]:
            sizes, keys, bands = [], [], []
            for t in texts:
                items = shingle_set(t, WIDTH)
                sizes.append(len(items))
                keys.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                bands.append(band_keys(similarity_sketch(items)) if len(items) else [])
            return [sizes, keys, bands]

        return sign

    added = StructType([StructField("n_shingles", LongType()), StructField("set_key", BinaryType()), StructField("bands", ArrayType(LongType()))])
    return checkpointed(map_texts(rows, start, added))


def shingle_sets(rows: DataFrame) -> DataFrame:
    """doc_id, items: the full sorted shingle set of each row. Stored."""

    def start():
        return lambda texts: [[shingle_set(t, WIDTH).view(np.int64) for t in texts]]

    return checkpointed(map_texts(rows, start, StructType([StructField("items", ArrayType(LongType()))])))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the stored pairs (a, b) whose full sets are similar enough. Stored."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b"))
    n, m = F.size("items_a"), F.size("items_b")
    common = F.size(F.array_intersect("items_a", "items_b"))
    # The sizes alone rule out most false candidates.
    close = (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (common * 100 >= (n + m - common) * percent)
    return checkpointed(pairs.join(right, "b").join(left, "a").filter(close).select("a", "b").distinct())


def _stars(members: DataFrame) -> DataFrame:
    """Stored pairs of each member of a bucket with the bucket's pivot."""
    return checkpointed(members.filter("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct())


def _bucketed(rows: DataFrame) -> DataFrame:
    """Stored members (bucket, id, pivot, n) of buckets with two rows or more.

    The pivot is the smallest id, so that a group of near copies costs one pair per copy.
    """
    stats = checkpointed(rows.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return checkpointed(rows.join(stats, "bucket"))


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored members of buckets that hold several components and pairs not yet compared.

    With each member's component, the bucket's largest one (``main``), how many members
    the bucket has (``members``), and its smallest id (``least``).
    """
    marked = members.filter("n > 2").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    marked = checkpointed(marked.select("bucket", "id", "component"))
    parts = marked.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least"))
    whole = parts.groupBy("bucket").agg(F.sum("size").alias("n"), F.max("size").alias("most"), F.max_by("component", "size").alias("main"), F.min("least").alias("least"))
    mixed = checkpointed(whole.filter("n > most").select("bucket", "main", "least", F.col("n").alias("members")))
    return checkpointed(marked.join(mixed, "bucket"))


def _block_links(percent: int):
    """Function of one pair of blocks (first, second, block, id, component, items): links between components.

    All rows of the first block are compared with all of the second by their full sets. Of the
    links found, those that connect what the blocks' other links already connect are left out.
    """

    def compare(table: pa.Table) -> pa.Table:
        items = table.column("items")
        sizes = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in items.chunks]).astype(np.int64)
        values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in items.chunks])
        ids, component, block = (table.column(c).to_numpy() for c in ("id", "component", "block"))
        left, right = np.flatnonzero(block == table.column("first")[0].as_py()), np.flatnonzero(block == table.column("second")[0].as_py())
        _, number, held = np.unique(values, return_inverse=True, return_counts=True)
        # Shingles of one row only are common to no pair.
        place = np.cumsum(held > 1) - 1
        owner = np.repeat(np.arange(len(ids)), sizes)[held[number] > 1]
        number = place[number[held[number] > 1]]
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
        common = np.zeros((len(left), len(right)), np.int64)
        for start in range(0, int(number[-1]) + 1 if len(number) else 0, _SLICE):
            lo, hi = np.searchsorted(number, [start, start + _SLICE])
            has = np.zeros((len(ids), _SLICE), np.float32)
            has[owner[lo:hi], number[lo:hi] - start] = 1
            common += (has[left] @ has[right].T).astype(np.int64)
        n, m = sizes[left][:, None], sizes[right][None, :]
        close = (common * 100 >= (n + m - common) * percent) & (component[left][:, None] != component[right][None, :])
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        found = []
        for i, j in np.argwhere(close).tolist():
            x, y = top(int(component[left[i]])), top(int(component[right[j]]))
            if x != y:
                root[x] = y
                found.append(sorted((int(ids[left[i]]), int(ids[right[j]]))))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return compare


def _large_links(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored links between components of large buckets (id, component, least): all that are needed.

    Buckets that share members make a family, so that each member's set moves with its family
    and not with each of its buckets. A family's members outside its largest component
    are cut into blocks of about ``BLOCK`` by a hash, and so are the others; each block of the
    former meets every block. Rows grow with the blocks, not with the pairs.
    """
    families = components(large.select(F.col("id").alias("a"), F.col("least").alias("b"))).withColumnRenamed("component", "family")
    rows = checkpointed(large.select("id", "component").distinct().join(families, "id"))
    parts = rows.groupBy("family", "component").agg(F.count(F.lit(1)).alias("size"))
    stats = parts.groupBy("family").agg(F.sum("size").alias("n"), F.max("size").alias("most"), F.max_by("component", "size").alias("main"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    stats = checkpointed(stats.select("family", "main", blocks(F.col("n") - F.col("most")).alias("minors"), blocks(F.col("most")).alias("mains")))
    at = lambda n: F.pmod(F.xxhash64("id", F.lit("block")), n).cast("int")
    outside = F.col("component") != F.col("main")
    dealt = rows.join(stats, "family").withColumn("block", F.when(outside, at(F.col("minors"))).otherwise(F.col("minors") + at(F.col("mains"))))
    others = F.sequence(F.lit(0), F.when(outside, F.col("minors") + F.col("mains")).otherwise(F.col("minors")) - 1)
    dealt = dealt.withColumn("with", F.explode(others)).select("family", F.least("block", "with").alias("first"), F.greatest("block", "with").alias("second"), "block", "id", "component")
    met = checkpointed(dealt).join(sets.withColumnRenamed("doc_id", "id"), "id")
    return checkpointed(met.groupBy("family", "first", "second").applyInArrow(_block_links(percent), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of near duplicates: doc_id, n_shingles, component_id, kept.

    Two documents are linked when their sets of 5-word shingles have 100 * intersection >=
    ``percent`` * union; a group is what links connect, named by its smallest id, which is
    the one to keep. Words are runs of anything but ASCII white space, A-Z lower-cased; a text
    of fewer words is one shingle, and a text without words has none and stands alone.

    Documents with equal sets are merged first. A band's bucket is compared with one of its
    members only; where that leaves several components, members outside the largest one are
    compared with all others: as pairs in a small bucket, and else block by block. No bucket is
    cut off or sampled. Every link is confirmed on the full sets.

    Rows with a null id are linked with nothing and kept. Rows that repeat an id are one
    document with several texts. An empty table gives an empty result.
    """
    rows = narrow(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    signed = signatures(rows)
    classes = checkpointed(
        signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    )
    members = _bucketed(classes.select("id", F.explode("bands").alias("bucket")))
    near = checkpointed(members.select(F.col("id").alias("doc_id")).distinct())
    sets = shingle_sets(rows.join(near, "doc_id", "left_semi"))
    links = verified(_stars(members), sets, percent)
    labels = components(links)
    waiting = _open_buckets(members, labels)
    small = waiting.filter(F.col("members") <= SMALL)
    one = small.filter("component <> main").select("bucket", "id", "component")
    other = small.select("bucket", F.col("id").alias("other"), F.col("component").alias("other_component"))
    inside = one.join(other, "bucket").filter("component <> other_component").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    found = verified(checkpointed(inside), sets, percent)
    large = waiting.filter(F.col("members") > SMALL)
    if not large.isEmpty():
        found = found.union(_large_links(large, sets, percent))
    if not found.isEmpty():
        links = checkpointed(links.union(found).distinct())
        labels = components(links)
    named = classes.select("set_key", "id").join(labels, "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    # An id with several texts links the groups of all of them.
    if not classes.groupBy("id").count().filter("count > 1").isEmpty():
        own = signed.filter("doc_id IS NOT NULL").join(named, "set_key").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        joint = components(own)
        named = named.join(joint, F.col("component_id") == F.col("id"), "left").select("set_key", F.coalesce("component", "component_id").alias("component_id"))
    named = checkpointed(named)
    found = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document stays: one of each group of near duplicates; of repeated rows one stays."""
    keep_id = unused(docs, "keep_id")
    kept = near_duplicates(docs, percent, id_col, text_col).filter("kept").select(F.col("doc_id").alias(keep_id)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(keep_id)), "left_semi").select(*docs.columns)
