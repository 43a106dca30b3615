"""Chunk identity, incremental filter, fingerprints and exact vector search (SIM-5..9, TOP-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx



def chunk_key(path, cls, fn, line) -> Column:
    """SIM-5: identity of a chunk."""
    return F.md5(F.concat_ws("::", fx.text(path), fx.text(cls), fx.text(fn), fx.col(line).cast("string")))


def content_hash(content) -> Column:
    return F.md5(fx.text(content))


def changed_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """SIM-6: chunks that are new or whose stored hash differs; deletions stay stored."""
    return chunks.join(stored.select("chunk_key", "content_hash"), ["chunk_key", "content_hash"], "left_anti")


def change_counts(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """SIM-6, counters of one run."""
    same = stored.select("chunk_key", "content_hash", F.lit(1).alias("_same")).dropDuplicates(["chunk_key", "content_hash"])
    return chunks.join(same, ["chunk_key", "content_hash"], "left").agg(
        F.count_if(F.col("_same").isNull()).alias("changed"), F.count("_same").alias("unchanged"))


def fingerprint(files: DataFrame, by: list[str]) -> DataFrame:
    """SIM-7: one value per group that changes whenever a path or a size does.

    The entry digests are summed in four 32-bit lanes instead of being sorted into one
    text: each task keeps four numbers per group, whatever the group's size.
    """
    entry = F.md5(F.concat_ws(":", "path", F.col("size").cast("string")))
    lanes = [F.conv(F.substring(entry, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    sums = files.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), *[F.sum(x.cast("decimal(38,0)")).alias(f"_s{i}") for i, x in enumerate(lanes)])
    mixed = F.md5(F.concat_ws(":", F.col("files").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(4)]))
    return sums.select(*by, "files", mixed.alias("fingerprint"))


def embedding_text(chunks: DataFrame) -> DataFrame:
    """SIM-8: metadata lines, an empty line, then the content."""
    cls = fx.text("class_name")
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("language: "), fx.text("language")), F.concat(F.lit("file: "), fx.text("file_path")),
        F.when(cls != "", F.concat(F.lit("class: "), cls)), F.concat(F.lit("function: "), fx.text("function_name")),
        F.lit(""), fx.text("content"),
    )
    return chunks.withColumn("embedding_text", body)


def index_status(chunks: DataFrame) -> DataFrame:
    """SIM-9."""
    return chunks.agg(F.count(F.lit(1)).alias("total_chunks"))


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def nearest(vectors: DataFrame, query: Column, k: int) -> DataFrame:
    """TOP-2: the ``k`` nearest vectors by cosine distance.

    ``query`` is a literal array. Exact: one scan in which every task keeps its best
    ``k`` rows.
    """
    scored = vectors.withColumn("distance", cosine_distance(F.col("embedding"), query))
    return scored.orderBy("distance", "vec_id").limit(k)
