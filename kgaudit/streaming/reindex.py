"""Incremental re-index as a stream (STR-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "chunk_key STRING, content_hash STRING, content STRING, seq BIGINT, batch BIGINT, part INT"
# Parts of the table by a hash of the key; a batch reads only the parts that its keys are in.
PARTS = 64


def part_of(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def current_index(spark: SparkSession, table: str) -> DataFrame:
    """Newest version of every chunk of the versioned table at ``table``."""
    versions = spark.read.schema(SCHEMA).parquet(table)
    newest = F.max_by(F.struct("content_hash", "seq"), "seq").alias("_v")
    # A version without text repeats the one before it.
    text = F.max_by("content", F.when(F.col("content").isNotNull(), F.col("seq"))).alias("content")
    return versions.groupBy("chunk_key").agg(newest, text).select("chunk_key", "_v.content_hash", "content", "_v.seq")


def _stored(spark: SparkSession, table: str, before: int, parts: list[int]) -> DataFrame:
    """Hash and sequence of the chunks of some parts, as of the batches before ``before``; no text is read."""
    versions = spark.read.schema(SCHEMA).parquet(table).where((F.col("batch") < before) & F.col("part").isin(parts))
    return versions.groupBy("chunk_key").agg(F.max_by("content_hash", "seq").alias("_hash"), F.max("seq").alias("_seq"))


def start_reindex(chunks: DataFrame, table: str, checkpoint: str, **trigger):
    """Append the newer chunks of every micro-batch (chunk_key, content_hash, content, seq).

    Of several versions of a chunk, in one batch or over many, the one with the largest
    ``seq`` is the newest, in whatever order they arrive; of equal ones the largest hash. A newer
    version with the same hash is noted without its text. A batch writes only its own
    partition and compares with earlier batches only, so a replayed batch rewrites the same
    rows, and the stored table is never rewritten.
    """
    spark = chunks.sparkSession
    spark.createDataFrame([], SCHEMA).write.mode("ignore").partitionBy("batch", "part").parquet(table)

    def apply(batch: DataFrame, batch_id: int) -> None:
        newest = F.max_by(F.struct("content_hash", "content", "seq"), F.struct("seq", "content_hash")).alias("_v")
        one = batch.groupBy("chunk_key").agg(newest).select("chunk_key", "_v.*", part_of("chunk_key").alias("part"))
        parts = [r["part"] for r in batch.select(part_of("chunk_key").alias("part")).distinct().collect()]  # PARTS at most
        known = _stored(batch.sparkSession, table, batch_id, parts)
        newer = one.join(known, "chunk_key", "left").where("_seq IS NULL OR seq > _seq")
        text = F.when(~F.col("content_hash").eqNullSafe(F.col("_hash")), F.col("content")).alias("content")
        newer.select("chunk_key", "content_hash", text, "seq", "part").write.mode("overwrite").partitionBy("part").parquet(f"{table}/batch={batch_id}")

    return chunks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
