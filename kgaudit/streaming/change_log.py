"""Change log to current state as a stream (STR-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "node_key STRING, topic STRING, changed_at TIMESTAMP, batch BIGINT"


def latest_topics(changes: DataFrame) -> DataFrame:
    """Latest topic per node; repeated delivery of an event cannot change it, so the
    state is one row per node and holds no event ids."""
    newest = F.struct("changed_at", "seq")
    return changes.groupBy("node_key").agg(F.max_by("new_topic", newest).alias("topic"), F.max("changed_at").alias("changed_at"))


def start_state(changes: DataFrame, table: str, checkpoint: str, **trigger):
    """Write the nodes that changed in each micro-batch as a partition of ``table``."""
    changes.sparkSession.createDataFrame([], SCHEMA).write.mode("ignore").partitionBy("batch").parquet(table)

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return (
        latest_topics(changes).writeStream.outputMode("update").foreachBatch(apply)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def current_state(spark: SparkSession, table: str) -> DataFrame:
    versions = spark.read.schema(SCHEMA).parquet(table)
    return versions.groupBy("node_key").agg(F.max_by(F.struct("topic", "changed_at"), "batch").alias("_v")).select("node_key", "_v.*")
