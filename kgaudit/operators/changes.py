"""Topic write-back as an append-only log (CHG-1..4).

A log row is (node_key, node_type, node_label, old_topic, new_topic, changed_by,
changed_at, execution_flow_key, is_undo).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx
from kgaudit.session import ordinal

# Labels whose topic may be written.
ALLOWED_LABELS = [
    "Snippet", "DBCall", "Calculation", "ServiceCall", "InputEntity", "InputInterface", "Variable",
    "Job", "Step", "JclJob", "DatabaseEntity", "DatabaseField",
]


def checked_label(c: Column | str) -> Column:
    """The label itself; any other label fails the job."""
    label = fx.col(c)
    refused = F.raise_error(F.concat(F.lit("label not allowed: "), fx.text(label))).cast("string")
    return F.when(label.isin(ALLOWED_LABELS), label).otherwise(refused)


def log_updates(nodes: DataFrame, updates: DataFrame, changed_by: str = "bulk") -> DataFrame:
    """CHG-1: log rows of ``updates`` (seq, node_key, node_label, new_topic, changed_at,
    execution_flow_key) on nodes that carry the label.

    The old topic is the node's for the first update of a node and the previous
    update's afterwards.
    """
    known = nodes.select(F.col("key").alias("node_key"), fx.text("topic").alias("_topic"), "labels")
    # The old-topic expression reads the checked label, so the check cannot be pruned.
    wanted = updates.withColumn("node_label", checked_label("node_label"))
    hits = wanted.join(known, "node_key").where(F.array_contains("labels", F.col("node_label"))).drop("labels")
    placed = ordinal(hits, ["node_key"], "seq", ["new_topic"], "_pos")
    before = placed.select("node_key", (F.col("_pos") + 1).alias("_pos"), F.col("new_topic").alias("_before"))
    return placed.join(before, ["node_key", "_pos"], "left").select(
        "node_key", F.col("node_label").alias("node_type"), "node_label", F.coalesce("_before", "_topic").alias("old_topic"), "new_topic",
        F.lit(changed_by).alias("changed_by"), "changed_at", "execution_flow_key", F.lit(False).alias("is_undo"), "seq",
    )


def current_topics(log: DataFrame) -> DataFrame:
    """CHG-4: latest topic of every changed node."""
    newest = F.struct("changed_at", "seq")
    return log.groupBy("node_key").agg(F.max_by("new_topic", newest).alias("topic"), F.max("changed_at").alias("changed_at"))


def apply_log(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """CHG-1: a new version of the node table with the logged topics."""
    latest = current_topics(log).select(F.col("node_key").alias("key"), F.col("topic").alias("_topic"), F.lit(True).alias("_set"))
    return nodes.join(latest, "key", "left").withColumn(
        "topic", F.when(F.col("_set"), F.col("_topic")).otherwise(F.col("topic"))
    ).select(*nodes.columns)


def undo_all(log: DataFrame, at: Column) -> DataFrame:
    """CHG-2: one undo row per change that is not itself an undo.

    Restoring newest first ends at the oldest old topic, so the rows are numbered
    backwards and the last one applied belongs to the oldest change.
    """
    return log.where("NOT is_undo").select(
        "node_key", "node_type", "node_label", F.lit("(reverted)").alias("old_topic"), F.col("old_topic").alias("new_topic"),
        F.lit("undo").alias("changed_by"), at.alias("changed_at"), "execution_flow_key", F.lit(True).alias("is_undo"), (-F.col("seq")).alias("seq"),
    )


def restored_topics(log: DataFrame) -> DataFrame:
    """CHG-2, net effect: the old topic of the oldest change of every node."""
    return log.where("NOT is_undo").groupBy("node_key").agg(F.min_by("old_topic", F.struct("changed_at", "seq")).alias("topic"))


def select_updates(suggestions: DataFrame, selection: DataFrame, on: str = "node_key") -> DataFrame:
    """CHG-3: the suggestions of the selected nodes, groups or flows."""
    usable = suggestions.where(~fx.is_blank("suggested_topic"))
    return usable.join(selection.select(on).distinct(), on, "left_semi")


def clear_log(log: DataFrame) -> DataFrame:
    """CHG-4."""
    return log.limit(0)
