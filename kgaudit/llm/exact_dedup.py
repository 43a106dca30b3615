"""Exact duplicates by 128-bit content hash, with a comparison of the bytes inside each hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgaudit.llm.exprs import ascii_lower, narrow, unused
from kgaudit.session import checkpointed


def content_hash(text: Column) -> Column:
    """128 bits of a text, as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hash_of=content_hash,
) -> DataFrame:
    """Copies of each text, one row per input row.

    Texts are equal when they are identical after lower-casing A-Z; a null text is an empty
    one. Of equal texts the row with the smallest (``keep="largest"``: largest) id stays.
    Returns doc_id, keep_id, group_size, kept, text_sha256.

    The rows are grouped by (hash, text): the hash deals them out and the key comparison of
    the aggregate compares the bytes, so two texts that share a hash form two classes. Tasks
    merge their copies before the shuffle, so a text that a third of all rows hold costs one
    row per task. Afterwards only hashes and ids move. Where a hash holds several classes,
    and only there, rows find their class by the text itself.

    Rows with a null id stay only if no row of their class has an id. Rows that repeat the
    kept id and text are all marked as kept. An empty table gives an empty result.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    norm = narrow(docs, id_col, text_col).select("doc_id", ascii_lower("text").alias("norm"))
    hashed = norm.withColumn("hash", hash_of(F.col("norm")))
    texts = hashed.groupBy("hash", "norm").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # A hash with one class needs no text from here on.
    classes = checkpointed(
        texts.select("hash", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    shared = classes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
    row = [F.col("doc_id"), F.col("keep_id"), F.col("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("text_sha256")]
    if shared.isEmpty():
        return hashed.select("doc_id", "hash").join(classes, "hash").select(*row)
    split = shared.withColumn("shared", F.lit(True))
    tagged = hashed.join(split, "hash", "left").withColumn("by_text", F.when(F.col("shared"), F.col("norm")))
    keyed = texts.join(split, "hash", "left").select(
        "hash", F.when(F.col("shared"), F.col("norm")).alias("class_text"), "keep_id", "group_size",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
    )
    same = (F.col("l.hash") == F.col("r.hash")) & F.col("by_text").eqNullSafe(F.col("class_text"))
    return tagged.alias("l").join(keyed.alias("r"), same).select(*row)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one stays."""
    keep_id, keep_sha, row_sha = (unused(docs, n) for n in ("keep_id", "keep_sha", "row_sha"))
    kept = exact_duplicates(docs, id_col, text_col, keep).filter("kept").select(F.col("doc_id").alias(keep_id), F.unhex("text_sha256").alias(keep_sha)).distinct()
    sha = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256))
    marked = docs.withColumn(row_sha, sha)
    same = F.col(id_col).eqNullSafe(F.col(keep_id)) & (F.col(row_sha) == F.col(keep_sha))
    return marked.join(kept, same, "left_semi").dropDuplicates([id_col, row_sha]).select(*docs.columns)
