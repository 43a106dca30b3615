"""Session helpers shared by iterative and ordered operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder on the storage all executors share.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``. Only a local
    master without that setting (tests) gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a re-read instead of the whole history, and later steps
    prune columns in the scan.
    """
    path = shared_folder(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], buckets: int | None = None, deal: bool = True) -> DataFrame:
    """Like ``checkpointed``, but stored in buckets by a hash of ``keys``.

    Joins with it and groups of it by these keys need no shuffle of its rows. There are as many
    buckets as shuffle partitions, unless told otherwise, so that a shuffled side meets it as it is.
    The rows are dealt out by the keys first; without ``deal`` each task writes to the buckets of
    the rows that it has. The name in the session's catalog is only a handle on the files.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.sparkSession.table(stored_in_buckets(df, keys, n, deal)[0])


def stored_in_buckets(df: DataFrame, keys: list[str], buckets: int, deal: bool = True) -> tuple[str, str]:
    """Store ``df`` in so many buckets of ``keys``; the name of the table and the folder of its files."""
    name, path = f"stored_{uuid.uuid4().hex}", shared_folder(df.sparkSession, "buckets")
    dealt = df.repartition(buckets, *keys) if deal else df
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, *keys).saveAsTable(name)
    return name, path


def ordinal(df: DataFrame, keys: list[str], seq: str, ties: list[str], out: str) -> DataFrame:
    """1-based position of each row inside its key, ordered by ``seq`` then ``ties``.

    ``seq`` is an integer column; a null counts as zero. A hot key is spread over many tasks,
    also where ``seq`` is the same or small everywhere (see ``numbered``).
    """
    cols = df.columns
    return numbered(df.withColumn("_ord_seq", F.coalesce(F.col(seq), F.lit(0))), keys, ["_ord_seq", *ties], out).select(*cols, out)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key by ``order``.

    An aggregate over a struct instead of a window: each task keeps one row per key
    before the shuffle, so a hot key costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    payload = F.struct(*rest) if rest else F.lit(1)
    best = df.groupBy(*keys).agg(F.min_by(payload, rank).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest]).select(*df.columns)


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """1-based position of each row inside its key, in the ascending order of ``order``.

    The rows are dealt out by ranges of (keys, order) and stored, then numbered inside each
    range, and the row counts of the key's earlier ranges are added. So one key that owns most
    of the table is spread over many tasks, whatever its values are. Nulls come first.
    """
    cols = df.columns
    ranged = df.repartitionByRange(*keys, *order).withColumn("_num_range", F.spark_partition_id())
    stored = checkpointed(ranged)
    sizes = stored.groupBy(*keys, "_num_range").agg(F.count(F.lit(1)).alias("_num_rows"))
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("_num_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_num_key_{k}") for k in keys], F.col("_num_range").alias("_num_range_k"),
        F.coalesce(F.sum("_num_rows").over(before), F.lit(0)).alias("_num_offset"),
    )
    inside = Window.partitionBy(*keys, "_num_range").orderBy(*order)
    local = stored.withColumn("_num_pos", F.row_number().over(inside))
    same = F.col("_num_range") == F.col("_num_range_k")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_num_key_{k}"))
    return local.join(offsets, same).select(*cols, (F.col("_num_pos") + F.col("_num_offset")).cast("bigint").alias(out))


# Rows of a list in ``paired``: whole groups of values in a bit-packed run of Parquet, at most 63 of 8.
PAIRED_LIST = 504
# The lists of a key are dealt to so many places at least, each of so many pairs or more; a list has one more per so many pairs.
PLACES, PLACE_PAIRS, MORE_PAIRS = 16, 2048, 1 << 26


def paired(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", size: int = PAIRED_LIST,
    without: DataFrame | None = None, own: str = "", item: str = "",
) -> DataFrame:
    """``left`` joined with ``right`` by ``keys``, for pairs that are many more than the rows of both.

    The rows of ``right`` are put in lists of at most ``size`` per key. A row of ``left`` is sent to each
    list of its key and meets one row there, so what is shuffled and sorted is a ``size``-th of the pairs.
    A hot key is dealt out by its lists, and a list that many rows meet by shares of these. The tasks are as many
    as shuffle partitions, however small the input of the join. Pairs come list by list: repeated values follow
    each other, and the files stay small. ``how`` is inner or left.

    ``without`` (inner only) has pairs that are left out: distinct values of the column ``own`` of ``left``, of the
    keys and of the column ``item`` of ``right``. They become places in the lists, which are cut out of them
    whole, so a pair that stays is not compared with any.
    """
    cols = [c for c in right.columns if c not in keys]
    at = ordinal(right.withColumn("_same", F.lit(0)), keys, "_same", cols, "_at").withColumn("_list", F.floor((F.col("_at") - 1) / size))
    lists = checkpointed(at.groupBy(*keys, "_list").agg(F.collect_list(F.struct(*cols)).alias("_items")))
    sent = left.withColumn("_cuts", F.lit(None).cast("array<struct<_list: bigint, _cut: array<int>>>"))
    if without is not None:
        places = lists.select(*keys, "_list", F.posexplode(F.col("_items")[item]).alias("_place", item))
        cuts = without.join(places, [*keys, item]).groupBy(own, *keys, "_list").agg(F.array_sort(F.collect_list(F.col("_place") + 1)).alias("_cut"))
        sent = left.join(cuts.groupBy(own, *keys).agg(F.collect_list(F.struct("_list", "_cut")).alias("_cuts")), [own, *keys], "left")
    sent = checkpointed(sent.select(*left.columns, "_cuts"))
    sizes = lists.groupBy(*keys).agg(F.max("_list").alias("_last"), F.max(F.size("_items")).cast("bigint").alias("_most"))
    pairs = F.col("_rows") * F.col("_most")
    shares = F.least(F.ceil(pairs / PLACE_PAIRS), F.floor(pairs / MORE_PAIRS) + F.ceil(F.lit(PLACES) / (F.col("_last") + 1)))
    known = sizes.join(sent.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys).select(*keys, "_last", shares.alias("_shares"))
    zero = F.lit(0).cast("bigint")
    every = F.sequence(zero, "_last")
    whole = F.transform(F.when(F.col("_cuts").isNull(), every).otherwise(F.array_except(every, F.col("_cuts")["_list"])),
                        lambda n: F.struct(n.alias("_list"), F.lit(None).cast("array<int>").alias("_cut")))
    sent = sent.join(known, keys, how).select(
        *left.columns, F.pmod(F.xxhash64(*left.columns), "_shares").alias("_share"), F.explode_outer(F.concat(F.coalesce("_cuts", F.array().cast("array<struct<_list: bigint, _cut: array<int>>>")), whole)).alias("_to"))
    sent = sent.select(*left.columns, "_share", "_to._list", "_to._cut")
    offered = lists.join(known.drop("_last"), keys).withColumn("_share", F.explode(F.sequence(zero, F.col("_shares") - 1))).drop("_shares")
    met = [*keys, "_list", "_share"]
    dealt = sent.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *met)
    joined = dealt.join(offered.hint("merge"), met, how)
    if without is None:
        return joined.select(*left.columns, (F.inline if how == "inner" else F.inline_outer)("_items"))

    def stretch(i: Column) -> Column:
        """What lies between two cuts."""
        first = F.when(i == 0, 1).otherwise(F.get("_cut", i - 1) + 1)
        return F.slice("_items", first, F.coalesce(F.get("_cut", i), F.size("_items") + 1) - first)

    rest = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_cut")), stretch))
    # In a column of its own, so that the rows themselves are made by generated code.
    return joined.select(*left.columns, F.when(F.col("_cut").isNull(), F.col("_items")).otherwise(rest).alias("_items")).select(*left.columns, F.inline("_items"))
