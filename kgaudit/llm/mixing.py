"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kgaudit.llm.exprs import unused, word_count
from kgaudit.session import checkpointed, numbered

# The golden ratio's fractional part in units of 2^-31, made odd, so that the points of a
# whole period are all different.
GOLDEN, PERIOD = 1327217885, 1 << 31
# Slots of one numbering task; rows of one source that one placing task takes.
SLOT_CHUNK, PLACE_ROWS = 1 << 16, 1_000


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size (words; 0 for a null text), stored once."""
    return checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """source, source_no, source_size, n_docs, target for each source of ``sizes``.

    Sources in the order of their code points, null last, weigh ``weights``, repeating. They
    share the words of all documents by weight; no target exceeds ``max_repeat`` times its
    source's size, and what is above that goes to the others by weight until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = numbered(totals.withColumn("last", F.col("source").isNull()), [], ["last", "source"], "no")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("no") - 1) % len(weights) + 1).cast("int"))
    table = checkpointed(ranked.select("source", (F.col("no") - 1).alias("source_no"), "source_size", "n_docs", weight.cast("bigint").alias("weight"), (F.col("source_size") * max_repeat).alias("most")))
    words, shares = table.agg(F.sum("source_size"), F.sum("weight")).first()
    share, before = (words / shares if shares else 0.0), None
    while share != before:  # two sums a round; a source that has reached its bound keeps it
        above = F.col("weight") * F.lit(share) > F.col("most")
        full, open_weight = table.agg(F.sum(F.when(above, F.col("most")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        share, before = ((words - full) / open_weight if open_weight else share), share
    return table.select("source", "source_no", "source_size", "n_docs", F.least(F.col("weight") * F.lit(float(share)), F.col("most").cast("double")).alias("target"))


def _blocks(words: Column, block: int) -> Column:
    return F.ceil(words / block).cast("bigint")


def schedule(targets: DataFrame, block_words: int = 256) -> DataFrame:
    """The slots of the mix: slot, source_no, pass, block, words.

    Slot i lies at the point frac(i * golden ratio) of the cumulated targets and belongs to
    the source that it hits there. The k-th slot of a source takes block k mod (its blocks), in
    pass k div (its blocks). A source's slots stop where its target is met, the last one
    inside a block; where the points fall short of that, its slots go on at the end (slot null).
    """
    spark = targets.sparkSession
    need = F.floor(F.col("target") + 0.5).cast("bigint")
    plan = targets.filter("source_size > 0").select(
        "source_no", "source_size", "target", _blocks(F.col("source_size"), block_words).alias("n_blocks"),
        F.floor(need / F.col("source_size")).cast("bigint").alias("passes"), (need % F.col("source_size")).alias("rest"),
    ).withColumn("n_slots", F.col("passes") * F.col("n_blocks") + _blocks(F.col("rest"), block_words))
    total, sources = targets.agg(F.sum("target"), F.count(F.lit(1))).first()
    n = int((total or 0) // block_words) + 1
    cells = 1 << min(20, max(10, (4 * sources).bit_length()))  # cells of the unit interval
    width = PERIOD // cells
    # Starts of the sources on the circle, and again at each cell that they cover.
    through = _running(plan, "target")
    at = lambda c: F.least(F.floor(F.col(c) / F.lit(float(total or 1)) * PERIOD).cast("bigint"), F.lit(PERIOD))
    spans = through.select("source_no", at("before").alias("lo"), at("after").alias("hi")).filter("lo < hi")
    starts = spans.select("source_no", "lo", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    marks = starts.select("cell", F.greatest(F.col("lo"), F.col("cell") * width).alias("point"), F.lit(-1).cast("bigint").alias("slot"), F.lit(0).alias("kind"), "source_no")
    points = spark.range(n).select(((F.col("id") % PERIOD) * GOLDEN % PERIOD).alias("point"), F.col("id").alias("slot"))
    dots = points.select(F.floor(F.col("point") / width).alias("cell"), "point", "slot", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("source_no"))
    along = Window.partitionBy("cell").orderBy("point", "kind", "slot").rowsBetween(Window.unboundedPreceding, 0)
    hit = checkpointed(marks.unionByName(dots).withColumn("source_no", F.last("source_no", ignorenulls=True).over(along)).filter("kind = 1 AND source_no IS NOT NULL").select("slot", "source_no", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk")))
    # Rank of a slot in its source: its place in its chunk and the counts of the chunks before.
    counts = hit.groupBy("source_no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpointed(counts.select("source_no", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")))
    inside = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    plan = checkpointed(plan)
    ranked = hit.withColumn("place", inside).join(offsets, ["source_no", "chunk"]).select("slot", "source_no", (F.col("place") + F.col("offset")).alias("rank"))
    planned = ranked.join(plan, "source_no").filter("rank < n_slots").select("slot", "source_no", "rank", "source_size", "n_blocks", "passes", "rest")
    have = counts.groupBy("source_no").agg(F.sum("n").alias("have"))
    short = plan.join(have, "source_no", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < n_slots")
    late = short.select(
        F.lit(None).cast("bigint").alias("slot"), "source_no", F.explode(F.sequence("have", F.col("n_slots") - 1)).alias("rank"), "source_size", "n_blocks", "passes", "rest",
    )
    turn, block = F.floor(F.col("rank") / F.col("n_blocks")).cast("bigint"), F.col("rank") % F.col("n_blocks")
    end = F.when(turn == F.col("passes"), F.col("rest")).otherwise(F.col("source_size"))
    return planned.unionByName(late).select(
        "slot", "source_no", turn.alias("pass"), block.alias("block"), F.least(F.lit(block_words), end - block * block_words).cast("bigint").alias("words"),
    )


def _running(plan: DataFrame, col: str) -> DataFrame:
    """``before`` and ``after``: sums of ``col`` over the sources in order, by chunks of sources."""
    chunked = plan.withColumn("part", F.floor(F.col("source_no") / SLOT_CHUNK))
    inside = Window.partitionBy("part").orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.withColumn("local", F.sum(col).over(inside))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunked.groupBy("part").agg(F.sum(col).alias("sum")).select("part", F.coalesce(F.sum("sum").over(earlier), F.lit(0.0)).alias("offset"))
    after = F.col("local") + F.col("offset")
    return local.join(offsets, "part").select("source_no", (after - F.col(col)).alias("before"), after.alias("after"))


def place(sizes: DataFrame, targets: DataFrame, seed: str = "") -> DataFrame:
    """Documents with words, laid end to end in each source in the order of a hash of their id.

    Returns doc_id, source_no, source_size, target, size, start (words of the source before it).
    A source is cut into runs of hash values, about ``PLACE_ROWS`` documents each, summed one by one.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    keyed = sizes.filter("size > 0").select("doc_id", "source", "size", key.alias("key"))
    own = targets.select(F.col("source").alias("own_source"), "source_no", "source_size", "target", F.ceil(F.col("n_docs") / PLACE_ROWS).cast("bigint").alias("runs"))
    run = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * F.col("runs") / (1 << 32))
    rows = keyed.join(own, F.col("source").eqNullSafe(F.col("own_source"))).withColumn("run", run)
    sums = rows.groupBy("source_no", "run").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpointed(sums.select("source_no", "run", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("source_no", "run").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("local", F.sum("size").over(inside)).join(offsets, ["source_no", "run"]).select(
        "doc_id", "source_no", "source_size", "target", "size", (F.col("local") + F.col("offset") - F.col("size")).alias("start"),
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, block_words: int = 256,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "",
) -> DataFrame:
    """Words that the mix takes of each document: doc_id, size, source_size, target, taken.

    A document lies in one or more blocks of its source; it gives its part of a block to every
    slot that the block fills. A source's taken words are its target rounded; no document gives
    more than ``max_repeat`` times its size. Documents without words (null, empty or blank
    texts) take no part and come with taken 0. A null source is a source of its own. Repeated
    rows are documents of their own. The same rows give the same mix in every run.
    """
    sizes = sized(docs, id_col, source_col, text_col)
    targets = checkpointed(source_targets(sizes, weights, max_repeat))
    slots = schedule(targets, block_words)
    # A block's slots: whole ones, and at most one that stops inside it.
    used = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"), F.max("words").alias("full"))
    placed = place(sizes, targets, seed)
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0))
    hi = F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words))
    length = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    whole = F.floor(F.col("words") / length)
    part = F.greatest(F.least(hi, F.col("words") - whole * length) - lo, F.lit(0))
    given = F.coalesce(whole * (hi - lo) + part, F.lit(0))
    taken = pieces.join(used, ["source_no", "block"], "left").groupBy("source_no", "start", "doc_id", "size", "source_size", "target").agg(F.sum(given).cast("bigint").alias("taken"))
    own = targets.select(F.col("source").alias("own_source"), "source_size", "target")
    blank = sizes.filter("size = 0").join(own, F.col("source").eqNullSafe(F.col("own_source")))
    cols = ["doc_id", "size", "source_size", "target"]
    return taken.select(*cols, "taken").unionByName(blank.select(*cols, F.lit(0).cast("bigint").alias("taken")))


def draw(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents of the mix as rows of ``docs``, each as often as the mix takes it.

    Whole texts are repeated: taken / size times, where a fraction counts as one with its own
    probability by a hash of the id. A document of which nothing is taken goes. Rows that share
    an id are repeated alike, as often as they are taken on average.
    """
    mix_id, n_copies, copy = (unused(docs, n) for n in ("mix_id", "n_copies", "copy"))
    taken = mix(docs, id_col=id_col, **how).filter("taken > 0").groupBy("doc_id").agg(F.sum("taken").alias("words"), F.sum("size").alias("own")).withColumnRenamed("doc_id", mix_id)
    unit = F.conv(F.substring(F.md5(F.concat(F.lit("draw"), F.coalesce(F.col(mix_id).cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("bigint") / float(1 << 32)
    copies = F.floor(F.col("words") / F.col("own") + unit).cast("int")
    counted = taken.select(mix_id, copies.alias(n_copies)).filter(F.col(n_copies) > 0)
    met = docs.join(counted, F.col(id_col).eqNullSafe(F.col(mix_id)))
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n_copies)))).select(*docs.columns)
