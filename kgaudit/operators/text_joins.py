"""Joins of short texts by edit distance and by containment, over indexes of q-grams (JOIN-14, JOIN-18).

Neither join forms pairs that share no rare piece of text: what meets in a shuffle are texts
with the same uncommon q-gram, and only those that pass cheap tests are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgaudit.session import checkpointed

# Texts that share an indexed gram are dealt to one more task for every so many.
SALT_ROWS = 4096
# Lengths of the starts and ends of texts whose characters are compared apart.
MARGINS = (8, 16)


def _grams(text: Column, q: int) -> Column:
    """(pos, gram) of every run of ``q`` characters."""
    n = F.length(text)
    spots = F.when(n >= q, F.sequence(F.lit(1), n - q + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.struct(i.alias("pos"), F.substring(text, i, q).alias("gram")))


def _parity(items: Column) -> Column:
    """64 bits: of the items that hash to each bit, whether there is an odd number."""
    zero = F.lit(0).cast("bigint")
    return F.aggregate(items, zero, lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))


def edit_candidates(texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different ``texts`` (t) that may reach ``threshold``, each with ``k``, the edits allowed.

    Two texts of at most l characters reach it if they differ by no more than k = (1 - threshold) * l
    edits, each of which destroys at most q grams. So of the k * q + 1 rarest grams of one text
    the other still has one near its old place, and the rarest grams of the two texts meet: only
    those are joined, by gram and length of the longer text. Pairs then need close places and
    lengths, and few differences between two parity signatures, of their characters and
    of their grams, and between those of a start and an end that don't overlap: an edit changes at
    most two characters of either, with the one that it shifts over the border, and falls into
    one of them. A gram that many texts have is salted by the number of its texts.
    """
    if threshold <= 0.5:
        raise ValueError("a threshold above 0.5 is needed")
    q, slack, eps = (2 if threshold >= 0.8 else 1), 1 - threshold, 1e-9
    edits = lambda n: F.floor(n * slack + eps).cast("int")
    t = texts.select("t", F.length("t").alias("n")).where("n > 0").distinct()
    grams = _grams(F.col("t"), q)
    plain = t.select(
        "t", "n", F.floor(F.col("n") / threshold + eps).cast("int").alias("most"), _parity(F.split("t", "")).alias("chars"),
        _parity(F.transform(grams, lambda g: g["gram"])).alias("pieces"),
        *[_parity(F.split(F.substring("t", 1, m), "")).alias(f"start{m}") for m in MARGINS], *[_parity(F.split(F.substring("t", -m, m), "")).alias(f"end{m}") for m in MARGINS], grams.alias("grams"))
    signs = ["chars", "pieces", *[f"{c}{m}" for c in ("start", "end") for m in MARGINS]]
    spread = checkpointed(plain.select("t", "n", "most", *signs, F.inline("grams")))
    common = checkpointed(spread.groupBy("gram").agg(F.count(F.lit(1)).alias("held")))
    # Equal grams rank alike, so all places of the last gram of a prefix are in it.
    rank = F.rank().over(Window.partitionBy("t").orderBy("held", "gram"))
    prefix = checkpointed(spread.join(common, "gram").withColumn("rank", rank).where(F.col("rank") <= edits(F.col("most")) * q + 1).drop("rank"))
    salts = F.floor(F.col("held") / SALT_ROWS).cast("int") + 1
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("t", "n", "pos", *signs)]
    short = prefix.select("gram", F.pmod(F.xxhash64("t"), salts).cast("int").alias("salt"), *side("a"), F.explode(F.sequence("n", "most")).alias("length"))
    long = prefix.select("gram", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), *side("b"), F.col("n").alias("length"))
    k = edits(F.col("length"))
    far = lambda c: F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")))
    near = (F.abs(F.col("a_pos") - F.col("b_pos")) <= k) & (F.col("length") - F.col("a_n") <= k) & (far("chars") <= 2 * k) & (far("pieces") <= 2 * q * k)
    for start in MARGINS:
        for end in MARGINS:
            near = near & ((F.col("a_n") < start + end) | (far(f"start{start}") + far(f"end{end}") <= 2 * k))
    order = (F.col("a_n") < F.col("b_n")) | (F.col("a_t") < F.col("b_t"))
    met = short.join(long, ["gram", "salt", "length"]).where(near & order)
    return met.select(F.least("a_t", "b_t").alias("a"), F.greatest("a_t", "b_t").alias("b"), k.alias("k")).distinct()


def edit_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different ``texts`` (t) with 1 - edits / longer length of at least ``threshold``, and that ``ratio``.

    A distance is only computed as far as the allowed edits. Empty texts are like no other text;
    nulls and repeated texts count once or not at all.
    """
    found = edit_candidates(texts, threshold).withColumn("edits", F.expr("levenshtein(a, b, k)")).where("edits >= 0")
    return found.select("a", "b", (1 - F.col("edits") / F.greatest(F.length("a"), F.length("b"))).alias("ratio"))


# ------------------------------------------------------------------ containment


def _index(texts: DataFrame, c: str, q: int) -> DataFrame:
    """(c, gram): the distinct runs of up to ``q`` characters of each text. Stored."""
    runs = F.array_distinct(F.flatten(F.array(*[F.transform(_grams(F.col(c), w), lambda g: g["gram"]) for w in range(1, q + 1)])))
    return checkpointed(texts.select(c, F.explode(runs).alias("gram")))


def contained_candidates(needles: DataFrame, index: DataFrame, holder: str, q: int) -> DataFrame:
    """(needle, holder) pairs that share the needle's rarest gram of the indexed texts.

    A needle of up to ``q`` characters is a gram itself, and its pairs are right already. A
    needle with a gram that no indexed text has is in none of them, and meets nothing.
    """
    held = index.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    runs = F.when(F.length("needle") <= q, F.array("needle")).otherwise(F.array_distinct(F.transform(_grams(F.col("needle"), q), lambda g: g["gram"])))
    own = needles.select("needle", F.explode(runs).alias("gram")).join(held, "gram", "left")
    rare = own.groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("held", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("held", F.lit(0))).alias("held"))
    return rare.where("held > 0").select("needle", "gram").join(index, "gram").select("needle", holder)


def smallest_holder(names: DataFrame, keys: DataFrame, q: int = 3) -> DataFrame:
    """(name, key): the smallest of ``keys`` (key) that contains each of ``names`` (name)."""
    index = _index(keys, "key", q)
    needles = names.select(F.col("name").alias("needle")).where("needle <> ''").distinct()
    # A short name can be in any number of keys, so the smallest is taken per gram first.
    of_gram = index.groupBy("gram").agg(F.min("key").alias("key"))
    short = needles.where(F.length("needle") <= q).join(of_gram, F.col("needle") == F.col("gram")).select("needle", "key")
    long = contained_candidates(needles.where(F.length("needle") > q), index, "key", q).where(F.contains("key", "needle"))
    return short.unionByName(long).groupBy(F.col("needle").alias("name")).agg(F.min("key").alias("key"))


def contained_keys(names: DataFrame, keys: DataFrame, q: int = 3) -> DataFrame:
    """(name, key): the ``keys`` (key) that each of ``names`` (name) contains."""
    needles = keys.select(F.col("key").alias("needle")).where("needle <> ''").distinct()
    found = contained_candidates(needles, _index(names.select("name").distinct(), "name", q), "name", q)
    return found.where(F.contains("name", "needle")).select("name", F.col("needle").alias("key"))
