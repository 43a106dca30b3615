"""A prefix trie of conversations, from collapsed sequences instead of a pointer structure.

Identical conversations become one sequence with a weight and a list of ends. A prefix is known
by a running digest: the exclusive or of digests of (depth, turn), which windows over blocks of
turns add up, so that no conversation needs one task for all its turns. Sequences that are no
proper prefix of another one are the leaves; sums over the weighted prefixes give the nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgaudit.session import checkpointed, numbered

# Turns of a conversation that one window covers; longer conversations are added up block by block.
BLOCK = 4096
# Ends of a sequence that are written into one part of its list.
PART = 4096
_EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(ids, turns): all conversations and their turns after each one's first turns are exchanged.

    Conversation c starts with the first h turns of conversation c - c % ``every`` (all if it
    has fewer, none if there is no such one) and goes on with its own turns after its first h;
    h is the CRC-32 of the decimal id modulo ``most``. The turns come as (conv_id, depth, role,
    text), stored; the ids as conv_id, since a conversation can lose all its turns.
    """
    rows = turns.select(
        F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    placed = checkpointed(numbered(rows, ["conv_id"], ["turn", "role", "text"], "pos").select("conv_id", "pos", "role", "text"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("bigint")
    base = F.col("conv_id") - F.col("conv_id") % every
    ids = checkpointed(placed.select("conv_id").distinct().select("conv_id", head.alias("h"), base.alias("base")))
    # A conversation lends at most ``most`` - 1 turns, to at most ``every`` conversations.
    lent = placed.filter((F.col("conv_id") % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    taken = ids.join(lent, "base").filter("pos <= h").select("conv_id", F.col("pos").alias("depth"), "role", "text")
    held = lent.groupBy("base").agg(F.count(F.lit(1)).alias("held"))
    moved = ids.join(held, "base", "left").select("conv_id", "h", (F.least("h", F.coalesce("held", F.lit(0))) - F.col("h")).alias("move"))
    own = placed.join(moved, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") + F.col("move")).alias("depth"), "role", "text")
    return ids.select("conv_id"), checkpointed(taken.unionByName(own))


def _halves(hexes: Column) -> tuple[Column, Column]:
    """The first 128 bits of a hex digest as two numbers."""
    half = lambda at: F.conv(F.substring(hexes, at, 16), 16, -10).cast("bigint")
    return half(1), half(17)


def _signed(turns: DataFrame) -> DataFrame:
    """conv_id, depth, n_bytes, s1, s2 of each turn: 128 bits of the digest of (depth, role, text). Stored."""
    whole = F.concat_ws(":", F.col("depth").cast("string"), F.octet_length("role").cast("string"), F.concat("role", "text"))
    signed = turns.select("conv_id", "depth", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(whole.cast("binary"), 256).alias("sha"))
    s1, s2 = _halves(F.col("sha"))
    return checkpointed(signed.select("conv_id", "depth", "n_bytes", s1.alias("s1"), s2.alias("s2")))


def _running(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (rep, depth, n_bytes, s1, s2) with k1, k2 (the prefix's digest), p1, p2 (that of the prefix before) and ``upto`` (its bytes)."""
    rows = rows.withColumn("block", F.floor((F.col("depth") - 1) / block))
    inside = Window.partitionBy("rep", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy("rep", "block").agg(F.bit_xor("s1").alias("t1"), F.bit_xor("s2").alias("t2"), F.sum("n_bytes").alias("tb"))
    before = Window.partitionBy("rep").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    # Only conversations of several blocks have a row here.
    offsets = totals.select(
        "rep", "block", F.coalesce(F.bit_xor("t1").over(before), none).alias("o1"), F.coalesce(F.bit_xor("t2").over(before), none).alias("o2"), F.coalesce(F.sum("tb").over(before), none).alias("ob"),
    ).filter("block > 0")
    local = rows.select("*", F.bit_xor("s1").over(inside).alias("l1"), F.bit_xor("s2").over(inside).alias("l2"), F.sum("n_bytes").over(inside).alias("lb"))
    met = local.join(checkpointed(offsets), ["rep", "block"], "left")
    key = lambda i: F.col(f"l{i}").bitwiseXOR(F.coalesce(F.col(f"o{i}"), none))
    keyed = met.select("rep", "depth", "n_bytes", key(1).alias("k1"), key(2).alias("k2"), "s1", "s2", (F.col("lb") + F.coalesce("ob", none)).alias("upto"))
    return keyed.select("rep", "depth", "n_bytes", "k1", "k2", F.col("k1").bitwiseXOR(F.col("s1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("s2")).alias("p2"), "upto")


def _end_digests(ends: DataFrame) -> DataFrame:
    """rep, ends_sha256: the digest of each sequence's ids (rep, conv_id) in ascending order, joined by commas.

    The ids are put in order by ranges of (rep, id), so the ends of one sequence are spread
    over many tasks, which write them as parts of at most ``PART`` ids. A sequence's parts are
    then fed to its digest one after the other; no list of ids is ever held whole.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, first, listed = None, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(listed)])], names=["rep", "first", "part"])

        for batch in batches:
            made = []
            for r, c in zip(batch.column("rep").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if r != rep or len(listed) >= PART:
                    if listed:
                        made.append(out())
                    rep, first, listed = r, c, []
                listed.append(str(c))
            if made:
                yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
        if listed:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, state = None, None
        for batch in batches:
            reps, shas = [], []
            for r, p in zip(batch.column("rep").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if r != rep:
                    if state is not None:
                        reps.append(rep)
                        shas.append(state.hexdigest())
                    rep, state = r, hashlib.sha256(p.encode())
                else:
                    state.update(b"," + p.encode())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(shas, pa.string())], names=["rep", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()])], names=["rep", "ends_sha256"])

    ordered = ends.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    listed = checkpointed(ordered.mapInArrow(parts, "rep bigint, first bigint, part string"))
    return listed.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(digests, "rep bigint, ends_sha256 string")


def sequences(ids: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, members): the distinct whole sequences, and which conversation has which. Both stored.

    A sequence is (rep, depth, k1, k2, weight): its smallest conversation, its number of turns,
    its digest and how many conversations are equal to it. Members are (rep, conv_id).
    """
    whole = signed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("s1").alias("k1"), F.bit_xor("s2").alias("k2"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    whole = checkpointed(ids.join(whole, "conv_id", "left").select("conv_id", none("depth"), none("k1"), none("k2")))
    key = ["depth", "k1", "k2"]
    found = checkpointed(whole.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight")))
    return found, checkpointed(whole.join(found.select(*key, "rep"), key).select("rep", "conv_id"))


def prefix_trie(
    turns: DataFrame, every: int = 5, most: int = 9, block: int = BLOCK, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations (see ``rebuilt``), one row each.

    Returns conv_id (the node's smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves (childless nodes below and including it), saved_tokens (over
    its subtree, (n_convs - 1) times the UTF-8 bytes of each node's last text) and ends_sha256
    (of the ascending ids of the members that end there, joined by commas).

    A null role or text is an empty one. Turns come in the order of their number, null first;
    equal numbers by role and text, and repeated rows are turns of their own. Rows with a null
    id belong to no conversation. An empty table gives no nodes, not even a root.
    """
    ids, made = rebuilt(turns, every, most, id_col, turn_col, role_col, text_col)
    signed = _signed(made)
    found, members = sequences(ids, signed)
    reps = found.select("rep", F.col("depth").alias("length"), "weight")
    one = signed.withColumnRenamed("conv_id", "rep").join(found.select("rep"), "rep", "left_semi")
    none = F.lit(0).cast("bigint")
    roots = found.select("rep", none.alias("depth"), none.alias("n_bytes"), none.alias("k1"), none.alias("k2"), F.lit(None).cast("bigint").alias("p1"), F.lit(None).cast("bigint").alias("p2"), none.alias("upto"))
    prefixes = checkpointed(_running(one, block).unionByName(roots).join(reps, "rep"))
    key = ["depth", "k1", "k2"]
    proper = prefixes.filter(F.col("depth") < F.col("length")).select(*key).distinct()
    leaves = checkpointed(found.join(proper, key, "left_anti").select("rep", F.lit(1).alias("leaf")))
    # The texts of a subtree count once: a node's bytes belong to the smallest sequence through it,
    # which owns an unbroken lower end of its own path.
    owned = prefixes.groupBy(*key).agg(F.min("rep").alias("rep"), F.max("n_bytes").alias("n_bytes"))
    owned = checkpointed(owned.groupBy("rep").agg(F.min("depth").alias("from"), F.sum("n_bytes").alias("owned")))
    total = prefixes.groupBy("rep").agg(F.sum("n_bytes").alias("total"))
    facts = checkpointed(reps.select("rep").join(total, "rep").join(owned, "rep", "left").join(leaves, "rep", "left"))
    rest = F.col("total") - F.col("upto") + F.col("n_bytes")  # bytes of this turn and those after it
    own = F.when(F.col("from").isNull(), 0).when(F.col("depth") >= F.col("from"), rest).otherwise(F.col("owned"))
    nodes = checkpointed(
        prefixes.join(facts, "rep").groupBy(*key).agg(
            F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"), F.sum(F.col("weight") * rest - own).alias("saved_tokens"),
            F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.max(F.when(F.col("depth") == F.col("length"), F.col("rep"))).alias("ends"),
        )
    )
    up = ["up_depth", "p1", "p2"]
    below = nodes.withColumn("up_depth", F.col("depth") - 1)
    children = below.filter("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    parents = checkpointed(nodes.select(F.col("depth").alias("up_depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")))
    counted = nodes.join(children.select(F.col("up_depth").alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children"), key, "left").drop("p1", "p2")
    linked = below.select(*key, *up).join(parents, up, "left").select(*key, "parent_conv_id")
    lists = _end_digests(members).withColumnRenamed("rep", "ends")
    return counted.join(linked, key).join(lists, "ends", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", none).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )
