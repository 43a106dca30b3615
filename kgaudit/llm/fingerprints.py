"""Invertible Bloom lookup fingerprints of documents, compared by subtraction and peeling.

A paragraph of a document is a line, or a piece of a long line that ends where the text itself
says so. A fingerprint spreads each paragraph's digest over three of its cells; a cell holds the
count, the exclusive or of the digests and the exclusive or of check values. Subtracting the
cells of two fingerprints leaves the paragraphs that differ, and peeling cells with a single
digest recovers them.

Cells are rows (cell, n, key, chk), without empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kgaudit.llm.exprs import narrow
from kgaudit.session import bucketed, checkpointed

CELLS = 36
# Smallest digests that a fingerprint keeps, to estimate how many differ between two documents.
LEAST = 32
# Cells of a sketch for each digest that should differ, and some more; peeling needs 1.23 in the limit.
PER_DIGEST, SPARE = 2.0, 12
# Rounds of peeling, each over one third of the cells; a failed peeling is retried with GROWTH times the cells.
ROUNDS, GROWTH, RETRIES = 12, 2, 12
# A paragraph ends with its line, or with a word whose last character has a code that 7 divides
# (beyond Latin: lies in one of some ranges). Pieces that are still longer than LONG are cut after
# characters that end a run of three with a hash of 0 modulo CHARS. So only characters at its end
# decide where a piece ends, and an edit changes the pieces that it touches and no others.
LONG, CHARS = 512, 64
_ASCII = "".join(rf"\x{c:02x}" for c in range(35, 127, 7))
_BEYOND = "".join(rf"\x{{{c:x}}}-\x{{{c + 3:x}}}" for c in range(0xC0, 0x700, 32))
# The many ranges are only tried on characters between the first and the last of them.
ENDS = rf"[\n ](?:(?<=\n)|(?<=(?:[{_ASCII}]|(?=[\x{{c0}}-\x{{6ff}}])[{_BEYOND}]) ))"
# Words of the first characters count as paragraphs of their own, so that short texts have several.
OPENING = 64


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _run_starts(rows: Column, key) -> Column:
    """Positions in a sorted array where ``key`` changes."""
    at = F.sequence(F.lit(0), F.size(rows) - 1)
    new = lambda i: (i == 0) | (key(rows[i]) != key(rows[F.greatest(i - 1, F.lit(0))]))
    return F.when(F.size(rows) > 0, F.filter(at, new)).otherwise(F.array().cast("array<int>"))


def _run_length(rows: Column, starts: Column, j: Column) -> Column:
    return F.coalesce(F.get(starts, j + 1), F.size(rows)) - starts[j]


def _cut(parts: Column, ends, glue: str) -> Column:
    """Pieces of an array of two or more strings, which end at the places where ``ends`` holds and at the end."""

    def pieces(parts: Column) -> Column:
        last = F.concat(F.filter(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: ends(parts, i)), F.array(F.size(parts) - 1))
        start = lambda at, j: F.coalesce(F.get(at, j - 1), F.lit(-1)) + 1
        return _let(last, lambda at: F.transform(at, lambda e, j: F.array_join(F.slice(parts, start(at, j) + 1, e - start(at, j) + 1), glue)))

    return _let(parts, pieces)


def paragraphs(text: Column) -> Column:
    """The lines of a text; long ones in pieces whose ends depend on nearby characters only.

    So an edit changes the pieces that it touches, and the rest of a long line stays as it was.
    Text that repeats one word or a short run of characters is cut everywhere or nowhere.
    """
    run = lambda c, i: F.xxhash64(F.get(c, i - 2), F.get(c, i - 1), c[i])
    by_char = lambda x: _cut(F.split(x, ""), lambda c, i: F.pmod(run(c, i), F.lit(CHARS)) == 0, "")
    finer = lambda x: F.when(F.char_length(x) > LONG, by_char(x)).otherwise(F.array(x))
    cut = lambda parts: F.when(F.exists(parts, lambda x: F.char_length(x) > LONG), F.flatten(F.transform(parts, finer))).otherwise(parts)
    return _let(F.split(text, ENDS), cut)


def paragraph_digests(text: Column) -> Column:
    """Sorted distinct 64-bit digests of the paragraphs of a text and of the words of its opening.

    The k-th repeat of a paragraph has a digest of its own, so one more repeat adds one digest.
    """
    opening = F.transform(F.split(F.substring(text, 1, OPENING), "[ \\n]"), lambda w: F.xxhash64(w, F.lit("opening")))
    found = F.sort_array(F.concat(F.transform(paragraphs(text), lambda x: F.xxhash64(x)), opening))
    repeats = lambda rows, starts: F.transform(
        starts, lambda p, j: F.transform(F.sequence(F.lit(0), _run_length(rows, starts, j) - 1), lambda k: F.when(k == 0, rows[p]).otherwise(F.xxhash64(rows[p], k)))
    )
    numbered = lambda rows: F.sort_array(F.flatten(_let(_run_starts(rows, lambda x: x), lambda starts: repeats(rows, starts))))
    return _let(found, lambda rows: F.when(F.size(F.array_distinct(rows)) == F.size(rows), rows).otherwise(numbered(rows)))


def _check(digest: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(digest, F.lit("check")), 32)


def first_size(a: Column, b: Column) -> Column:
    """Cells for the digests that two documents should differ by, judged from the ``LEAST`` smallest of each."""
    least = lambda x: F.slice(x, 1, LEAST)
    joint = F.slice(F.sort_array(F.array_union(least(a), least(b))), 1, LEAST)
    share = F.size(F.array_intersect(F.array_intersect(least(a), least(b)), joint)) / F.greatest(F.size(joint), F.lit(1))
    expected = _let(share, lambda j: (F.size(a) + F.size(b)) * (1 - j) / (1 + j))
    return F.greatest(F.ceil((expected * PER_DIGEST + SPARE) / 3) * 3, F.lit(CELLS)).cast("int")


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of several entries: counts added, keys and checks combined by exclusive or; empty cells go."""
    total = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
    return total.filter("n <> 0 OR key <> 0 OR chk <> 0")


def _place(digest: str, k: Column, size: Column, seed: Column) -> Column:
    """The cell of a digest in the k-th third of ``size`` cells, from a slice of one hash."""
    third = F.call_function("div", size, F.lit(3))
    part = F.call_function("shiftrightunsigned", F.xxhash64(F.col(digest), seed), (k * 21).cast("int"))
    return k * third + F.pmod(part.bitwiseAND(F.lit((1 << 21) - 1)), third)


def peeled(pairs: DataFrame, keys: list[str], listed: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """What peeling recovers of each pair (``keys``, size, a, b) of digest sets, sketched in ``size`` cells and subtracted.

    Rows (keys, cell, rec, n): cells that are left have a cell of 0 or more, recovered digests
    the cell -1 (only in ``a``) or -2 (only in ``b``), with their number in n, or each with its
    digest in ``rec`` if they are ``listed``. A round takes all cells of one third that hold a single
    digest, by count and check value, and takes these digests out of the other two thirds.
    The size is also the seed of the hashes, so another size has other ones.
    All rounds group by the same keys, so they run without a shuffle where ``pairs`` is
    partitioned by some of them, and a task holds the cells of its own pairs only.
    """
    long = lambda x: F.lit(x).cast("bigint")
    place = lambda digest, k: _place(digest, k, F.col("size"), F.col("size"))
    digests = pairs.select(*keys, F.col("size").cast("bigint").alias("size"), F.size("a").alias("n_a"), F.posexplode(F.concat("a", "b")).alias("at", "d"))
    signed = digests.select(*keys, "size", F.when(F.col("at") < F.col("n_a"), 1).otherwise(-1).cast("bigint").alias("n"), "d", F.explode(F.array(*[long(k) for k in range(3)])).alias("k"))
    # Recovered digests tell rows apart only if they are listed.
    fields = ["cell", *(["rec"] if listed else []), "n", "key", "chk"]
    by = [*keys, "size", *fields[:-3]]
    cells = _summed(signed.select(*keys, "size", place("d", F.col("k")).alias("cell"), long(0).alias("rec"), "n", F.col("d").alias("key"), _check(F.col("d")).alias("chk")), by)
    # A pure cell becomes entries against the two other thirds (0 and 1) and a recovered digest (2), another cell stays (3).
    into = lambda *of: F.array(*[F.lit(x) for x in of])
    for i in range(rounds):
        k = i % 3
        pure = (F.expr("cell div (size div 3)") == k) & (F.col("cell") >= 0) & (F.abs("n") == 1) & (F.col("chk") == _check(F.col("key")))
        spread = cells.select("*", F.explode(F.when(pure, into(0, 1, 2)).otherwise(into(3))).alias("as"))
        kept, found = F.col("as") == 3, F.col("as") == 2
        other = F.when(F.col("as") == 0, long((k + 1) % 3)).otherwise(long((k + 2) % 3))
        value = {
            "cell": F.when(kept, F.col("cell")).when(found, F.when(F.col("n") == 1, long(-1)).otherwise(long(-2))).otherwise(place("key", other)),
            "rec": F.when(kept, F.col("rec")).when(found, F.col("key")).otherwise(long(0)) if listed else None,
            "n": F.when(kept, F.col("n")).when(found, long(1)).otherwise(-F.col("n")),
            "key": F.when(found, long(0)).otherwise(F.col("key")),
            "chk": F.when(found, long(0)).otherwise(F.col("chk")),
        }
        cells = _summed(spread.select(*keys, "size", *[value[c].alias(c) for c in fields]), by)
    return cells.select(*keys, "cell", F.col("rec") if listed else long(0).alias("rec"), "n")


def _counted(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, open (cells that are left), only_a, only_b of the pairs that differ at all."""
    part = lambda c: F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0))
    return peeled(pairs, keys).groupBy(*keys).agg(F.count_if(F.col("cell") >= 0).alias("open"), part(-1).alias("only_a"), part(-2).alias("only_b"))


def difference_sizes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, only_a, only_b, tries of every pair (``keys``, size, a, b): how many digests only one side has. Stored.

    Where a sketch of ``size`` cells doesn't peel, one of ``GROWTH`` times the cells with other
    hashes is tried for those pairs, and so on; after ``RETRIES`` sizes the digests are compared.
    """
    done, waiting = None, pairs
    for i in range(RETRIES):
        tried = checkpointed(_counted(waiting, keys))
        good = tried.filter("open = 0").select(*keys, "only_a", "only_b", F.lit(i).alias("tries"))
        done = good if done is None else done.unionByName(good)
        failed = tried.filter("open > 0").select(*keys)
        if failed.isEmpty():
            return done
        # A shuffled copy of the few that failed.
        waiting = checkpointed(pairs.join(failed, keys, "left_semi").withColumn("size", (F.col("size") * GROWTH ** (i + 1)).cast("bigint")))
    apart = lambda x, y: F.size(F.array_except(x, y)).cast("bigint")
    return done.unionByName(waiting.select(*keys, apart("a", "b").alias("only_a"), apart("b", "a").alias("only_b"), F.lit(-1).alias("tries")))


def differing(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side (``a`` or ``b``), digest: the digests that peeling recovers, of every pair (``keys``, size, a, b)."""
    tries = checkpointed(difference_sizes(pairs, keys).select(*keys, "tries"))
    out, side = None, F.when(F.col("cell") == -1, "a").otherwise("b").alias("side")
    for i in [r["tries"] for r in tries.select("tries").distinct().collect()]:  # at most RETRIES + 1 values
        own = pairs.join(tries.filter(F.col("tries") == i).select(*keys), keys)
        if i < 0:
            each = lambda x, y, n: F.transform(F.array_except(x, y), lambda d: F.struct(F.lit(n).alias("side"), d.alias("digest")))
            found = own.select(*keys, F.inline(F.concat(each("a", "b", "a"), each("b", "a", "b"))))
        else:
            sized = own.withColumn("size", (F.col("size") * GROWTH**i).cast("bigint"))
            found = peeled(sized, keys, listed=True).filter("cell < 0").select(*keys, side, F.col("rec").alias("digest"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else pairs.select(*keys, F.lit("").alias("side"), F.lit(0).cast("bigint").alias("digest"))


def likeness(n_a: Column, only_a: Column, only_b: Column) -> Column:
    """Share of the digests of two documents that both have: 1 for equal sets, 0 for disjoint ones."""
    whole = n_a + only_b
    return F.when(whole == 0, F.lit(1.0)).otherwise((n_a - only_a).cast("double") / whole)


def sketched(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a_cells, b_cells of pairs (``keys``, a, b) of digest sets: sketches as bytes, with cell (1), count (4), key (8) and check (4) of each cell.

    Cells are summed as rows, without a shuffle where ``pairs`` is partitioned by some of the keys.
    """
    digests = pairs.select(*keys, F.size("a").alias("n_a"), F.posexplode(F.concat("a", "b")).alias("at", "d"))
    thirds = digests.select(*keys, F.when(F.col("at") < F.col("n_a"), 0).otherwise(CELLS).alias("first"), "d", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(3)])).alias("k"))
    place = F.col("first") + _place("d", F.col("k"), F.lit(CELLS), F.lit(0))
    cells = _summed(thirds.select(*keys, place.alias("cell"), F.lit(1).alias("n"), F.col("d").alias("key"), _check(F.col("d")).alias("chk")), [*keys, "cell"])
    text = F.concat(*[F.lpad(F.hex(c), width, "0") for c, width in ((F.col("cell") % CELLS, 2), (F.col("n"), 8), (F.col("key"), 16), (F.col("chk"), 8))])
    # At most CELLS short texts of each side, which sort as their cells do.
    joined = lambda side: F.unhex(F.array_join(F.sort_array(F.collect_list(F.when(side, F.col("text")))), ""))
    in_a = F.col("cell") < CELLS
    return cells.select(*keys, "cell", text.alias("text")).groupBy(*keys).agg(joined(in_a).alias("a_cells"), joined(~in_a).alias("b_cells"))


def with_next(docs: DataFrame, per_bucket: int = 2048, segments: int = 512, made: dict[str, Column] | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) with next_text (and next_<name> of other columns): each document and the next one in descending order of ids.

    ``part`` numbers the bucket of a row. Columns that are ``made`` of the text come along as if
    ``docs`` had them, but are computed once a row, after the texts are dealt out and the guards are picked.

    After the last document comes the first. A null id counts as the smallest; equal ids
    follow one another by a hash of their text. The ids are cut into buckets of neighbours, evenly
    inside ``segments`` quantiles; each bucket also gets the first document of the next one, so that
    texts are dealt out once and no order spans more than a bucket. An id that fills whole quantiles,
    and the null id, have their rows dealt to buckets by ranges of the hash.
    """
    made = made or {}
    rest = [c for c in docs.columns if c != "doc_id"]
    docs = docs.withColumn("tie", F.xxhash64("text"))
    n, nulls, low, *cuts = docs.agg(
        F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.percentile_approx("doc_id", [i / segments for i in range(1, segments + 1)], 10 * segments),
    ).first()
    bounds = sorted([c for c in [*(cuts[0] or []), low] if c is not None]) or [0]
    runs = n // (per_bucket * segments) + 1
    # Where one id is several quantiles, it has buckets of its own; an ascending number for each bound.
    many = {b: bounds.count(b) for b in set(bounds) if bounds.count(b) > 2}
    edges = sorted({*bounds, bounds[0] + 1, *many, *(b + 1 for b in many)})
    array = F.array(*[F.lit(int(b)).cast("bigint") for b in edges])
    share = max(1, n // segments)
    split = F.create_map(*[x for b, k in many.items() for x in (F.lit(int(b)).cast("bigint"), F.lit(k * share // per_bucket + 1))]) if many else None
    part = lambda k: F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * k)
    parts = F.coalesce(F.element_at(split, F.col("doc_id")), F.lit(0)) if split is not None else F.lit(0)

    def of_id(spot: Column) -> Column:
        lo, hi = array[spot], F.coalesce(F.get(array, spot + 1), F.lit(int(edges[-1]) + 1))
        even = F.greatest(F.least(F.floor((F.col("doc_id") - lo).cast("double") * runs / (hi - lo).cast("double")), F.lit(runs - 1)), F.lit(0))
        # Inside an id the order goes up by hash while ids go down, so its parts count down.
        within = F.when(parts > 0, parts - 1 - part(parts)).otherwise(even)
        return F.struct(spot.cast("bigint").alias("a"), within.cast("bigint").alias("b"))

    # All bounds are looked at once a row.
    spot = F.greatest(F.size(F.filter(array, lambda e: e <= F.col("doc_id"))) - 1, F.lit(0))
    bucket = F.when(F.col("doc_id").isNotNull(), _let(spot, of_id))
    of_null = F.struct(F.lit(-1).cast("bigint").alias("a"), (-part(F.lit(nulls // per_bucket + 1))).cast("bigint").alias("b"))
    dealt = docs.withColumn("bucket", F.coalesce(bucket, of_null))
    order = [F.col("doc_id").isNull(), F.col("doc_id").desc_nulls_last(), F.col("tie")]
    down = F.struct(F.col("doc_id").isNull(), -F.coalesce(F.col("doc_id"), F.lit(0)).cast("decimal(20,0)"), F.col("tie"))
    heads = dealt.groupBy("bucket").agg(F.min_by(F.struct("doc_id", "tie"), down).alias("head"))
    # Few rows, one for each bucket: the head of each bucket goes to the one before it, the first to the last.
    turn = Window.partitionBy(F.lit(0)).orderBy(F.col("bucket").desc())
    last = F.min("bucket").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    moved = checkpointed(heads.select("head", F.coalesce(F.lag("bucket").over(turn), last).alias("to")))
    own = dealt.withColumn("guard", F.lit(0))
    met = docs.join(moved, F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("tie") == F.col("head.tie")))
    guards = met.select("doc_id", *rest, "tie", F.col("to").alias("bucket"), F.lit(1).alias("guard"))
    inside = Window.partitionBy("part").orderBy("guard", *order)
    cols = [*rest, *made]
    ahead = [F.lead(c).over(inside).alias(f"next_{c}") for c in cols]
    rows = own.unionByName(guards).withColumn("part", F.xxhash64("bucket")).repartition("part").withColumns(made)
    return rows.select("*", *ahead).filter("guard = 0").select("part", "doc_id", *cols, *[f"next_{c}" for c in cols])


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``other``."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(other, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and how like they are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The edited text takes its end from the next document (see ``with_next``). A
    null text is an empty one, which has one empty paragraph. A table of one row is its own
    next document. Repeated rows are documents of their own; an empty table stays empty.
    """
    rows = with_next(narrow(docs, id_col, text_col), made={"own": paragraph_digests(F.col("text"))})
    pairs = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    # A document's two pairs have the even and the odd number: with its edited text, with the next document.
    made = bucketed(pairs.select(
        "part", (F.monotonically_increasing_id() * 2).alias("no"), "doc_id", F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", paragraph_digests(F.col("edited")).alias("other"), F.col("next_own").alias("next"),
    ), ["part"], deal=False)
    pair = lambda kind, c: F.struct((F.col("no") + kind).alias("no"), first_size(F.col("own"), F.col(c)).alias("size"), F.col("own").alias("a"), F.col(c).alias("b"))
    both = made.select("part", F.inline(F.array(pair(0, "other"), pair(1, "next"))))
    found = difference_sizes(both, ["part", "no"])
    of = lambda kind, c: F.max(F.when(F.col("no") % 2 == kind, F.col(c))).alias(f"{c}_{kind}")
    sizes = found.groupBy("part", (F.col("no") - F.col("no") % 2).alias("no")).agg(*[of(kind, c) for kind in (0, 1) for c in ("only_a", "only_b")])
    cells = sketched(made.select("part", "no", F.col("own").alias("a"), F.col("other").alias("b")), ["part", "no"])
    # The joins move sketches as bytes, and sizes in the place of digests.
    lean = made.select("part", "no", "doc_id", "n_chars", "edited_sha256", F.size("own").alias("n_own"), F.size("other").alias("n_other"))
    met = lean.join(sizes, ["part", "no"], "left").join(cells, ["part", "no"])
    none = F.lit(0).cast("bigint")
    near = lambda kind: likeness(F.col("n_own"), F.coalesce(f"only_a_{kind}", none), F.coalesce(f"only_b_{kind}", none))
    # A fingerprint as text: the number of digests, then its cells in hex.
    text = lambda n, cells: F.concat(F.col(n).cast("string"), F.lit(":"), F.hex(cells))
    return met.select(
        "doc_id", "n_chars", "edited_sha256", text("n_own", "a_cells").alias("fingerprint"), text("n_other", "b_cells").alias("edited_fingerprint"),
        near(0).alias("near_edited"), near(1).alias("near_next"),
    )
