"""Corpus profile: lines, languages, patterns, tear-sheet and rankings (TXT-11..16, TXT-23, FIL-7, FIL-9, AGG-11..14, TOP-*).

A file is one row (path, content). Per-file work stays inside that row as array
expressions wherever possible, so it needs no shuffle.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgaudit.functions import fixed
from kgaudit.functions import scalars as fx
from kgaudit.session import ordinal


def lines_of(content: Column | str) -> Column:
    """Lines of a text; a line ends at \\n or \\r\\n."""
    return F.split(fx.text(content), r"\r?\n")


def file_lines(files: DataFrame) -> DataFrame:
    """(path, line_number, line) of every line."""
    return files.select("path", F.posexplode(lines_of("content")).alias("_p", "line")).select("path", (F.col("_p") + 1).alias("line_number"), "line")


def line_count(content: Column | str) -> Column:
    """TXT-16: number of lines of a file; a final line break starts no new line."""
    lines = lines_of(content)
    return F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)


def loc(content: Column | str) -> Column:
    """Number of lines that are not blank, for AGG-12 and TOP-6."""
    return F.size(F.filter(lines_of(content), lambda x: fx.strip(x) != ""))


def language_of(path: Column | str) -> Column:
    """TXT-13: language by extension, null when unknown."""
    table = F.create_map(*[F.lit(x) for x in chain(*fixed.EXTENSION_LANGUAGES.items())])
    return F.try_element_at(table, fx.extension(path))


def file_kind(path: Column | str) -> Column:
    """TXT-13: 'known', 'skipped' or 'unknown' for a path of a source scan."""
    ext, name = fx.extension(path), F.lower(fx.base_name(path))
    skipped = F.when(ext != "", ext.isin(fixed.SKIPPED_EXTENSIONS)).otherwise(name.isin(fixed.SKIPPED_NAMES))
    return F.when(language_of(path).isNotNull(), "known").when(skipped, "skipped").otherwise("unknown")


def language_votes(files: DataFrame, sample: int | None = None) -> DataFrame:
    """TXT-14: signature hits per language over the unknown files; a file counts for a
    language from two hits on. ``sample`` limits the vote to the first paths."""
    voters = files.orderBy("path").limit(sample) if sample else files
    upper = F.upper(fx.text("content"))
    counts = [
        F.struct(F.lit(lang).alias("language"), sum((F.contains(upper, F.lit(s)).cast("int") for s in signs), F.lit(0)).alias("hits"))
        for lang, signs in fixed.LANGUAGE_SIGNATURES.items()
    ]
    return voters.select(F.inline(F.array(*counts))).where("hits >= 2").groupBy("language").agg(F.sum("hits").alias("votes"), F.count(F.lit(1)).alias("files"))


def winning_language(votes: DataFrame) -> DataFrame:
    """TXT-14: the language with most votes, which then names all unknown files."""
    return votes.orderBy(F.desc("votes"), "language").limit(1)


def pattern_flags(lines: DataFrame, keywords: list[str], patterns: list[str]) -> DataFrame:
    """TXT-15: lines hit by a keyword and lines hit by a definition pattern."""
    words = "(?i)(?:^|\\s)(?:" + "|".join(_quoted(k) for k in keywords) + ")\\s"
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.rlike(F.col("line"), F.lit(f"(?i){p}"))
    # A keyword at the end of a line is followed by the line break.
    return lines.withColumns({"keyword_hit": F.rlike(F.concat("line", F.lit("\n")), F.lit(words)), "pattern_hit": hit})


def _quoted(word: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in word)


def pattern_coverage(flags: DataFrame) -> DataFrame:
    """TXT-15: hits of both kinds and coverage, 1 when no keyword occurs."""
    n = flags.agg(F.count_if("keyword_hit").alias("keyword_lines"), F.count_if("pattern_hit").alias("pattern_lines"))
    return n.withColumn("coverage", F.when(F.col("keyword_lines") == 0, 1.0).otherwise(F.least(F.col("pattern_lines") / F.greatest("keyword_lines", F.lit(1)), F.lit(1.0))))


def missed_lines(flags: DataFrame) -> DataFrame:
    """TXT-15: keyword lines that no pattern hits."""
    return flags.where("keyword_hit AND NOT pattern_hit").select("path", "line_number", fx.strip("line").alias("line")).where("line <> ''")


def search_text(files: DataFrame, needle: str, limit: int | None = None) -> DataFrame:
    """FIL-7: lines that contain ``needle`` in any case; ``limit`` keeps the first rows."""
    hits = file_lines(files.where(F.contains(F.lower("content"), F.lit(needle.lower())))).where(F.contains(F.lower("line"), F.lit(needle.lower())))
    found = hits.select("path", "line_number", fx.strip("line").alias("line"))
    return found.orderBy("path", "line_number").limit(limit) if limit else found


def slice_lines(files: DataFrame, ranges: DataFrame, buffer: int = 0) -> DataFrame:
    """FIL-9: numbered lines ``start..end`` of each file, widened by ``buffer``.

    The range is cut out of the line array before it becomes rows.
    """
    joined = ranges.join(files.select("path", lines_of("content").alias("_lines")), "path")
    first = F.greatest(F.lit(0), F.col("start") - 1 - buffer)
    last = F.least(F.size("_lines"), F.col("end") + buffer)
    cut = joined.withColumn("_first", first.cast("int")).withColumn("_part", F.slice("_lines", F.col("_first") + 1, F.greatest(F.lit(0), last - first).cast("int")))
    return cut.select(*ranges.columns, F.posexplode("_part").alias("_p", "line"), "_first").select(
        *ranges.columns, (F.col("_first") + F.col("_p") + 1).alias("line_number"), "line")


# ------------------------------------------------------------------ aggregates


def loc_by_extension(files: DataFrame) -> DataFrame:
    """AGG-12: files, lines and share of all lines per extension (column ``ext``)."""
    per = files.where("ext <> ''").groupBy("ext").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"))
    # The window spans one row per extension.
    total = F.sum("loc").over(Window.partitionBy())
    return per.select("ext", "files", "loc", (F.col("loc") / F.greatest(total, F.lit(1))).alias("share"))


def is_db_name(name: Column | str) -> Column:
    """TXT-23: whether a function name points to database access."""
    upper = F.upper(fx.text(name))
    return F.exists(F.array(*[F.lit(k.upper()) for k in fixed.DB_NAME_PARTS]), lambda k: F.contains(upper, k))


def tear_sheet(code_index: DataFrame) -> DataFrame:
    """AGG-11: files, functions, classes and files with database-like functions."""
    return code_index.agg(
        F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("functions"), F.count_distinct(F.nullif("class_name", F.lit(""))).alias("classes"),
        F.count_distinct(F.when(is_db_name("function_name"), F.col("file_path"))).alias("db_files"))


def language_counts(code_index: DataFrame) -> DataFrame:
    """AGG-11."""
    return code_index.groupBy("language").agg(F.count(F.lit(1)).alias("functions"))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """TOP-1: most frequent values; ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def duplicate_names(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """AGG-13."""
    found = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "value")
    return found if n is None else found.limit(n)


def largest_files(files: DataFrame, n: int | None = None) -> DataFrame:
    """TOP-6."""
    ordered = files.select("path", "loc").orderBy(F.desc("loc"), "path")
    return ordered if n is None else ordered.limit(n)


def head_with_more(df: DataFrame, keys: list[str], order: list[str], n: int | None) -> DataFrame:
    """TOP-4: first ``n`` rows per key (None: all) and how many more the key has.

    ``row_number <= n`` lets every task drop rows beyond ``n`` before the shuffle; the
    counts come from a separate partial aggregate.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    head = df.withColumn("position", F.row_number().over(w))
    if n is None:
        return head.withColumn("more", F.lit(0).cast("bigint"))
    head = head.where(F.col("position") <= n)
    totals = df.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"))
    return head.join(totals, keys)


def sample_files(files: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """TOP-5: smallest, largest and middle file of each group, then others by hash."""
    sized = files.select(by, "path", F.col("size").cast("bigint").alias("size"))
    placed = ordinal(sized, [by], "size", ["path"], "_pos")
    total = sized.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    role = (
        F.when(F.col("_pos") == 1, 0).when(F.col("_pos") == F.col("_n"), 1)
        .when((F.col("_n") > 2) & (F.col("_pos") == F.floor(F.col("_n") / 2) + 1), 2).otherwise(3)
    )
    ranked = placed.join(total, by).withColumn("role", role).withColumn("_h", F.md5("path"))
    return head_with_more(ranked, [by], ["role", "_h"], n).select(by, "path", "role")
