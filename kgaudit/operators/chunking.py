"""Source files to chunks (TXT-1..3, WIN-1, WIN-2, WIN-4, WIN-5, WIN-14, UDF-2, FIL-15, AGG-22, AGG-27).

Definitions, boundaries, class context and chunk texts are array expressions inside the
file's own row, so chunking never shuffles file contents. Python finds forms and blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from kgaudit.functions import scalars as fx
from kgaudit.functions.profiles import DEFAULT_PROFILES, Profile, by_language, java_regex, usable
from kgaudit.session import first_per

DEFINITION = "array<struct<line:int,name:string,kind:string,owner:string>>"
CHUNKS = "array<struct<function_name:string,class_name:string,line_start:int,line_end:int,content:string>>"
FLAGS = re.MULTILINE | re.IGNORECASE
BLOCK_SIZE = 2048  # fixed value


def _line_definitions(profile: Profile, lines: Column) -> Column:
    """Definitions that the patterns of one language find at the start of a line."""
    kinds = [(p, "function") for p in usable(profile.function_patterns)] + [(p, "class") for p in usable(profile.class_patterns)]

    def hit(line: Column, i: Column, pattern: str, kind: str) -> Column:
        groups, java = re.compile(pattern).groupindex, "(?i)" + java_regex(pattern)
        name = F.regexp_extract(line, java, groups["name"])
        owner = F.regexp_extract(line, java, groups[profile.class_group]) if profile.class_group in groups else F.lit("")
        found = F.struct((i + 1).cast("int").alias("line"), name.alias("name"), F.lit(kind).alias("kind"), owner.alias("owner"))
        return F.when(F.regexp_like(line, F.lit(java)) & (name != ""), found)

    each = lambda line, i: F.array_compact(F.array(*[hit(line, i, p, k) for p, k in kinds]))
    return F.flatten(F.transform(lines, each)) if kinds else F.array().cast(DEFINITION)


def find_definitions(profiles: dict[str, Profile]):
    """Function of (lines, language): definitions as (line, name, kind, owner), ordered by line.

    Patterns are compiled into expressions over the lines, so no text leaves its row or the
    engine, and the work grows with the text. Patterns are anchored at the start of a line;
    of a line that fits several, each counts, functions first.
    """
    def scan(lines: Column, language: Column) -> Column:
        return by_language(language, profiles, lambda p: _line_definitions(p, lines), F.array().cast(DEFINITION))

    return scan


def _text_lines(content: Column | str) -> Column:
    lines = F.split(fx.text(content), r"\r?\n")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def _trimmed_end(lines: Column, start: Column, end: Column) -> Column:
    """Last line of ``start..end`` that is not blank, at least ``start``.

    The last two lines are looked at first, since most parts end there.
    """
    part = F.slice(lines, start, F.greatest(end - start + 1, F.lit(0)))
    filled = F.array_position(F.reverse(F.transform(part, lambda x: fx.strip(x) != "")), True)
    ends = lambda back: (end - back >= start) & (fx.strip(F.get(lines, end - back - 1)) != "")
    return F.when(ends(0), end).when(ends(1), end - 1).when(filled == 0, start).otherwise(end - filled + 1).cast("int")


def chunk_definitions(files: DataFrame, profiles: dict[str, Profile] = DEFAULT_PROFILES) -> DataFrame:
    """TXT-1: chunks of (path, content, language).

    Text before the first definition becomes a chunk named after the file; a file
    without definitions is one chunk.
    """
    keyword = F.lit("")
    for name, p in profiles.items():
        keyword = F.when(F.col("language") == name, p.implementation_keyword.lower()).otherwise(keyword)
    stem = F.coalesce(F.nullif(fx.path_stem("path"), F.lit("")), F.lit("<module>"))
    parsed = files.where(fx.text("content") != "").select(
        "path", "language", "content", _text_lines("content").alias("lines"), stem.alias("stem"), keyword.alias("keyword"))
    parsed = parsed.withColumn("found", find_definitions(profiles)(F.col("lines"), F.col("language")))
    # The lines are only searched for the keyword when the text has it at all.
    sought = (F.col("keyword") != "") & F.contains(F.lower("content"), F.col("keyword"))
    impl = F.when(sought, F.array_position(F.transform("lines", lambda x: F.lower(fx.strip(x))), F.col("keyword"))).otherwise(0)
    parsed = parsed.withColumn("impl", impl)
    kept = F.when(F.col("impl") == 0, F.col("found")).otherwise(F.filter("found", lambda d: (d["line"] > F.col("impl")) | (d["owner"] != "")))
    parsed = parsed.withColumn("defs", kept)
    # WIN-5: the class a definition belongs to is the last class seen so far. Each class name is repeated up to the
    # next class, so the work grows with the definitions; a list that is appended to is copied for each of them.
    places = F.transform("defs", lambda d, i: F.struct(i.alias("at"), F.when(d["kind"] == "class", d["name"]).alias("name")))
    marks = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("name"))), F.filter(places, lambda p: p["name"].isNotNull()))
    parsed = parsed.withColumn("marks", marks)
    until = lambda j: F.coalesce(F.get(F.col("marks"), j + 1)["at"], F.size("defs"))
    seen = F.flatten(F.transform("marks", lambda m, j: F.array_repeat(m["name"], until(j) - m["at"])))
    parsed = parsed.withColumns({"classes": seen, "total": F.size("lines")})

    def chunk(name: Column, cls: Column, start: Column, end: Column, content: Column) -> Column:
        return F.struct(name.alias("function_name"), cls.alias("class_name"), start.cast("int").alias("line_start"), end.cast("int").alias("line_end"), content.alias("content"))

    def text(start: Column, end: Column) -> Column:
        return F.array_join(F.slice(F.col("lines"), start, end - start + 1), "\n")

    def last_line(d: Column, i: Column) -> Column:
        # WIN-4: a chunk ends before the next definition, the last one at the end.
        following = F.get(F.col("defs"), i + 1)["line"] - 1
        return _trimmed_end(F.col("lines"), d["line"], F.greatest(F.coalesce(following, F.col("total")), d["line"]))

    def body(d: Column, i: Column) -> Column:
        end = F.get(F.col("ends"), i)
        cls = F.when(d["owner"] != "", d["owner"]).when(d["kind"] == "function", F.get(F.col("classes"), i)).otherwise("")
        return chunk(d["name"], cls, d["line"], end, text(d["line"], end))

    first = F.get("defs", F.lit(0))["line"]
    parsed = parsed.withColumns({"ends": F.transform("defs", last_line), "head_end": _trimmed_end(F.col("lines"), F.lit(1), first - 1)})
    head_filled = F.exists(F.slice(F.col("lines"), 1, F.greatest(first - 1, F.lit(0))), lambda x: fx.strip(x) != "")
    head = F.when((first > 1) & head_filled, F.array(chunk(F.col("stem"), F.lit(""), F.lit(1), F.col("head_end"), text(F.lit(1), F.col("head_end"))))).otherwise(F.array().cast(CHUNKS))
    whole = F.array(chunk(F.col("stem"), F.lit(""), F.lit(1), F.col("total"), F.col("content")))
    chunks = F.when(F.size("defs") == 0, whole).otherwise(F.concat(head, F.transform("defs", body)))
    return parsed.select("path", "language", F.inline(chunks)).withColumn("chunk_id", fx.chunk_id("path", "class_name", "function_name"))


def keep_first_chunks(chunks: DataFrame) -> DataFrame:
    """WIN-1: first chunk of every id in path and line order."""
    return first_per(chunks, ["chunk_id"], [F.col("path"), F.col("line_start")])


def backfilled_class(definitions: DataFrame) -> DataFrame:
    """WIN-2: class of each (function, file): the first definition that names one."""
    order = F.when(fx.text("class_name") != "", F.col("seq"))
    return definitions.groupBy("function_name", "file_path").agg(F.coalesce(F.min_by("class_name", order), F.lit("")).alias("class_name"), F.min("seq").alias("seq"))


# ------------------------------------------------------------------ forms

FORM_SCHEMA = "path STRING, function_name STRING, class_name STRING, line_start INT, line_end INT, content STRING, event_handlers ARRAY<STRING>"
_FORM = re.compile(r"object\s+(\w+)\s*:\s*(\w+)", re.IGNORECASE)
_EVENT = re.compile(r"On\w+\s*=\s*(\w+)", re.IGNORECASE)


def _forms(lines: list[str]) -> list[tuple]:
    """Top-level objects of a form file: (name, class, first line, last line, handlers).

    Nesting is a running sum of +1 for an object and -1 for an end, lifted by its lowest value
    so far, so that surplus ends count for nothing. A top-level object runs from where the
    sum leaves zero to where it is back; one that never ends, or has no name, is none.
    """
    bare = [line.strip() for line in lines]
    words = [line.lower().split(None, 1) or [""] for line in bare]
    change = np.array([(w[0] == "object" and len(w) > 1) - (w == ["end"]) for w in words], np.int64)
    total = np.cumsum(change)
    depth = total - np.minimum(np.minimum.accumulate(total), 0) if len(total) else total
    before = np.concatenate(([0], depth[:-1])) if len(depth) else depth
    first, last = np.flatnonzero((before == 0) & (depth == 1)), np.flatnonzero((before == 1) & (depth == 0))
    found = []
    for a, b in zip(first.tolist(), last.tolist()):
        if named := _FORM.match(bare[a]):
            events = [_EVENT.match(line) for line in bare[a + 1 : b]]
            found.append((named[1], named[2], a + 1, b + 1, list(dict.fromkeys(e[1] for e in events if e))))
    return found


def chunk_forms(files: DataFrame) -> DataFrame:
    """TXT-2: one chunk per top-level object with its distinct event handlers."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                lines = (content or "").splitlines()
                rows += [(path, n, c, a, b, "\n".join(lines[a - 1:b]), h) for n, c, a, b, h in _forms(lines)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in FORM_SCHEMA.split(", ")])

    forms = files.select("path", "content").mapInPandas(run, FORM_SCHEMA)
    return forms.withColumns({"language": F.lit("delphi"), "is_form": F.lit(True), "chunk_id": fx.chunk_id("path", "class_name", "function_name")})


# ------------------------------------------------------------------ blocks

BLOCK = ArrayType(StructType([
    StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("block_type", StringType()), StructField("block_name", StringType()),
]))


def match_blocks(text: str, rules: list[tuple]) -> list[tuple]:
    """Blocks of a text: each opener with the next unused closer of its rule, else the
    end; WIN-14: a block that starts inside the last kept one is dropped.

    The k-th opener's closer is the k-th one at the earliest, plus as many as any opener so
    far had to skip because they stand before it: a running maximum.
    """
    starts, stops, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for kind, opener, closer in rules:
        opened = list(opener.finditer(text))
        spans = np.array([m.span() for m in closer.finditer(text)], np.int64).reshape(-1, 2)
        at, turn = np.array([m.start() for m in opened], np.int64), np.arange(len(opened))
        skipped = np.searchsorted(spans[:, 0], at, "right") - turn
        use = turn + np.maximum.accumulate(np.maximum(skipped, 0)) if len(turn) else turn
        ends = np.append(spans[:, 1], len(text))
        starts.append(at)
        stops.append(ends[np.minimum(use, len(spans))])
        names += [(kind, m["name"]) for m in opened]
    start, stop = np.concatenate(starts), np.concatenate(stops)
    order = np.argsort(start, kind="stable")
    start, stop, kept, i = start[order], stop[order], [], 0
    while i < len(start):
        kept.append((int(start[i]), int(stop[i]), *names[order[i]]))
        i = max(i + 1, int(np.searchsorted(start, stop[i], "left")))
    return kept


def find_blocks(profiles: dict[str, Profile]):
    table = {n: [(k, o, c) for k, o, c in p.block_rules if usable((o,))] for n, p in profiles.items()}

    @F.pandas_udf(BLOCK)
    def scan(content: pd.Series, language: pd.Series) -> pd.Series:
        rules = {n: [(k, re.compile(o, FLAGS), re.compile(c, FLAGS)) for k, o, c in rs] for n, rs in table.items()}
        names = [f.name for f in BLOCK.elementType.fields]
        return pd.Series([[dict(zip(names, b)) for b in match_blocks(t or "", rules.get(n, []))] for t, n in zip(content, language)])

    return scan


def chunk_blocks(files: DataFrame, profiles: dict[str, Profile] = DEFAULT_PROFILES, size: int = BLOCK_SIZE) -> DataFrame:
    """TXT-3: block chunks with the text between them, split at line ends above ``size``.

    A language without block rules gives one chunk per file.
    """
    parsed = files.select("path", "language", fx.text("content").alias("content"), find_blocks(profiles)("content", "language").alias("blocks"))
    ruled = F.col("language").isin([n for n, p in profiles.items() if p.block_rules])
    n = F.length("content")

    def piece(start: Column, end: Column, kind: Column, name: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), kind.alias("block_type"), name.alias("block_name"))

    gaps = F.transform("blocks", lambda b, i: piece(
        F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("blocks"), i - 1)["end"]), b["start"], F.lit("preamble"), F.lit("<declarations>")))
    tail_at = F.coalesce(F.try_element_at("blocks", F.lit(-1))["end"], F.lit(0))
    tail = F.array(piece(tail_at, n, F.lit("epilogue"), F.lit("<trailing>")))
    own = F.transform("blocks", lambda b: piece(b["start"], b["end"], b["block_type"], b["block_name"]))
    pieces = F.when(~ruled, F.array(piece(F.lit(0), n, F.lit("file"), F.lit("<unsupported>")))).otherwise(F.array_sort(F.concat(gaps, own, tail)))
    rows = parsed.select("path", "language", "content", F.inline(pieces)).where("end > start")
    raw = F.substring(F.col("content"), F.col("start") + 1, F.col("end") - F.col("start"))
    between = F.col("block_type").isin("preamble", "epilogue")
    rows = rows.withColumn("text", F.when(between, fx.strip(raw)).otherwise(raw)).where(~between | (F.length("text") > 3))
    return rows.select("path", "language", "block_type", "block_name", "start", _line_at("content", "start").alias("line_start"), F.posexplode(_split_text("text", size)).alias("part", "text")).withColumn("chars", F.length("text"))


def _line_at(content: str, offset: str) -> Column:
    before = F.substring(F.col(content), F.lit(1), F.col(offset))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def _split_text(text: str, size: int) -> Column:
    """Parts of at most ``size`` characters cut at line ends; a longer line stays whole."""
    def add(acc: Column, line: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = F.length(last) + 1 + F.length(line) <= size
        started = F.size(acc) > 1
        return F.when(started & fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit("\n"), line)))).otherwise(F.array_append(acc, line))

    whole = F.array(F.col(text))
    # The first entry is a marker that keeps the list from being empty.
    parts = F.aggregate(F.split(F.col(text), "\n"), F.array(F.lit("")), add)
    return F.when(F.length(text) <= size, whole).otherwise(F.slice(parts, 2, F.size(parts) - 1))


def register_udtf(spark, profiles: dict[str, Profile] = DEFAULT_PROFILES) -> None:
    """UDF-2: ``code_blocks(content, language)`` for SQL ``LATERAL``."""
    rules = {n: p.block_rules for n, p in profiles.items()}

    class CodeBlocks:
        def eval(self, content: str, language: str):
            found = [(k, re.compile(o, FLAGS), re.compile(c, FLAGS)) for k, o, c in rules.get(language, ())]
            yield from match_blocks(content or "", found)

    spark.udtf.register("code_blocks", F.udtf(CodeBlocks, returnType="start INT, stop INT, block_type STRING, block_name STRING"))


# ------------------------------------------------------------------ reports


def function_chunks(code_index: DataFrame, chunks: DataFrame, function_name: str, class_name: str | None = None, matches: int | None = None, size: int | None = None) -> DataFrame:
    """FIL-15: text of a function in its indexed files, whole unless ``matches`` limits the files
    and ``size`` the characters; a file without the chunk and an unknown function give an error row."""
    from kgaudit.operators.lookup import search_index

    hits = search_index(code_index, function_name, class_name).orderBy("file_path", "class_name")
    hits = hits if matches is None else hits.limit(matches)
    own = chunks.where(F.upper("function_name") == function_name.upper().strip())
    if class_name:
        own = own.where(F.upper("class_name") == class_name.upper().strip())
    firsts = first_per(own.select(F.col("path").alias("file_path"), "line_start", "line_end", "content"), ["file_path"], [F.col("line_start")])
    cut = F.col("content") if size is None else F.when(F.length("content") > size, F.concat(F.substring("content", 1, size), F.lit("\n... (truncated, function too long)"))).otherwise(F.col("content"))
    found = hits.join(firsts, "file_path", "left").select(
        "function_name", "file_path", "class_name", "line_start", "line_end", cut.alias("content"), F.when(F.col("content").isNull(), "no chunk").alias("error"))
    missing = hits.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit(function_name).alias("function_name"), *[F.lit(None).cast(t).alias(c) for c, t in (("file_path", "string"), ("class_name", "string"), ("line_start", "int"), ("line_end", "int"), ("content", "string"))], F.lit("not found").alias("error"))
    return found.unionByName(missing)


def index_stats(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-22."""
    marks = chunks.select("path", F.when(F.col("function_name") != "", 1).alias("f"), F.lit(1).alias("c"), F.lit(None).cast("int").alias("e")).unionByName(
        edges.select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("f"), F.lit(None).cast("int").alias("c"), F.lit(1).alias("e")))
    return marks.agg(F.count_distinct("path").alias("files"), F.count("c").alias("chunks"), F.count("f").alias("functions"), F.count("e").alias("edges"))


def compare_chunkers(chunks: DataFrame) -> DataFrame:
    """AGG-27: chunks and mean size of each method (columns ``method``, ``chars``)."""
    return chunks.groupBy("method").agg(F.count(F.lit(1)).alias("chunks"), F.floor(F.avg("chars")).alias("mean_chars"))
