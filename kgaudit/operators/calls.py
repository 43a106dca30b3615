"""Call extraction and resolution (TXT-4..12, JOIN-11, JOIN-13, JOIN-15, GRA-14).

Names are taken out of a chunk inside its row and made distinct there; only then do
they meet the known names, in an equi join. A chunk is (chunk_id, path, language,
function_name, content).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgaudit.functions import profiles as pf
from kgaudit.functions import scalars as fx
from kgaudit.functions.profiles import DEFAULT_PROFILES, Profile
from kgaudit.session import checkpointed

# Confidence of each extraction strategy.
PAREN_CALL, KEYWORD_CALL, BARE_CALL, SUPPLEMENT, HANDLER, PROPOSED = 0.70, 0.80, 0.60, 0.55, 0.90, 0.85
SHORTEST_BARE_NAME = 3
PAREN = r"\b([A-Za-z_]\w*)\s*\("
# Simple call patterns per language and names that are no calls.
SIMPLE_CALLS = {
    "python": [PAREN, r"from\s+([A-Za-z_]\w*)\s+import", r"import\s+([A-Za-z_]\w*)"],
    "java": [PAREN, r"new\s+([A-Za-z_]\w*)\s*\("],
    "javascript": [PAREN, r"require\s*\(\s*['\"]([A-Za-z_]\w*)['\"]"],
}
SKIP_NAMES = [
    "def", "class", "if", "for", "while", "return", "print", "len", "str", "int", "float", "list", "dict", "set",
    "range", "open", "type", "isinstance", "super", "self", "True", "False", "None", "Exception", "raise",
]


def clean_code(profiles: dict[str, Profile] = DEFAULT_PROFILES, content: str = "content") -> Column:
    """TXT-4."""
    body = fx.text(content)
    return pf.by_language(F.col("language"), profiles, lambda p: pf.code_only(body, p), body)


def identifiers(text: Column, lookahead: str = "") -> Column:
    """TXT-5: upper-cased maximal identifier runs; a name stands alone in a text exactly
    when it is one of them."""
    c = pf.IDENTIFIER
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?<!{c})({c}++){lookahead}"), F.lit(1)), F.upper)


def times(names: Column, name: Column) -> Column:
    return F.size(F.filter(names, lambda x: x == name))


def _upper_all(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.upper)


def _keyword_names(profile: Profile) -> Column:
    found = F.array().cast("array<string>")
    for p in pf.usable(profile.call_patterns, "callee"):
        group = re.compile(p).groupindex["callee"]
        hits = F.regexp_extract_all(fx.text("content"), F.lit("(?i)" + pf.java_regex(p)), F.lit(group))
        found = F.concat(found, F.transform(hits, F.upper))
    return found


def _name_lists(chunks: DataFrame, profiles: dict[str, Profile]) -> DataFrame:
    """(chunk_id, _me, _paren, _keyword, _bare): the distinct names that a chunk may call, by strategy."""
    none = F.array().cast("array<string>")
    me = F.upper(fx.text("function_name"))
    found = chunks.select("chunk_id", "language", "content", clean_code(profiles).alias("_clean"), me.alias("_me"))
    found = found.select(
        "chunk_id", "language", "_clean", "_me", _upper_all(F.col("_clean"), PAREN).alias("_p"),
        pf.by_language(F.col("language"), profiles, _keyword_names, none).alias("_k"),
        pf.by_language(F.col("language"), profiles, lambda p: F.array_except(identifiers(F.col("_clean"), p.bare_lookahead), F.array(*[F.lit(s.upper()) for s in p.skip_tokens])) if p.bare_identifiers else none, none).alias("_b"),
    )

    def without_self(names: str, counted: Column) -> Column:
        """A chunk calls itself only when its name occurs again; most do not have it at all."""
        alone = F.array_contains(names, F.col("_me")) & (times(counted, F.col("_me")) < 2)
        return F.when(alone, F.array_remove(F.array_distinct(names), F.col("_me"))).otherwise(F.array_distinct(names))

    # Whatever follows them counts: read again only in chunks that have their own name among the bare ones.
    every = pf.by_language(F.col("language"), profiles, lambda p: identifiers(F.col("_clean")) if p.bare_identifiers else none, none)
    bare = F.filter(without_self("_b", every), lambda x: F.length(x) >= SHORTEST_BARE_NAME)
    return found.select("chunk_id", "_me", without_self("_p", F.col("_p")).alias("_paren"), F.array_distinct("_k").alias("_keyword"), bare.alias("_bare"))


def mentioned_names(chunks: DataFrame, profiles: dict[str, Profile] = DEFAULT_PROFILES) -> DataFrame:
    """Distinct (chunk_id, strategy, name, is_self) that a chunk may call, before any join.

    Strategy 1 is a call with parentheses, 2 a call keyword, 3 a bare identifier.
    """
    def tagged(strategy: int, names: str) -> Column:
        return F.transform(names, lambda x: F.struct(F.lit(strategy).alias("strategy"), x.alias("name"), (x == F.col("_me")).alias("is_self")))

    return _name_lists(chunks, profiles).select("chunk_id", F.inline(F.concat(tagged(1, "_paren"), tagged(2, "_keyword"), tagged(3, "_bare"))))


def known_mentions(chunks: DataFrame, known: DataFrame, profiles: dict[str, Profile] = DEFAULT_PROFILES) -> DataFrame:
    """The known names of every chunk, once each: (chunk_id, name, strategy, bare).

    ``strategy`` is the strongest one that counts. A form's name counts only after a call keyword,
    or as the chunk's own name with parentheses, else it is null. ``bare`` tells whether the name also
    stands alone. The strategies of a name meet inside the chunk's row, before any shuffle.
    """
    def rows(names: Column, plain: int, form: Column) -> Column:
        return F.transform(names, lambda x: F.struct(x.alias("name"), F.lit(plain).alias("plain"), form(x).alias("form"), F.array_contains("_bare", x).alias("bare")))

    none = F.lit(None).cast("int")
    later = F.array_except("_keyword", "_paren")
    found = F.concat(
        rows(F.col("_paren"), 1, lambda x: F.when(x == F.col("_me"), 1).when(F.array_contains("_keyword", x), 2)),
        rows(later, 2, lambda x: F.lit(2)),
        rows(F.array_except(F.array_except("_bare", "_paren"), "_keyword"), 3, lambda x: none))
    names = _name_lists(chunks, profiles).select("chunk_id", F.inline(found))
    strategy = F.when(F.col("is_form"), F.col("form")).otherwise(F.col("plain"))
    return names.join(known, "name").select("chunk_id", "name", strategy.alias("strategy"), (F.col("bare") & ~F.col("is_form")).alias("bare"))


def known_names(chunks: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """Distinct upper-cased function names, flagged when a form has the name."""
    names = chunks.where("function_name <> '' AND function_name <> '<module>'").select(F.upper("function_name").alias("name"), F.lit(False).alias("is_form"))
    if forms is not None:
        names = names.unionByName(forms.select(F.upper("function_name").alias("name"), F.lit(True).alias("is_form")))
    return names.groupBy("name").agg(F.bool_or("is_form").alias("is_form"))


def extract_calls(chunks: DataFrame, known: DataFrame, profiles: dict[str, Profile] = DEFAULT_PROFILES) -> DataFrame:
    """TXT-6: (chunk_id, callee, confidence), the strongest strategy per name.

    A form's name counts only after a call keyword, or as the chunk's own name.
    """
    return calls_of(known_mentions(chunks, known, profiles))


def calls_of(mentions: DataFrame) -> DataFrame:
    """TXT-6 from ``known_mentions``."""
    best = mentions.where("strategy IS NOT NULL").groupBy("chunk_id", F.col("name").alias("callee")).agg(F.min("strategy").alias("strategy"))
    score = F.when(F.col("strategy") == 1, PAREN_CALL).when(F.col("strategy") == 2, KEYWORD_CALL).otherwise(BARE_CALL)
    return best.select("chunk_id", "callee", score.alias("confidence"))


def contained_names(chunks: DataFrame, known: DataFrame, profiles: dict[str, Profile] = DEFAULT_PROFILES) -> DataFrame:
    """JOIN-15: known names that stand alone in a chunk's code."""
    bare = _name_lists(chunks, profiles).select("chunk_id", F.explode("_bare").alias("name"))
    return bare.join(known.where("NOT is_form"), "name").select("chunk_id", F.col("name").alias("callee"))


def supplemented_calls(mentions: DataFrame) -> DataFrame:
    """TXT-8 for the calls with parentheses, from ``known_mentions``: whether a chunk calls a name
    and whether it contains it is known in one row, so nothing is looked up."""
    best = mentions.where("strategy = 1 OR bare").groupBy("chunk_id", F.col("name").alias("callee")).agg(F.min("strategy").alias("strategy"), F.count_if("bare").alias("n"))
    calls = F.when(F.col("strategy") == 1, F.array(F.lit(PAREN_CALL))).otherwise(F.array_repeat(F.lit(SUPPLEMENT), F.col("n").cast("int")))
    return best.select("chunk_id", "callee", F.explode(calls).alias("confidence"))


def supplement_calls(calls: DataFrame, chunks: DataFrame, known: DataFrame, profiles: dict[str, Profile] = DEFAULT_PROFILES) -> DataFrame:
    """TXT-8: contained names that ``calls`` lacks, appended with low confidence."""
    have = calls.select("chunk_id", F.upper("callee").alias("callee")).distinct()
    missed = contained_names(chunks, known, profiles).join(have, ["chunk_id", "callee"], "left_anti")
    return calls.unionByName(missed.withColumn("confidence", F.lit(SUPPLEMENT)))


def validate_proposals(proposals: DataFrame, chunks: DataFrame, known: DataFrame) -> DataFrame:
    """TXT-7: proposed calls (chunk_id, seq, callee, confidence) that name a known
    function standing alone in the chunk; the first proposal of a name counts."""
    wanted = proposals.withColumn("name", F.upper(fx.strip(fx.text("callee")))).where("name <> ''")
    firsts = wanted.groupBy("chunk_id", "name").agg(F.min_by(F.struct("callee", "confidence"), "seq").alias("p"))
    valid = firsts.join(known.select("name"), "name", "left_semi")
    text = chunks.select("chunk_id", F.upper(fx.text("function_name")).alias("_me"), identifiers(fx.text("content")).alias("_ids"), _upper_all(fx.text("content"), r"(\w+)").alias("_words"))
    checked = valid.join(text, "chunk_id").where(F.array_contains("_ids", F.col("name")) & ((F.col("name") != F.col("_me")) | (times(F.col("_words"), F.col("name")) > 1)))
    return checked.select("chunk_id", fx.strip("p.callee").alias("callee"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("p.confidence", F.lit(PROPOSED)))).alias("confidence"))


def expand_sites(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """TXT-9: one row per call site of an edge."""
    text = chunks.select("chunk_id", F.upper(fx.text("function_name")).alias("_me"), _upper_all(fx.text("content"), r"(\w+)\s*\(").alias("_calls"), _upper_all(fx.text("content"), r"(\w+)").alias("_words"))
    name = F.upper("callee")
    own = F.when(name == F.col("_me"), 1).otherwise(0)
    parens = F.greatest(times(F.col("_calls"), name) - own, F.lit(0))
    n = F.when(parens == 0, F.greatest(times(F.col("_words"), name) - own, F.lit(1))).otherwise(parens)
    return calls.join(text, "chunk_id").withColumn("site", F.explode(F.sequence(F.lit(1), n))).select(*calls.columns, "site")


# ------------------------------------------------------------------ resolution


def resolve_callees(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """JOIN-11: ``calls`` (callee, caller_file, ...) with the chunk each callee means.

    Wanted is the candidate in the caller's file, else with most leading folders in
    common, else of the same stem, else the first. Candidates are reduced to one per
    (name, folder lead) and per (name, folder lead, stem), and a caller file looks them
    up at each of its own leads, so calls and candidates of a name are never paired.
    ``chunks`` has (chunk_id, path, function_name, seq).
    """
    def with_leads(df: DataFrame, path: str) -> DataFrame:
        split = df.withColumn("_parts", F.split(F.upper(fx.slashes(path)), "/"))
        lead = F.transform(F.sequence(F.lit(0), F.size("_parts")), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice("_parts", F.lit(1), n), "/").alias("lead")))
        return split.select(*df.columns, F.inline(lead))

    # Every side grows with the code, so none may be collected for a broadcast, however well it is compressed.
    wanted = calls.select(F.upper("callee").alias("_name"), "caller_file").distinct()
    named = chunks.where("function_name <> '' AND function_name <> '<module>'").select(
        F.upper("function_name").alias("_name"), "chunk_id", "path", F.upper(fx.file_stem("path")).alias("_stem"), "seq")
    # Names that nobody calls go before paths are spread; stored, as two tables are made of the rest.
    candidates = with_leads(checkpointed(named.join(wanted.select("_name").distinct().hint("merge"), "_name", "left_semi")), "path")
    pick = F.min_by("chunk_id", F.struct("seq", "chunk_id")).alias
    by_lead = candidates.groupBy("_name", "depth", "lead").agg(pick("_any"))
    by_stem = candidates.groupBy("_name", "depth", "lead", "_stem").agg(pick("_same"))
    probes = with_leads(wanted.withColumn("_stem", F.upper(fx.file_stem("caller_file"))), "caller_file")
    found = probes.join(by_lead.hint("merge"), ["_name", "depth", "lead"]).join(by_stem.hint("merge"), ["_name", "depth", "lead", "_stem"], "left")
    best = found.groupBy("_name", "caller_file").agg(F.max_by(F.coalesce("_same", "_any"), "depth").alias("callee_chunk"))
    return calls.withColumn("_name", F.upper("callee")).join(best.hint("merge"), ["_name", "caller_file"]).select(*calls.columns, "callee_chunk")


def handler_edges(forms: DataFrame, chunks: DataFrame, distinct: bool = False) -> DataFrame:
    """JOIN-13: edges from a form to the functions its events name, itself excluded."""
    wanted = forms.select("chunk_id", F.col("path").alias("caller_file"), F.explode("event_handlers").alias("callee"))
    found = resolve_callees(wanted, chunks).where("callee_chunk <> chunk_id")
    edges = found.select(F.col("chunk_id").alias("caller"), F.col("callee_chunk").alias("callee"), F.lit(HANDLER).alias("confidence"))
    return edges.distinct() if distinct else edges


def call_graph(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """Extracted calls to edges between chunk ids."""
    files = chunks.select("chunk_id", F.col("path").alias("caller_file"))
    return resolve_callees(calls.join(files, "chunk_id"), chunks).select(F.col("chunk_id").alias("caller"), F.col("callee_chunk").alias("callee"), "confidence")


# ------------------------------------------------------------------ simple extraction


def simple_callees(content: Column, language: Column) -> Column:
    """TXT-10: distinct names that look called or imported."""
    def names(patterns: list[str]) -> Column:
        found = F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in patterns])
        return F.filter(F.array_except(found, F.array(*map(F.lit, SKIP_NAMES))), lambda x: F.length(x) > 1)

    out = names(SIMPLE_CALLS["python"])
    for lang, patterns in SIMPLE_CALLS.items():
        out = F.when(language == lang, names(patterns)).otherwise(out)
    return out


# Definition patterns by extension, name in the first filled group.
FINDERS = {
    ".py": r"^[ \t]*(?:async\s+)?def\s+(\w+)\s*\(",
    ".java": r"(?:public|private|protected|static|\s)+[\w<>\[\]]+\s+(\w+)\s*\(",
    ".js": r"(?:async\s+)?(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(?)",
    ".ts": r"(?:async\s+)?(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*[=:])",
    ".cs": r"(?:public|private|protected|internal|static|\s)+[\w<>\[\]]+\s+(\w+)\s*\(",
    ".go": r"func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(",
    ".kt": r"(?:fun|suspend\s+fun)\s+(\w+)\s*\(",
}
OTHER_FINDER = r"(?:def|func|function|fn)\s+(\w+)\s*\("


def defined_name(line: Column, ext: Column) -> Column:
    """Name that a line defines, empty when it defines none."""
    def first(p: str) -> Column:
        one = F.regexp_extract(line, p, 1)
        return one if re.compile(p).groups < 2 else F.when(one != "", one).otherwise(F.regexp_extract(line, p, 2))

    out = first(OTHER_FINDER)
    for e, p in FINDERS.items():
        out = F.when(ext == e, first(p)).otherwise(out)
    return out


def find_function(files: DataFrame, function_name: str) -> DataFrame:
    """TXT-11: lines that define ``function_name``."""
    from kgaudit.operators.profile import file_lines

    lines = file_lines(files.where(F.contains("content", F.lit(function_name))))
    named = lines.withColumn("name", defined_name(F.col("line"), fx.extension("path")))
    return named.where(F.col("name") == function_name).select("path", "line_number", fx.strip("line").alias("match"))


def function_bodies(files: DataFrame, wanted: DataFrame, max_lines: int | None = None, unbalanced: int | None = None) -> DataFrame:
    """TXT-12: body of each wanted (path, function_name), found inside the file's row.

    Python files end a body at the first line indented no deeper than its ``def``; all
    others where the braces balance, and else at the end of the file. For display only,
    a body of more than ``max_lines`` lines can be reduced to its first and last ones, and one
    whose braces never balance to ``unbalanced`` lines after the first.
    """
    named = wanted.where(fx.text("function_name") != "")
    # Names are found once per wanted file, whatever number of its functions is wanted.
    texts = files.join(named.select("path").distinct(), "path", "left_semi").select("path", F.split("content", r"\r?\n").alias("lines"), fx.extension("path").alias("ext"))
    texts = texts.withColumn("names", F.transform("lines", lambda line: defined_name(line, F.col("ext"))))
    ext = F.col("ext")
    rows = named.join(texts, "path").withColumns({"start": F.coalesce(F.array_position("names", F.col("function_name")).cast("int"), F.lit(0)) - 1, "total": F.size("lines")}).where("start >= 0")

    def indent(line: Column) -> Column:
        return F.length(line) - F.length(F.ltrim(F.translate(line, "\t", " ")))

    later = F.when(F.col("start") + 1 < F.col("total"), F.sequence(F.col("start") + 1, F.col("total") - 1)).otherwise(F.array().cast("array<int>"))

    def ends_block(i: Column) -> Column:
        line = F.get(F.col("lines"), i)
        code = fx.strip(line)
        return (code != "") & ~F.startswith(code, F.lit("#")) & (indent(line) <= indent(F.get(F.col("lines"), F.col("start"))))

    by_indent = F.coalesce(F.get(F.filter(later, ends_block), F.lit(0)) - 1, F.col("total") - 1)
    marks = F.split(F.regexp_replace(F.array_join(F.slice("lines", F.col("start") + 1, F.col("total")), "\n"), r"[^{}\n]", ""), "")
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("line"), F.lit(False).alias("open"), F.lit(-1).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        opened = s["open"] | (c == "{")
        closed = (c == "}") & opened & (depth == 0) & (s["end"] < 0)
        return F.struct(depth.alias("depth"), (s["line"] + F.when(c == "\n", 1).otherwise(0)).alias("line"), opened.alias("open"), F.when(closed, s["line"]).otherwise(s["end"]).alias("end"))

    rows = rows.withColumn("closing", F.when(ext != ".py", F.aggregate(marks, state, step)["end"]))
    closing = F.col("closing")
    by_brace = F.when(closing >= 0, F.col("start") + closing).otherwise(F.col("total") - 1 if unbalanced is None else F.least(F.col("start") + unbalanced, F.col("total") - 1))
    rows = rows.withColumn("stop", F.when(ext == ".py", by_indent).otherwise(by_brace))
    body = F.slice("lines", F.col("start") + 1, F.col("stop") - F.col("start") + 1)
    shown = body
    if max_lines is not None:
        half = max_lines // 2
        short = F.concat(F.slice(body, 1, half), F.array(F.concat(F.lit("// ... ("), (F.size(body) - max_lines).cast("string"), F.lit(" lines truncated) ..."))), F.slice(body, F.size(body) - half + 1, half))
        shown = F.when(F.size(body) > max_lines, short).otherwise(body)
    return rows.select("path", "function_name", (F.col("start") + 1).alias("line_start"), (F.col("stop") + 1).alias("line_end"), F.array_join(shown, "\n").alias("body"))


def fresh_sites(chunks: DataFrame) -> DataFrame:
    """GRA-14: call sites extracted anew from chunk texts, in the shape of
    ``graph.located_sites`` input; callee files are left to the index."""
    named = chunks.select("chunk_id", "path", "function_name", "class_name", F.posexplode(simple_callees(F.col("content"), F.col("language"))).alias("seq", "callee"))
    return named.select(F.col("seq").cast("bigint").alias("seq"), F.lit(PAREN_CALL).alias("confidence"), F.col("function_name").alias("caller"), F.col("path").alias("caller_file"), F.col("class_name").alias("caller_class"),
                        "callee", F.lit("").alias("callee_file"), F.lit("").alias("callee_class"))
