"""File inventory, layers, coupling and reply parsing (TXT-17..22, TXT-24..27, JOIN-17, JOIN-19, GRA-15, AGG-15, AGG-16, AGG-24..26, FIL-16, QR-30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx
from kgaudit.operators.profile import head_with_more

# What shows the layer of a file.
PRESENTATION_EXTENSIONS = [
    ".cshtml", ".aspx", ".ascx", ".razor", ".master", ".html", ".htm", ".jsx", ".tsx", ".vue", ".svelte", ".css",
    ".scss", ".less", ".sass", ".xaml", ".resx",
]
DATA_NAMES = [
    "repository", "repo", "dal", "dataaccess", "dbcontext", "migration", "entityframework", "dapper", "ado",
    "sqlhelper", "storage", "database", "dbwriter", "sqlite", "dbfactory",
]
BUSINESS_NAMES = [
    "service", "manager", "handler", "processor", "engine", "validator", "workflow", "rule", "policy", "usecase",
    "archiver", "communication", "runtime", "server", "client", "plug", "timer", "channel", "converter",
    "condition",
]
CONFIG_NAMES = [
    "startup", "program", "appsettings", "web.config", "global.asax", "bundleconfig", "webpack", "package.json",
    "tsconfig", "assemblyinfo", "app.config",
]
PRESENTATION_FOLDERS = ["views", "pages", "components", "ui", "frontend", "wwwroot", "designer", "visualcontrols", "controls", "design", "images"]
BUSINESS_FOLDERS = ["controllers", "api", "endpoints", "communication", "runtime", "samples"]
DATA_FOLDERS = ["data", "models", "entities", "dal", "repositories"]
SHARED_FOLDERS = ["shared", "common", "utils", "helpers", "lib"]
VIEW_SUFFIXES = [".designer.cs", "form.cs", "control.cs", "usercontrol.cs", "dialog.cs", "window.cs", "view.cs", "panel.cs"]
MARKUP_EXTENSIONS = [
    ".cshtml", ".aspx", ".ascx", ".razor", ".master", ".html", ".htm", ".jsx", ".tsx", ".vue", ".svelte", ".css",
    ".scss", ".less", ".sass", ".js", ".ts",
]
ENDPOINT_WORDS = ["get", "post", "put", "delete", "patch", "create", "update", "list", "fetch"]
# Declaration starts and words that are no names.
DECLARATIONS = [
    "export function ", "export const ", "export async function ", "export default function ", "export class ", "export interface ",
    "function ", "async function ", "def ", "async def ", "class ", "public ", "private ", "protected ", "internal ", "interface ",
]
KEYWORDS = [
    "EXPORT", "FUNCTION", "ASYNC", "CONST", "LET", "VAR", "CLASS", "INTERFACE", "ENUM", "TYPE", "ABSTRACT",
    "STATIC", "READONLY", "OVERRIDE", "VIRTUAL", "SEALED", "PARTIAL", "VOID", "BOOL", "INT", "STRING", "FLOAT",
    "DOUBLE", "LONG", "BYTE", "CHAR", "OBJECT", "DYNAMIC", "DECIMAL", "TASK", "DEF", "SELF", "RETURN", "PUBLIC",
    "PRIVATE", "PROTECTED", "INTERNAL", "NEW", "STRUCT", "NAMESPACE", "USING", "IMPORT", "FROM", "EXTENDS",
    "IMPLEMENTS",
]
DECLARED_EXTENSIONS = [".ts", ".tsx", ".cs", ".py", ".js", ".jsx"]


def words(items: list[str]) -> Column:
    return F.array(*map(F.lit, items))


def classify_layer(path: Column | str) -> Column:
    """TXT-18: struct(layer, confidence) by extension, then .NET rules, then path parts."""
    lower = F.lower(fx.slashes(path))
    parts, stem = F.split(lower, "/"), fx.path_stem(lower)
    first, others = F.get(parts, F.lit(0)), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    named = words(DATA_NAMES + BUSINESS_NAMES + CONFIG_NAMES)

    def name_layer(x: Column) -> Column:
        return F.when(x.isin(DATA_NAMES), "data_access").when(x.isin(BUSINESS_NAMES), "business_logic").when(x.isin(CONFIG_NAMES), "configuration")

    def inside(folders: list[str]) -> Column:
        return F.arrays_overlap(parts, words(folders))

    sharp = (
        F.when(F.exists(words(VIEW_SUFFIXES), lambda s: F.endswith(lower, s)) | inside(PRESENTATION_FOLDERS), "presentation")
        .when(name_layer(stem).isNotNull(), name_layer(stem))
        .when(inside(DATA_FOLDERS), "data_access").when(inside(BUSINESS_FOLDERS), "business_logic").when(inside(SHARED_FOLDERS), "shared")
        .otherwise("business_logic")
    )
    # The stem counts together with the first part, further parts stand alone.
    opening = (
        F.when(first.isin(DATA_NAMES) | stem.isin(DATA_NAMES), "data_access").when(first.isin(BUSINESS_NAMES) | stem.isin(BUSINESS_NAMES), "business_logic")
        .when(first.isin(CONFIG_NAMES) | stem.isin(CONFIG_NAMES), "configuration")
    )
    later = name_layer(F.get(F.filter(others, lambda x: F.array_contains(named, x)), F.lit(0)))
    folder = (
        F.when(inside(PRESENTATION_FOLDERS), "presentation").when(inside(BUSINESS_FOLDERS), "business_logic")
        .when(inside(DATA_FOLDERS), "data_access").when(inside(SHARED_FOLDERS), "shared")
    )
    by_path = F.coalesce(opening, later, folder)
    by_ext, is_sharp = fx.extension(path).isin(PRESENTATION_EXTENSIONS), F.endswith(lower, F.lit(".cs"))
    layer = F.when(by_ext, "presentation").when(is_sharp, sharp).otherwise(F.coalesce(by_path, F.lit("unknown")))
    confidence = F.when(by_ext, 0.9).when(is_sharp, 0.7).when(by_path.isNotNull(), 0.75).otherwise(0.3)
    return F.struct(layer.alias("layer"), confidence.alias("confidence"))


def complexity(loc: Column | str, functions: Column | str) -> Column:
    """TXT-17."""
    n, f = fx.col(loc), fx.col(functions)
    return F.when((n > 1000) | (f > 20), "very_high").when((n > 500) | (f > 10), "high").when((n > 150) | (f > 5), "medium").otherwise("low")


def related_files(paths: DataFrame) -> DataFrame:
    """JOIN-19, GRA-15: (path, related) within a folder: equal stem, a stem that goes on
    after a dot, or a name that goes on after a dot.

    The going-on texts are cut at their dots into keys, so only related files meet.
    """
    files = paths.select("path").distinct().select("path", fx.parent_dir("path").alias("_dir"), fx.path_stem("path").alias("_stem"), fx.base_name("path").alias("_name"))

    def cuts(c: str, whole: bool) -> Column:
        parts = F.split(c, r"\.")
        upto = F.size(parts) if whole else F.size(parts) - 1
        counts = F.when(upto >= 1, F.sequence(F.lit(1), upto)).otherwise(F.array().cast("array<int>"))
        return F.transform(counts, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))

    def tag(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda x: F.struct(F.lit(kind).alias("_kind"), x.alias("_key")))

    wanted = files.select("path", "_dir", F.inline(F.concat(tag("stem", F.array("_stem")), tag("name", F.array("_name")))))
    offered = files.select(F.col("path").alias("related"), "_dir", F.inline(F.concat(tag("stem", cuts("_stem", True)), tag("name", cuts("_name", False)))))
    return wanted.join(offered, ["_dir", "_kind", "_key"]).where("path <> related").select("path", "related").distinct()


def edge_layers(call_edges: DataFrame, layers: DataFrame) -> DataFrame:
    """JOIN-17: layer of both ends of every call site; ``layers`` has (path, layer)."""
    known = layers.groupBy("path").agg(F.max("layer").alias("layer"))
    out = call_edges
    for end in ("caller", "callee"):
        file = F.when(F.contains(end, F.lit("::")), F.substring_index(end, "::", 1)).otherwise("")
        out = out.withColumn("_f", file).join(known.withColumnsRenamed({"path": "_f", "layer": f"{end}_layer"}), "_f", "left").drop("_f")
        out = out.withColumn(f"{end}_layer", F.coalesce(f"{end}_layer", F.lit("unknown")))
    return out


def layer_coupling(edges: DataFrame, n: int | None = None) -> DataFrame:
    """AGG-15: calls between different known layers, the ``n`` most frequent pairs if ``n`` is given."""
    crossing = edges.where("caller_layer <> callee_layer AND caller_layer <> 'unknown' AND callee_layer <> 'unknown'")
    pairs = crossing.groupBy("caller_layer", "callee_layer").agg(F.count(F.lit(1)).alias("edges")).orderBy(F.desc("edges"), "caller_layer", "callee_layer")
    return pairs if n is None else pairs.limit(n)


def file_inventory(code_index: DataFrame, sizes: DataFrame, layers: DataFrame) -> DataFrame:
    """TXT-19: one row per indexed file; ``sizes`` has (path, loc) of all files."""
    files = code_index.groupBy(F.col("file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("function_count"), F.max(F.nullif("language", F.lit(""))).alias("language"))
    related = related_files(files).groupBy("path").agg(F.count(F.lit(1)).alias("related"))
    behind = sizes.select(F.regexp_replace("path", r"\.(cs|vb)$", "").alias("path"), F.rlike(F.col("path"), F.lit(r"\.(cs|vb)$")).alias("_cb")).where("_cb").distinct()
    known = layers.groupBy("path").agg(F.max("layer").alias("layer"))
    joined = (
        files.join(sizes.groupBy("path").agg(F.max("loc").alias("loc")), "path", "left").join(known, "path", "left").join(behind, "path", "left").join(related, "path", "left")
        .withColumns({"loc": F.coalesce("loc", F.lit(0)), "layer": F.coalesce("layer", F.lit("unknown")), "related": F.coalesce("related", F.lit(0))})
    )
    side = F.when(F.col("layer") == "presentation", "frontend").when(F.col("layer") == "shared", "shared").otherwise("backend")
    ext = fx.extension("path")
    return joined.select(
        "path", ext.alias("file_type"), fx.text("language").alias("language"), "layer", "loc", "function_count", complexity("loc", "function_count").alias("complexity"),
        ext.isin(MARKUP_EXTENSIONS).alias("has_ui_markup"), F.coalesce("_cb", F.lit(False)).alias("has_code_behind"), "related", side.alias("side"))


def is_endpoint(name: Column | str) -> Column:
    """TXT-20."""
    return F.rlike(F.lower(fx.col(name)), F.lit("^(" + "|".join(ENDPOINT_WORDS) + ")|(" + "|".join(ENDPOINT_WORDS) + ")$"))


def api_endpoints(code_index: DataFrame, inventory: DataFrame) -> DataFrame:
    backend = inventory.where("side = 'backend'").select(F.col("path").alias("file_path"))
    return code_index.where(is_endpoint("function_name")).join(backend, "file_path", "left_semi").select(F.concat_ws("::", "file_path", "function_name").alias("endpoint"))


def component_name(path: Column | str) -> Column:
    """TXT-21: CamelCase of the file stem."""
    name = F.array_join(F.transform(F.split(F.translate(fx.path_stem(path), "-", "_"), "_"), F.initcap), "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("UnnamedComponent"))


def declared_names(files: DataFrame) -> DataFrame:
    """TXT-22: (name, path) of the first identifier of every declaration line."""
    lines = files.where(fx.extension("path").isin(DECLARED_EXTENSIONS)).select("path", F.explode(F.split("content", r"\r?\n")).alias("line")).select("path", fx.strip("line").alias("line"))
    starts = F.rlike(F.col("line"), F.lit("^(" + "|".join(DECLARATIONS) + ")"))
    tokens = F.transform(F.split("line", r"\s+"), lambda x: F.regexp_extract(x, r"^[^(:<{]*", 0))
    usable = F.filter(tokens, lambda x: (F.length(x) > 2) & F.rlike(x, F.lit(r"^\p{L}")) & ~F.upper(x).isin(KEYWORDS))
    return lines.where(starts).select(F.upper(F.get(usable, F.lit(0))).alias("name"), "path").where("name IS NOT NULL")


# ------------------------------------------------------------------ reply parsing


def reply_field(line: Column | str, key: str, default: str = "") -> Column:
    """TXT-24: value of ``KEY: value`` in a pipe-separated line; the last one counts."""
    segments = F.transform(F.split(fx.col(line), r"\|"), fx.strip)
    named = F.filter(segments, lambda s: F.contains(s, F.lit(":")) & (F.upper(fx.strip(F.substring_index(s, ":", 1))) == key))
    last = F.try_element_at(named, F.lit(-1))
    return F.coalesce(fx.strip(F.regexp_replace(last, "^[^:]*:", "")), F.lit(default))


def reply_lines(replies: DataFrame, start: str) -> DataFrame:
    """Lines of the texts (key, text) that begin with ``start``."""
    lines = replies.select("key", F.explode(F.split("text", r"\r?\n")).alias("line")).select("key", fx.strip("line").alias("line"))
    return lines.where(F.startswith("line", F.lit(start)))


def parse_components(replies: DataFrame) -> DataFrame:
    lines = reply_lines(replies, "COMPONENT:")
    return lines.select("key", reply_field("line", "COMPONENT", "Unknown").alias("component_name"), F.lower(reply_field("line", "TYPE", "page")).alias("component_type"),
                        _listed("SOURCES").alias("source_files"), _listed("PROPS").alias("props"), F.lower(reply_field("line", "REUSE", "medium")).alias("reuse"))


def _listed(key: str) -> Column:
    return F.filter(F.transform(F.split(reply_field("line", key), ","), fx.strip), lambda x: x != "")


def parse_test_specs(replies: DataFrame, categories: list[str]) -> DataFrame:
    category = F.lower(reply_field("line", "CATEGORY", "functional"))
    return reply_lines(replies, "TEST:").select(
        "key", reply_field("line", "TEST", "unnamed_test").alias("test_name"), F.when(category.isin(categories), category).otherwise("functional").alias("category"),
        reply_field("line", "FUNCTION").alias("source_function"), reply_field("line", "FILE").alias("source_file"), reply_field("line", "BEHAVIOR").alias("expected_behavior"))


def parse_matches(replies: DataFrame) -> DataFrame:
    return reply_lines(replies, "LEGACY:").select(
        "key", reply_field("line", "LEGACY").alias("legacy"), F.lower(reply_field("line", "STATUS", "missing")).alias("status"),
        F.nullif(reply_field("line", "NEW_FILE", "none"), F.lit("none")).alias("new_file"), reply_field("line", "NOTES").alias("notes"))


def salvage_json(text: Column | str) -> Column:
    """TXT-25: the first valid JSON of: the whole text, its fenced block, the span from
    the first to the last brace."""
    body = fx.strip(fx.text(text))
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    braces = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    out = F.lit(None).cast("string")
    for candidate in (braces, fenced, body):
        out = F.when((candidate != "") & F.try_parse_json(candidate).isNotNull(), candidate).otherwise(out)
    return out


def code_blocks(text: Column | str) -> Column:
    """TXT-26: fenced blocks without their first line, or the whole text."""
    parts = F.split(fx.text(text), "```")
    odd = F.filter(parts, lambda x, i: i % 2 == 1)
    bodies = F.transform(odd, lambda b: fx.strip(F.regexp_replace(b, r"^[^\n]*\n", "")))
    return F.when(F.size(bodies) == 0, F.array(fx.strip(fx.text(text)))).otherwise(bodies)


def source_bundle(wanted: DataFrame, files: DataFrame, most: int | None = None, size: int | None = None) -> DataFrame:
    """TXT-27: one text per component of its files, whole unless ``most`` limits the files and
    ``size`` the characters; ``wanted`` has (component, position, path)."""
    head = head_with_more(wanted, ["component"], ["position", "path"], most).select("component", "path", "position")
    joined = head.join(files.select("path", F.col("content").alias("_text")), "path", "left")
    cut = F.coalesce("_text", F.lit("(file not readable)"))
    if size is not None:
        cut = F.when(F.length("_text") > size, F.concat(F.substring("_text", 1, size), F.lit("\n// ... truncated ..."))).otherwise(cut)
    section = F.concat(F.lit("=== "), F.col("path"), F.lit(" ===\n"), cut)
    lists = joined.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("position", section.alias("s")))).alias("_l"))
    return lists.select("component", F.array_join(F.transform("_l", lambda x: x["s"]), "\n\n").alias("bundle"))


# ------------------------------------------------------------------ reports


def layer_items(code_index: DataFrame, layers: DataFrame, limit: int | None = None) -> DataFrame:
    """FIL-16: functions of the business, data and shared layers."""
    known = layers.where(F.col("layer").isin("business_logic", "data_access", "shared")).groupBy("path").agg(F.max("layer").alias("layer"))
    items = code_index.join(known.withColumnRenamed("path", "file_path"), "file_path").select("function_name", "file_path", "class_name", "layer")
    return items.orderBy("file_path", "function_name").limit(limit) if limit else items


def test_output_totals(lines: DataFrame) -> DataFrame:
    """AGG-24: passed and failed tests from log lines (run, line)."""
    low = F.lower(fx.strip("line"))

    def number(before: str) -> Column:
        digits = F.regexp_replace(F.substring_index(low, before, 1), "[^0-9]", "")
        return F.when(digits == "", 0).otherwise(digits.try_cast("bigint"))

    passing = F.contains(low, F.lit("tests passed")) | F.contains(low, F.lit("passing"))
    failing = ~passing & (F.contains(low, F.lit("failing")) | F.contains(low, F.lit("failed")))
    counted = lines.select("run", F.when(passing, number("pass")).otherwise(0).alias("p"), F.when(failing, number("fail")).otherwise(0).alias("f"))
    return counted.groupBy("run").agg(F.sum(F.col("p") + F.col("f")).alias("total"), F.sum("p").alias("passed"), F.sum("f").alias("failed"))


def spec_counts(specs: DataFrame) -> DataFrame:
    """AGG-25."""
    return specs.groupBy("category").agg(F.count(F.lit(1)).alias("tests"))


def functions_per_file(code_index: DataFrame, names: int | None = None, files: int | None = None) -> DataFrame:
    """AGG-26: names of each file as text, the first ``names`` if given."""
    chosen = code_index
    if files:
        first = code_index.groupBy("file_path").agg(F.min("seq").alias("_s")).orderBy("_s", "file_path").limit(files)
        chosen = code_index.join(first.select("file_path"), "file_path", "left_semi")
    head = head_with_more(chosen, ["file_path"], ["seq", "function_name"], names)
    lists = head.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("position", "function_name"))).alias("_l"), F.max("more").alias("more"))
    return lists.select("file_path", F.array_join(F.transform("_l", lambda x: x["function_name"]), ", ").alias("functions"), "more")


def fallback_specs(inventory: DataFrame, components: DataFrame, most: int | None = None) -> DataFrame:
    """QR-30: sanity tests of the backend files and the components, the first ``most`` of each if given."""
    head = lambda rows: rows if most is None else rows.limit(most)
    files = head(inventory.where("side = 'backend'").orderBy("path")).select(
        F.concat(F.lit("test_"), fx.path_stem("path"), F.lit("_sanity")).alias("test_name"), F.lit("").alias("source_function"), F.col("path").alias("source_file"))
    parts = head(components.orderBy("component_name")).select(
        F.concat(F.lit("test_"), "component_name", F.lit("_renders")).alias("test_name"), F.col("component_name").alias("source_function"), F.lit("").alias("source_file"))
    return files.unionByName(parts).withColumn("category", F.lit("sanity"))
