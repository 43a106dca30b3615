"""Migration roadmap and parity (QR-28, QR-29, WIN-11, WIN-12, AGG-18..20, JOIN-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgaudit.operators.text_joins import contained_keys, smallest_holder
from kgaudit.session import checkpointed, ordinal

# Hours per complexity, caps and shares.
HOURS = {"low": 2.0, "medium": 6.0, "high": 16.0, "very_high": 40.0}
OTHER_HOURS, EMPTY_HOURS, MOST_HOURS = 6.0, 4.0, 80.0
INTEGRATION_SHARE, INTEGRATION_LEAST = 0.15, 8.0
NAME_SUFFIXES = ["CONTROLLER", "SERVICE", "HANDLER", "PROVIDER", "REPOSITORY", "MANAGER"]


def hours_of(complexity: Column) -> Column:
    out = F.lit(OTHER_HOURS)
    for name, hours in HOURS.items():
        out = F.when(complexity == name, hours).otherwise(out)
    return out


def component_items(components: DataFrame, inventory: DataFrame) -> DataFrame:
    """QR-28 for components (component_name, path or null per source file): the files
    times the hours of the first known file, capped."""
    sized = components.join(inventory.select("path", "complexity"), "path", "left")
    first = F.min_by("complexity", F.when(F.col("complexity").isNotNull(), F.col("path")))
    n = F.count("path")
    per = sized.groupBy("component_name").agg(n.alias("files"), first.alias("_c"))
    hours = F.when(F.col("files") == 0, EMPTY_HOURS).otherwise(F.col("files") * hours_of(F.col("_c")))
    return per.select(F.col("component_name").alias("name"), "files", F.least(hours, F.lit(MOST_HOURS)).alias("hours"), F.lit("frontend").alias("kind"), F.lit("medium").alias("complexity"))


def backend_items(inventory: DataFrame) -> DataFrame:
    """QR-28 for backend files; files of shared folders form the foundation."""
    shared = F.contains(F.lower("path"), F.lit("shared")) | F.contains(F.lower("path"), F.lit("common"))
    return inventory.where("side = 'backend'").select(
        F.concat(F.lit("Backend: "), "path").alias("name"), F.lit(1).cast("bigint").alias("files"), hours_of(F.col("complexity")).alias("hours"),
        F.when(shared, "foundation").otherwise("backend").alias("kind"), "complexity")


def item_dependencies(sources: DataFrame, related: DataFrame, most: int | None = None) -> DataFrame:
    """QR-28: related files per item (name, path) outside its sources, the first ``most`` if given."""
    from kgaudit.operators.profile import head_with_more

    found = sources.join(related, "path").select("name", F.col("related").alias("path")).distinct()
    outside = found.join(sources.select("name", "path"), ["name", "path"], "left_anti")
    return head_with_more(outside, ["name"], ["path"], most).select("name", F.col("path").alias("dependency"))


def batches(components: DataFrame, seq: str, ties: list[str]) -> DataFrame:
    """WIN-11: batch number, with a third of all rows per batch and at least one row."""
    total = components.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = F.greatest(F.floor(total / 3), F.lit(1))
    placed = ordinal(components.withColumn("_all", F.lit(0)), ["_all"], seq, ties, "_pos").drop("_all")
    return placed.withColumn("batch", F.floor((F.col("_pos") - 1) / size) + 1).drop("_pos")


def phases(foundation_and_backend: DataFrame, frontend: DataFrame) -> DataFrame:
    """QR-29, WIN-12, AGG-19: numbered phases with their hours.

    ``frontend`` carries a ``batch``. Only phases with items get a number; integration
    comes last with a share of all hours.
    """
    slots = foundation_and_backend.select(F.when(F.col("kind") == "foundation", 0).otherwise(1).cast("bigint").alias("slot"), "hours").unionByName(
        frontend.select((F.col("batch") + 1).cast("bigint").alias("slot"), "hours"))
    sums = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("items"), F.sum("hours").alias("hours"))
    final = sums.agg(F.lit(1 << 40).alias("slot"), F.lit(0).cast("bigint").alias("items"),
                     F.greatest(F.coalesce(F.sum("hours"), F.lit(0.0)) * INTEGRATION_SHARE, F.lit(INTEGRATION_LEAST)).alias("hours"))
    listed = sums.unionByName(final)
    name = F.when(F.col("slot") == 0, "foundation").when(F.col("slot") == 1, "backend").when(F.col("slot") == 1 << 40, "integration").otherwise(F.concat(F.lit("frontend "), (F.col("slot") - 1).cast("string")))
    # The window spans at most eight rows: up to five front-end batches and three others.
    phase = F.row_number().over(Window.orderBy("slot")).cast("bigint")
    return listed.select(phase.alias("phase"), name.alias("name"), "items", "hours")


def roadmap_totals(phase_table: DataFrame) -> DataFrame:
    """AGG-19."""
    return phase_table.agg(F.count(F.lit(1)).alias("phases"), F.sum("items").alias("items"), F.sum("hours").alias("total_hours"))


def risks(inventory: DataFrame, endpoints: DataFrame) -> DataFrame:
    """AGG-20: one row per risk that applies."""
    n = inventory.agg(
        F.count_if(F.col("complexity").isin("high", "very_high")).alias("complex"), F.count_if(F.col("layer") == "unknown").alias("unplaced"),
        F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"))
    calls = endpoints.agg(F.count(F.lit(1)).alias("n")).scalar()
    found = F.array_compact(F.array(
        F.when(F.col("complex") > 10, F.struct(F.lit("high_complexity").alias("risk"), F.col("complex").alias("amount"))),
        F.when(F.col("unplaced") > 0, F.struct(F.lit("unknown_layer").alias("risk"), F.col("unplaced").alias("amount"))),
        F.when(F.col("loc") > 100_000, F.struct(F.lit("large_code_base").alias("risk"), F.col("loc").alias("amount"))),
        F.when(calls == 0, F.struct(F.lit("no_endpoints").alias("risk"), F.lit(0).cast("bigint").alias("amount")))))
    return n.select(F.inline(found))


# ------------------------------------------------------------------ parity


def match_names(names: DataFrame, declared: DataFrame) -> DataFrame:
    """JOIN-18: the declared name each distinct ``name`` maps to.

    Equal, else with a usual suffix in list order, else the smallest name that contains
    it, else the longest name it contains. Only names that share the rarest piece of the
    contained one are compared.
    """
    keys = declared.select(F.col("name").alias("key")).distinct()
    n = names.select("name").where("name <> ''").distinct()
    exact = n.join(keys, n.name == keys.key).select("name", "key", F.lit(0).alias("rank"))
    tails = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.concat("name", F.lit(s)).alias("key")) for i, s in enumerate(NAME_SUFFIXES)])
    suffixed = n.select("name", F.inline(tails)).join(keys, "key").select("name", "key", "rank")
    rest = n.join(exact.select("name").unionByName(suffixed.select("name")).distinct(), "name", "left_anti")
    rest = checkpointed(rest)
    held = smallest_holder(rest, keys).select("name", "key", F.lit(100).alias("rank"))
    inner = contained_keys(rest, keys).select("name", "key", (F.lit(100_000) - F.length("key")).alias("rank"))
    found = exact.unionByName(suffixed).unionByName(held).unionByName(inner)
    return found.groupBy("name").agg(F.min_by("key", F.struct("rank", "key")).alias("match"))


def check_parity(items: DataFrame, declared: DataFrame) -> DataFrame:
    """Status of every legacy item (function_name, file_path); its bare name is tried
    when the full name finds nothing."""
    from kgaudit.functions import scalars as fx

    keyed = items.withColumns({"_full": F.upper("function_name"), "_bare": F.substring_index(F.upper("function_name"), ".", -1)})
    names = keyed.select(F.col("_full").alias("name")).unionByName(keyed.select(F.col("_bare").alias("name"))).distinct()
    found = match_names(names, declared)
    files = declared.groupBy(F.col("name").alias("match")).agg(F.min("path").alias("new_file"), F.count(F.lit(1)).alias("places"))
    hit = keyed.join(found.withColumnsRenamed({"name": "_full", "match": "_m1"}), "_full", "left").join(found.withColumnsRenamed({"name": "_bare", "match": "_m2"}), "_bare", "left")
    placed = hit.withColumn("match", F.coalesce("_m1", "_m2")).join(files, "match", "left")
    return placed.select(*items.columns, F.when(F.col("match").isNull(), "missing").otherwise("migrated").alias("status"), fx.text("new_file").alias("new_file"), F.coalesce("places", F.lit(0)).alias("places"))


def apply_verdicts(parity: DataFrame, verdicts: DataFrame) -> DataFrame:
    """External match verdicts (legacy, status, new_file) over the checked items."""
    last = verdicts.where(F.col("status").isin("migrated", "partial", "missing", "not_applicable")).groupBy(F.col("legacy").alias("function_name")).agg(
        F.max("status").alias("_status"), F.max("new_file").alias("_file"))
    out = parity.join(last, "function_name", "left")
    return out.withColumns({"status": F.coalesce("_status", "status"), "new_file": F.coalesce("_file", "new_file")}).select(*parity.columns)


def parity_summary(parity: DataFrame) -> DataFrame:
    """AGG-18."""
    n = F.count(F.lit(1))
    done = F.count_if(F.col("status") == "migrated")
    return parity.agg(n.alias("total"), done.alias("migrated"), F.count_if(F.col("status") == "partial").alias("partial"), F.count_if(F.col("status") == "missing").alias("missing"),
                      F.when(n > 0, done / F.greatest(n, F.lit(1)) * 100).otherwise(0.0).alias("coverage_pct"))
