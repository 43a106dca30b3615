"""The 29-rule graph quality checklist (QR-1..17, WIN-6..8, AGG-17).

Every rule is a DataFrame of failed keys; all failures are kept as rows, since a rule
may fail for a third of the graph.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx
from kgaudit.operators import graph as gr
from kgaudit.session import checkpointed
from kgaudit.sources import graph as g

# The rules (item, title, category, priority).
RULES = [
    (1, "All required node types present", "Nodes", "Critical"),
    (2, "Every node has execution_order", "Nodes", "Critical"),
    (3, "Root Snippet has root_type set", "Nodes", "Critical"),
    (4, "Every node has name attribute", "Nodes", "Required"),
    (5, "short_summary present on all snippets", "Nodes", "Required"),
    (6, "business_summary present on all snippets", "Nodes", "Required"),
    (7, "snippet attribute present on snippet nodes", "Nodes", "Required"),
    (8, "topic attribute present", "Nodes", "Required"),
    (9, "function_name present where applicable", "Nodes", "Required"),
    (10, "meaning attribute present on Variable nodes", "Nodes", "Required"),
    (11, "visual_imagery_data present", "Nodes", "Required"),
    (12, "table_names present on DBCall nodes", "Nodes", "Critical"),
    (13, "CALLS connects all snippets in the flow", "Relationships", "Critical"),
    (14, "CALLS has global_execution_order", "Relationships", "Critical"),
    (15, "All snippets have PARTICIPATES_IN_FLOW", "Relationships", "Critical"),
    (16, "CONTAINS_DB_CALLS present where DB calls exist", "Relationships", "Required"),
    (17, "CONTAINS_CALCULATION present where calculations exist", "Relationships", "Required"),
    (18, "CONTAINS_SERVICE_CALLS present where service calls exist", "Relationships", "Required"),
    (19, "CONTAINS_INPUT present where input exists", "Relationships", "Required"),
    (20, "CONTAINS_MAP_FILE present where map file exists", "Relationships", "Required"),
    (21, "CONTAINS_DMN present where decision logic exists", "Relationships", "Required"),
    (22, "HAS_STEP present for Job nodes", "Relationships", "Required"),
    (23, "Contains_variable present for Snippet/Step", "Relationships", "Required"),
    (24, "execution_order is sequential and correct", "Execution Order", "Critical"),
    (25, "global_execution_order on CALLS is consistent", "Execution Order", "Critical"),
    (26, "Root snippet is first in execution order", "Execution Order", "Critical"),
    (27, "No orphan snippets", "Connectivity", "Critical"),
    (28, "All paths trace back to root", "Connectivity", "Critical"),
    (29, "Execution flow node exists", "Connectivity", "Required"),
]
# Rules that always pass because the graph cannot show what they ask for.
NOT_VERIFIABLE = [17, 18, 19, 20, 21]


class RunGraph:
    """The tables of one run that the rules read."""

    def __init__(self, nodes: DataFrame, rels: DataFrame, project_id: int, run_id: int):
        # The rules read these small key tables many times; node attributes are read
        # from the node table itself, only the columns a rule needs.
        self.flows = g.flow_keys(nodes, project_id, run_id)
        members = g.participants(nodes, rels, self.flows)
        self.members = checkpointed(members.select("flow_key", "key", "starts_flow", "execution_order"))
        self.roots = self.members.where("starts_flow").select("key").distinct()
        self.contained = checkpointed(g.contained_keys(rels, self.members))
        own = g.run_nodes(nodes, project_id, run_id)
        # Children may lack a project; a node of the run is never listed twice.
        reached = checkpointed(g.child_keys(nodes, self.contained).join(own.select("key"), "key", "left_anti"))
        self.nodes = own.unionByName(nodes.join(reached, "key", "left_semi").select(*own.columns))
        snippets = g.labelled(nodes, "Snippet")
        callers = snippets.where((F.col("project_id") == project_id) & (F.col("run_id") == run_id)).select(F.col("key").alias("src_key"))
        callees = snippets.select(F.col("key").alias("dst_key"))
        self.calls = checkpointed(
            rels.where("rel_type = 'CALLS'").join(callers, "src_key", "left_semi").join(callees, "dst_key", "left_semi")
            .select(F.col("src_key").alias("caller"), F.col("dst_key").alias("callee"), "execution_order", "global_execution_order")
        )
        jobs = g.participants(nodes, rels, self.flows, label="Job")
        self.job_steps = checkpointed(g.job_steps(nodes, rels, jobs))

    def labelled(self, label: str) -> DataFrame:
        return g.labelled(self.nodes, label)

    def call_name(self):
        return F.concat_ws("->", "caller", "callee").alias("key")


def duplicate_orders(r: RunGraph) -> DataFrame:
    """WIN-6, rule 24: members that share their execution order inside a flow."""
    placed = r.members.where("execution_order IS NOT NULL").select("flow_key", "key", "execution_order")
    shared = placed.groupBy("flow_key", "execution_order").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return placed.join(shared, ["flow_key", "execution_order"], "left_semi").select("key")


def unordered_calls(r: RunGraph) -> DataFrame:
    """WIN-7, rule 25: distinct CALLS whose order is missing or occurs again."""
    order = F.coalesce("global_execution_order", F.col("execution_order").cast("bigint"))
    valued = r.calls.select(r.call_name(), order.alias("v"))
    shared = valued.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return valued.where("v IS NULL").select("key").unionByName(valued.join(shared, "v", "left_semi").select("key")).distinct()


def misplaced_roots(r: RunGraph) -> DataFrame:
    """WIN-8, rule 26: members ordered before the first root of their flow; all roots of
    a flow whose roots have no order; the smallest member of a flow without a root."""
    placed = r.members.select("flow_key", "key", "execution_order").join(r.roots.withColumn("is_root", F.lit(True)), "key", "left")
    placed = placed.withColumn("is_root", F.coalesce("is_root", F.lit(False)))
    flow = placed.groupBy("flow_key").agg(
        F.bool_or("is_root").alias("rooted"), F.min(F.when(F.col("is_root"), F.col("execution_order"))).alias("first"), F.min("key").alias("smallest"))
    rule = F.expr("CASE WHEN NOT rooted THEN key = smallest WHEN first IS NULL THEN is_root ELSE NOT is_root AND execution_order < first END")
    return placed.join(flow, "flow_key").where(rule).select("key")


def rule_failures(r: RunGraph, items: set[int] | None = None) -> DataFrame:
    """QR-2..17: (item_id, key) of every failure, of all rules or of ``items``."""
    found: list[DataFrame] = []

    def wanted(item: int) -> bool:
        return items is None or item in items

    def add(numbers: tuple[int, ...], rows: Callable[[], DataFrame]) -> None:
        numbers = tuple(n for n in numbers if wanted(n))
        if numbers:
            found.append(rows().select(F.explode(F.array(*map(F.lit, numbers))).alias("item_id"), "key"))

    def keys_of(df: DataFrame, column: str) -> DataFrame:
        return df.where(F.col(column).isNotNull()).select(F.col(column).alias("key"))

    # Attribute rules share one pass over the nodes.
    is_snippet, blank = F.array_contains("labels", "Snippet"), fx.is_blank
    attribute_rules = {
        2: F.col("execution_order").isNull(), 4: blank("name"), 5: is_snippet & blank("short_summary"), 6: is_snippet & blank("business_summary"),
        7: is_snippet & blank("snippet"), 8: blank("topic"), 9: is_snippet & blank("function_name"),
        11: F.col("visual_imagery_data").isNull() & (is_snippet | F.array_contains("labels", "Step")),
    }
    checks = [F.when(cond, F.lit(item)) for item, cond in attribute_rules.items() if wanted(item)]
    if checks:
        found.append(r.nodes.select(F.explode(F.array_compact(F.array(*checks))).alias("item_id"), "key"))

    variables = keys_of(r.contained.where("rel_type = 'Contains_variable'"), "child_key").unionByName(keys_of(r.job_steps, "variable_key")).distinct()
    db_calls = keys_of(r.contained.where("rel_type = 'CONTAINS_DB_CALLS'"), "child_key").distinct()
    with_steps = keys_of(r.job_steps.where("step_key IS NOT NULL"), "job_key").distinct()

    add((1,), lambda: r.nodes.agg(F.count_if(is_snippet).alias("n")).where("n = 0").select(F.lit("Snippet").alias("key")))
    add((3,), lambda: r.nodes.join(r.roots, "key", "left_semi").where(blank("root_type")))
    add((10,), lambda: r.labelled("Variable").join(variables, "key", "left_semi").where(blank("meaning")))
    add((12,), lambda: r.labelled("DBCall").join(db_calls, "key", "left_semi").where("table_names IS NULL"))
    add((13, 27), lambda: gr.orphans(r.labelled("Snippet"), r.roots, r.calls))
    add((14,), lambda: r.calls.where("global_execution_order IS NULL AND execution_order IS NULL").select(r.call_name()))
    add((15,), lambda: r.labelled("Snippet").join(r.members.select("key"), "key", "left_anti"))
    add((16,), lambda: r.labelled("DBCall").join(db_calls, "key", "left_anti"))
    add((22,), lambda: keys_of(r.job_steps, "job_key").distinct().join(with_steps, "key", "left_anti"))
    add((23,), lambda: r.labelled("Variable").join(variables, "key", "left_anti"))
    add((24,), lambda: duplicate_orders(r))
    add((25,), lambda: unordered_calls(r))
    add((26,), lambda: misplaced_roots(r))
    add((28,), lambda: r.labelled("Snippet").select("key").join(gr.closure(r.roots, r.calls), "key", "left_anti"))
    add((29,), lambda: r.flows.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("ExecutionFlow").alias("key")))
    return reduce(DataFrame.unionByName, found)


def rule_table(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "item_id INT, title STRING, category STRING, priority STRING")


def checklist(failures: DataFrame) -> DataFrame:
    """QR-1: verdict and number of failures of every rule."""
    counted = failures.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    na = F.when(F.col("item_id").isin(NOT_VERIFIABLE), "N/A").otherwise("")
    return rule_table(failures.sparkSession).join(counted, "item_id", "left").select(
        "item_id", "title", "category", "priority", (n == 0).alias("passed"), n.alias("failures"), na.alias("note"))


def checklist_summary(items: DataFrame) -> DataFrame:
    """AGG-17: totals per category and, with a null category, overall."""
    failed = ~F.col("passed")
    return items.rollup("category").agg(
        F.count_if("passed").alias("passed"), F.count_if(failed).alias("failed"),
        F.count_if(failed & (F.col("priority") == "Critical")).alias("critical_failed"),
        F.count_if(failed & (F.col("priority") == "Required")).alias("required_failed"))


def label_usage(r: RunGraph) -> DataFrame:
    """QR-2: labels in use with their counts."""
    return r.nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))
