"""Topic duplicates, similarity, rules and issue roll-up (SIM-1..4, JOIN-14, QR-21..25, AGG-10, AGG-23, FIL-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx
from kgaudit.operators.text_joins import edit_pairs

# Thresholds and word lists.
SIMILARITY_THRESHOLD = 0.85
ALIGNMENT_THRESHOLD = 0.7
JOURNEY_CONFIDENCE = 0.6
GLUE_WORDS = [
    "submit", "data", "record", "update", "process", "handle", "execute", "run", "call", "invoke", "fetch",
    "load", "save", "store", "get", "set", "push", "pull", "send", "receive", "trigger",
]
APPROVED_VERBS = [
    "validate", "verify", "calculate", "authorize", "check", "adjust", "notify", "generate", "approve", "reject",
    "route", "classify", "determine", "evaluate", "assess", "retrieve", "identify", "confirm", "allocate",
    "assign", "resolve", "initiate", "complete", "cancel", "suspend", "transfer", "reconcile", "aggregate",
    "transform", "enrich", "publish", "archive", "audit", "monitor", "schedule", "dispatch", "escalate", "review",
    "certify", "register", "deactivate", "activate", "merge", "split", "encode", "decode", "authenticate",
    "renew", "close", "open", "create", "delete", "apply", "compute", "derive", "map", "filter", "sort", "format",
    "parse", "convert", "extract", "inspect", "detect", "flag",
]


def with_topic_key(nodes: DataFrame) -> DataFrame:
    """Nodes that have a topic, with its trimmed lower-case form."""
    return nodes.where(fx.text("topic") != "").withColumn("topic_key", F.lower(fx.strip("topic")))


def topic_sizes(nodes: DataFrame) -> DataFrame:
    return with_topic_key(nodes).groupBy("topic_key").agg(F.count(F.lit(1)).alias("size"))


def duplicate_members(nodes: DataFrame) -> DataFrame:
    """SIM-1: (topic_key, size, node_key) of every node that shares its topic."""
    groups = topic_sizes(nodes).where("size > 1")
    return with_topic_key(nodes).select("topic_key", "node_key").join(groups, "topic_key")


def edit_ratio(a: Column, b: Column) -> Column:
    """UDF-3: 1 - Levenshtein distance / longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def similar_topics(nodes: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """SIM-2, JOIN-14: pairs of different topics whose edit ratio is at least ``threshold``."""
    pairs = edit_pairs(topic_sizes(nodes).select(F.col("topic_key").alias("t")), threshold)
    return pairs.select(F.col("a").alias("topic_a"), F.col("b").alias("topic_b"), "ratio")


def topic_groups(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """SIM-3 per topic: its last group, where similar pairs follow duplicate groups.

    All nodes of a topic share their groups, so they are found per topic and a topic
    held by millions of nodes is one row.
    """
    ends = pairs.select(F.explode(F.array("topic_a", "topic_b")).alias("topic_key"), F.struct("topic_a", "topic_b").alias("pair"))
    last = ends.groupBy("topic_key").agg(F.max("pair").alias("pair"))
    sizes = topic_sizes(nodes).join(last, "topic_key", "left").where("size > 1 OR pair IS NOT NULL")
    is_pair = F.col("pair").isNotNull()
    name = F.when(is_pair, F.concat(F.lit("sim_"), F.md5(F.concat_ws("\n", "pair.topic_a", "pair.topic_b")))).otherwise(F.concat(F.lit("dup_"), F.md5("topic_key")))
    return sizes.select("topic_key", F.when(is_pair, "similar").otherwise("duplicate").alias("kind"), name.alias("group_id"))


def node_groups(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """SIM-3: group of every node that has one."""
    return with_topic_key(nodes).select("node_key", "topic_key").join(groups, "topic_key").select("node_key", "kind", "group_id")


def suggestion_similarity(current: Column, suggested: Column) -> Column:
    """SIM-4: edit ratio of current and suggested topic in hundredths, halves up; null without a suggestion."""
    a, b = F.lower(current), F.lower(suggested)
    longer = F.greatest(F.length(a), F.length(b), F.lit(1))
    hundredths = F.floor((200 * (longer - F.levenshtein(a, b)) + longer) / (2 * longer))
    return F.when(suggested != "", hundredths / 100)


def topic_words(topic: Column | str) -> Column:
    return F.split(F.lower(fx.strip(fx.text(topic))), r"\s+")


def has_glue_word(topic: Column | str) -> Column:
    return F.arrays_overlap(topic_words(topic), F.array(*map(F.lit, GLUE_WORDS)))


def breaks_verb_rule(topic: Column | str) -> Column:
    return ~F.get(topic_words(topic), F.lit(0)).isin(APPROVED_VERBS)


def rule_issues(topic: Column | str) -> Column:
    """QR-21: missing topic, or glue word and unapproved first word."""
    blank = fx.is_blank(topic)
    return F.array_compact(F.array(
        F.when(blank, F.lit("topic_missing")), F.when(~blank & has_glue_word(topic), F.lit("technical_glue")),
        F.when(~blank & breaks_verb_rule(topic), F.lit("verb_noun"))))


def analyze_topics(nodes: DataFrame, groups: DataFrame, scores: DataFrame, suggestions: DataFrame) -> DataFrame:
    """QR-21..25: issues, details and suggestion of every node.

    ``scores`` (node_key, alignment_score, explanation, suggested_topic, rationale,
    confidence) and ``suggestions`` (node_key, suggested) are external tables with at
    most one row per node; both may be empty.
    """
    s = scores.select("node_key", "alignment_score", "explanation", F.col("suggested_topic").alias("_sug"), F.col("rationale").alias("_why"), F.col("confidence").alias("_conf"))
    j = suggestions.select("node_key", F.col("suggested").alias("_journey"))
    joined = nodes.join(node_groups(nodes, groups), "node_key", "left").join(s, "node_key", "left").join(j, "node_key", "left")
    topic, nothing = fx.text("topic"), F.lit(None).cast("string")
    both_missing = (topic == "") & (fx.text("business_summary") == "")
    score = F.when(both_missing, F.lit(0.0)).otherwise(F.col("alignment_score"))
    journey = (topic != "") & (fx.text("_journey") != "") & (F.lower("_journey") != F.lower("topic"))
    early = F.concat(
        rule_issues("topic"),
        F.array_compact(F.array(
            F.when(F.col("kind") == "duplicate", F.lit("duplicate")).when(F.col("kind") == "similar", F.lit("similar")).otherwise(nothing),
            F.when(journey, F.lit("journey_break")))))
    base = joined.withColumns({"_early": early, "_score": score})
    needs = (F.size("_early") > 0) | ((topic != "") & (fx.text("business_summary") != ""))
    low = needs & (F.coalesce("_score", F.lit(1.0)) < ALIGNMENT_THRESHOLD)
    base = base.withColumn("issues", F.concat("_early", F.when(low, F.array(F.lit("misaligned"))).otherwise(F.array().cast("array<string>"))))
    explained = F.concat(F.lit("Alignment="), F.format_string("%.2f", F.col("_score")), F.lit(": "), F.when(both_missing, "Both topic and business_summary missing").otherwise(fx.text("explanation")))

    def detail(issue: str, message: Column) -> Column:
        return F.when(F.array_contains("issues", issue), message)

    details = F.array_compact(F.array(
        detail("topic_missing", F.lit("topic is missing")),
        detail("duplicate", F.concat(F.lit("exact duplicate in group "), F.col("group_id"))),
        detail("similar", F.concat(F.lit("similar topic in group "), F.col("group_id"))),
        detail("verb_noun", F.lit("first word is not an approved verb")),
        detail("technical_glue", F.lit("contains a technical glue word")),
        detail("misaligned", explained),
        detail("journey_break", F.lit("differs from the journey suggestion"))))
    own = needs & (fx.text("_sug") != "")
    from_journey = ~own & (fx.text("_journey") != "")
    return base.select(
        "node_key", "node_type", "ef_key", fx.text("topic").alias("topic"), "issues", F.array_join(details, "; ").alias("details"), needs.alias("needs_review"),
        F.when(own, F.col("_sug")).when(from_journey, F.col("_journey")).otherwise("").alias("suggested_topic"),
        F.when(own, F.col("_why")).when(from_journey, "Suggested by journey chain analysis").otherwise("").alias("rationale"),
        F.when(own, F.col("_conf")).when(from_journey, JOURNEY_CONFIDENCE).otherwise(0.0).alias("confidence"), fx.text("group_id").alias("group_id"))


def issue_breakdown(analysis: DataFrame) -> DataFrame:
    """AGG-10: nodes per issue."""
    return analysis.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("nodes"))


def topic_summary(analysis: DataFrame) -> DataFrame:
    """AGG-10: nodes, nodes with issues and missing topics per node type and overall."""
    return analysis.rollup("node_type").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.size("issues") > 0).alias("with_issues"),
        F.count_if(F.array_contains("issues", "topic_missing")).alias("missing"))


def filter_analysis(analysis: DataFrame, node_type: str | None = None, issue: str | None = None) -> DataFrame:
    """FIL-11."""
    out = analysis
    if node_type:
        out = out.where(F.col("node_type") == node_type)
    if issue:
        out = out.where(F.array_contains("issues", issue))
    return out
