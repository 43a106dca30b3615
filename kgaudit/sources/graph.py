"""Property-graph scans (SRC-1..19, SRC-34).

``nodes`` has typed core columns, ``labels array<string>`` and ``props map<string,string>``;
``rels`` has (src_key, rel_type, dst_key, execution_order, global_execution_order,
starts_flow). Lists of the graph database become rows: a snippet with millions of
children is then no larger a row than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgaudit.functions import scalars as fx
from kgaudit.session import first_per, paired

# Relation types of the child scans, with the type given to a child.
CHILD_RELATIONS = {
    "CONTAINS_DB_CALLS": "DBCall",
    "CONTAINS_CALCULATION": "Calculation",
    "CONTAINS_SERVICE_CALLS": "ServiceCall",
    "CONTAINS_INPUT": "InputEntity",
    "Contains_variable": "Variable",
}
CONTAINED_RELATIONS = [
    "CONTAINS_DB_CALLS", "CONTAINS_CALCULATION", "CONTAINS_SERVICE_CALLS", "CONTAINS_INPUT",
    "CONTAINS_MAP_FILE", "CONTAINS_DMN", "Contains_variable",
]


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def run_nodes(nodes: DataFrame, project_id: int, run_id: int) -> DataFrame:
    """SRC-1: nodes of one run with a key."""
    return nodes.where(
        (F.col("project_id") == project_id) & (F.col("run_id") == run_id) & (fx.text("key") != "")
    )


def labelled(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(F.array_contains("labels", label))


def label_nodes(nodes: DataFrame, label: str, project_id: int, run_id: int) -> DataFrame:
    """SRC-2: nodes of one label, nulls as empty strings."""
    cols = ["key", "name", "function_name", "class_name", "file_path", "file_name"]
    scoped = labelled(nodes, label).where((F.col("project_id") == project_id) & (F.col("run_id") == run_id))
    return scoped.select(F.lit(label).alias("label"), *[fx.text(c).alias(c) for c in cols])


def all_label_nodes(nodes: DataFrame, project_id: int, run_id: int) -> DataFrame:
    """SRC-2 for every label in one scan; a node counts once per label."""
    cols = ["key", "name", "function_name", "class_name", "file_path", "file_name"]
    scoped = nodes.where((F.col("project_id") == project_id) & (F.col("run_id") == run_id))
    return scoped.select(F.explode("labels").alias("label"), *[fx.text(c).alias(c) for c in cols])


def label_counts(nodes: DataFrame, project_id: int, run_id: int) -> DataFrame:
    """SRC-3."""
    scoped = nodes.where((F.col("project_id") == project_id) & (F.col("run_id") == run_id))
    return scoped.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))


def flow_by_key(nodes: DataFrame, key: str) -> DataFrame:
    """SRC-4: one flow; an unknown key is an error."""
    return require_rows(labelled(nodes, "ExecutionFlow").where(F.col("key") == key), f"no flow with key {key!r}")


def run_flows(nodes: DataFrame, project_id: int, run_id: int) -> DataFrame:
    """SRC-5: flows of a run ordered by name; none is an error."""
    flows = labelled(nodes, "ExecutionFlow").where(
        (F.col("project_id") == project_id) & (F.col("run_id") == run_id)
    )
    return require_rows(flows, f"no flows in project {project_id} run {run_id}").orderBy("name", "key")


def flow_keys(nodes: DataFrame, project_id: int, run_id: int) -> DataFrame:
    """Key, name and topic of the flows of a run; may be empty."""
    return labelled(nodes, "ExecutionFlow").where(
        (F.col("project_id") == project_id) & (F.col("run_id") == run_id)
    ).select(F.col("key").alias("flow_key"), fx.text("name").alias("flow_name"))


def participants(nodes: DataFrame, rels: DataFrame, flows: DataFrame, label: str = "Snippet", starts_flow_only: bool = False) -> DataFrame:
    """SRC-6: (flow_key, starts_flow, node columns) of the members of ``flows``."""
    member = rels.where(F.col("rel_type") == "PARTICIPATES_IN_FLOW")
    if starts_flow_only:
        member = member.where("starts_flow")
    member = member.select(
        F.col("src_key").alias("key"), F.col("dst_key").alias("flow_key"), F.coalesce("starts_flow", F.lit(False)).alias("starts_flow")
    ).join(flows.select("flow_key"), "flow_key", "left_semi")
    return member.join(labelled(nodes, label), "key")


def root_snippets(members: DataFrame) -> DataFrame:
    """SRC-7: per flow the entry of type ROOT, else the first entry point."""
    entries = members.where("starts_flow")
    is_root = F.when(F.col("type") == "ROOT", 0).otherwise(1)
    return first_per(entries, ["flow_key"], [is_root, F.col("key")])


def flow_calls(nodes: DataFrame, rels: DataFrame, members: DataFrame) -> DataFrame:
    """SRC-8, SRC-9: call sites of the members of every flow, one job for all flows.

    The callee may lie outside the flow but must be a snippet. ``seq`` is the list
    position key: the execution order, zero when missing.
    """
    calls = rels.where(F.col("rel_type") == "CALLS").select(
        F.col("src_key").alias("caller_key"), F.col("dst_key").alias("callee_key"), "execution_order"
    )
    callers = members.select("flow_key", F.col("key").alias("caller_key"))
    snippets = labelled(nodes, "Snippet").select(F.col("key").alias("callee_key"))
    return (
        calls.join(callers, "caller_key")
        .join(snippets, "callee_key", "left_semi")
        .select("flow_key", "caller_key", "callee_key", "execution_order", F.coalesce("execution_order", F.lit(0)).cast("bigint").alias("seq"))
    )


def flow_nodes(calls: DataFrame, members: DataFrame) -> DataFrame:
    """Node set of each flow: members and called snippets outside it."""
    return members.select("flow_key", "key").unionByName(
        calls.select("flow_key", F.col("callee_key").alias("key"))
    ).distinct()


def catalog_edges(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """SRC-10: call sites in the common edge shape, named by function, name or key."""
    ends = labelled(nodes, "Snippet").select(
        "key",
        fx.display_name("function_name", "name", "key").alias("fn"),
        fx.text("class_name").alias("cls"),
        fx.text("file_path").alias("file"),
    )
    caller = ends.withColumnsRenamed({"key": "caller_key", "fn": "caller", "cls": "caller_class", "file": "caller_file"})
    callee = ends.withColumnsRenamed({"key": "callee_key", "fn": "callee", "cls": "callee_class", "file": "callee_file"})
    return calls.join(caller, "caller_key").join(callee, "callee_key").select(
        "flow_key", "seq", "caller", "callee", "caller_file", "callee_file", "caller_class", "callee_class",
        F.lit("neo4j").alias("extraction_method"), F.lit(1.0).alias("confidence"), "execution_order",
    )


def project_call_edges(nodes: DataFrame, rels: DataFrame, project_id: int, run_id: int) -> DataFrame:
    """SRC-11, unkeyed: all CALLS of a run's snippets; rows without a name on either
    end have an empty ``caller`` or ``callee``."""
    def empty_to_null(c):
        return F.nullif(F.col(c), F.lit(""))

    snippets = labelled(nodes, "Snippet")
    ends = snippets.select(
        "key", "project_id", "run_id",
        F.coalesce(empty_to_null("function_name"), empty_to_null("name"), F.lit("")).alias("fn"),
        F.coalesce(empty_to_null("file_path"), empty_to_null("file_name"), F.lit("")).alias("file"),
        fx.text("class_name").alias("cls"),
    )
    scoped = ends.where((F.col("project_id") == project_id) & (F.col("run_id") == run_id))
    caller = scoped.select(F.col("key").alias("src_key"), F.col("fn").alias("caller"), F.col("file").alias("caller_file"), F.col("cls").alias("caller_class"))
    callee = ends.select(F.col("key").alias("dst_key"), F.col("fn").alias("callee"), F.col("file").alias("callee_file"), F.col("cls").alias("callee_class"))
    calls = rels.where(F.col("rel_type") == "CALLS").select("src_key", "dst_key")
    # Nodes grow with the graph and shrink well in a shuffle; merged, none are collected for a broadcast.
    return calls.join(caller.hint("merge"), "src_key").join(callee.hint("merge"), "dst_key")


def snippet_children(nodes: DataFrame, rels: DataFrame, members: DataFrame) -> DataFrame:
    """SRC-12: distinct (flow, parent, relation, child) of the five child relations."""
    kinds = F.expr(
        "CASE rel_type " + " ".join(f"WHEN '{r}' THEN '{t}'" for r, t in CHILD_RELATIONS.items()) + " END"
    )
    links = rels.select("src_key", "rel_type", "dst_key", kinds.alias("default_type")).where("default_type IS NOT NULL")
    parents = members.select("flow_key", F.col("key").alias("src_key")).distinct()
    children = nodes.select(F.col("key").alias("dst_key"), "labels")
    fits = F.when(
        F.col("rel_type") == "CONTAINS_INPUT",
        F.arrays_overlap("labels", F.array(F.lit("InputEntity"), F.lit("InputInterface"))),
    ).otherwise(F.array_contains("labels", F.col("default_type")))
    return (
        links.join(parents, "src_key")
        .join(children, "dst_key")
        .where(fits)
        .select("flow_key", F.col("src_key").alias("parent_key"), "rel_type", F.col("dst_key").alias("child_key"), fx.pick_label("labels", F.col("default_type")).alias("node_type"))
        .distinct()
    )


def job_steps(nodes: DataFrame, rels: DataFrame, jobs: DataFrame) -> DataFrame:
    """SRC-13: (flow, job, step or null, variable or null)."""
    def linked(rel: str, label: str, src: str, dst: str) -> DataFrame:
        target = labelled(nodes, label).select(F.col("key").alias("dst_key"))
        return rels.where(F.col("rel_type") == rel).join(target, "dst_key", "left_semi").select(
            F.col("src_key").alias(src), F.col("dst_key").alias(dst)
        ).distinct()

    return (
        jobs.select("flow_key", F.col("key").alias("job_key")).distinct()
        .join(linked("HAS_STEP", "Step", "job_key", "step_key"), "job_key", "left")
        .join(linked("Contains_variable", "Variable", "step_key", "variable_key"), "step_key", "left")
        .select("flow_key", "job_key", "step_key", "variable_key")
    )


def _hop(nodes: DataFrame, rels: DataFrame, rel_types: list[str], label: str, src: str, dst: str) -> DataFrame:
    """Distinct (src, dst) of some relations whose end has a label."""
    target = labelled(nodes, label).select(F.col("key").alias("dst_key"))
    return rels.where(F.col("rel_type").isin(rel_types)).join(target, "dst_key", "left_semi").select(
        F.col("src_key").alias(src), F.col("dst_key").alias(dst)
    ).distinct()


def entity_uses(nodes: DataFrame, rels: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct (flow, snippet, entity) behind the flow's DB calls."""
    return (
        members.select("flow_key", F.col("key").alias("snippet_key")).distinct()
        .join(_hop(nodes, rels, ["CONTAINS_DB_CALLS"], "DBCall", "snippet_key", "call_key"), "snippet_key")
        .join(_hop(nodes, rels, ["ACCESSES", "REFERENCES"], "DatabaseEntity", "call_key", "entity_key"), "call_key")
        .select("flow_key", "snippet_key", "entity_key").distinct()
    )


def fields_of_entities(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """Distinct (entity, field)."""
    return _hop(nodes, rels, ["HAS_FIELD"], "DatabaseField", "entity_key", "field_key")


def flow_entities(nodes: DataFrame, rels: DataFrame, members: DataFrame) -> DataFrame:
    """SRC-14: distinct (flow, snippet, entity, field or null) behind the flow's DB calls."""
    uses = entity_uses(nodes, rels, members).select("flow_key", "snippet_key", "entity_key")
    return paired(uses, fields_of_entities(nodes, rels), ["entity_key"], "left")


def topic_nodes(nodes: DataFrame, rels: DataFrame, project_id: int, run_id: int) -> DataFrame:
    """SRC-15: one row per node of the four sources; the first source wins per key."""
    flows = flow_keys(nodes, project_id, run_id)
    members = participants(nodes, rels, flows)
    jobs = participants(nodes, rels, flows, label="Job")
    null = F.lit(None).cast("string")

    snippets = members.select(
        F.lit(0).alias("priority"), "key", fx.pick_label("labels", "Snippet").alias("node_type"), null.alias("parent_key"), "flow_key"
    )
    children = snippet_children(nodes, rels, members).select(
        F.lit(1).alias("priority"), F.col("child_key").alias("key"), "node_type", "parent_key", "flow_key"
    )
    steps = job_steps(nodes, rels, jobs)
    from_jobs = (
        jobs.select(F.lit(2).alias("priority"), "key", F.lit("Job").alias("node_type"), null.alias("parent_key"), "flow_key")
        .unionByName(steps.where("step_key IS NOT NULL").select(
            F.lit(2).alias("priority"), F.col("step_key").alias("key"), F.lit("Step").alias("node_type"), F.col("job_key").alias("parent_key"), "flow_key"))
        .unionByName(steps.where("variable_key IS NOT NULL").select(
            F.lit(2).alias("priority"), F.col("variable_key").alias("key"), F.lit("Variable").alias("node_type"), F.col("job_key").alias("parent_key"), "flow_key"))
    )
    # A field takes the first flow of its entity, so snippets and fields of an entity never meet.
    uses = entity_uses(nodes, rels, members)
    first_flow = uses.groupBy("entity_key").agg(F.min("flow_key").alias("flow_key"))
    from_entities = uses.select(
        F.lit(3).alias("priority"), F.col("entity_key").alias("key"), F.lit("DatabaseEntity").alias("node_type"), F.col("snippet_key").alias("parent_key"), "flow_key"
    ).unionByName(first_flow.join(fields_of_entities(nodes, rels), "entity_key").select(
        F.lit(3).alias("priority"), F.col("field_key").alias("key"), F.lit("DatabaseField").alias("node_type"), F.col("entity_key").alias("parent_key"), "flow_key"))
    found = snippets.unionByName(children).unionByName(from_jobs).unionByName(from_entities)
    chosen = first_per(found, ["key"], [F.col("priority"), F.col("flow_key"), fx.text("parent_key"), F.col("node_type")])

    summary = F.coalesce(F.nullif("business_summary", F.lit("")), F.when(F.col("node_type") == "DatabaseEntity", F.col("description")), F.lit(""))
    text = nodes.select("key", "name", "topic", "business_summary", "description", "function_name")
    return (
        chosen.join(text, "key")
        .join(flows, "flow_key")
        .select(
            F.col("key").alias("node_key"), fx.text("name").alias("node_name"), "node_type",
            F.col("parent_key").alias("parent_snippet_key"), F.col("flow_key").alias("ef_key"),
            F.when(F.col("priority") == 3, "").otherwise(F.col("flow_name")).alias("ef_name"),
            "topic", summary.alias("business_summary"), fx.text("function_name").alias("function_name"),
        )
    )


def child_keys(nodes: DataFrame, contained: DataFrame) -> DataFrame:
    """Distinct keys of the nodes that fit one of the five child relations."""
    keys = contained.where(F.col("rel_type").isin(list(CHILD_RELATIONS))).select("rel_type", F.col("child_key").alias("key"))
    wanted = F.expr("CASE rel_type " + " ".join(f"WHEN '{r}' THEN '{t}'" for r, t in CHILD_RELATIONS.items() if r != "CONTAINS_INPUT") + " END")
    fits = keys.distinct().join(nodes.select("key", "labels"), "key").where(wanted.isNull() | F.array_contains("labels", wanted))
    return fits.select("key").distinct()


def child_nodes(nodes: DataFrame, rels: DataFrame, members: DataFrame) -> DataFrame:
    """SRC-16: distinct child nodes, which may lack a project, reached from members."""
    return nodes.join(child_keys(nodes, contained_keys(rels, members)), "key", "left_semi")


def contained_keys(rels: DataFrame, members: DataFrame) -> DataFrame:
    """SRC-17: distinct (snippet, relation, child) of the seven containment relations."""
    return (
        rels.where(F.col("rel_type").isin(CONTAINED_RELATIONS))
        .join(members.select(F.col("key").alias("src_key")).distinct(), "src_key", "left_semi")
        .select(F.col("src_key").alias("snippet_key"), "rel_type", F.col("dst_key").alias("child_key"))
        .distinct()
    )


def entity_fields(nodes: DataFrame, rels: DataFrame, project_id: int, run_id: int) -> DataFrame:
    """SRC-18: fields of the entities merged by name, first field of a name wins.

    An entity without fields keeps one row with a null field.
    """
    scoped = labelled(nodes, "DatabaseEntity").where((F.col("project_id") == project_id) & (F.col("run_id") == run_id))
    entities = scoped.select(
        F.col("key").alias("entity_key"), fx.text("name").alias("entity"),
        F.coalesce(F.nullif("schema_name", F.lit("")), F.nullif("schema_table", F.lit("")), F.lit("")).alias("schema_name"),
    )
    schema = first_per(entities, ["entity"], [F.col("entity_key")]).select("entity", "schema_name")
    links = rels.where(F.col("rel_type") == "HAS_FIELD").select(F.col("src_key").alias("entity_key"), F.col("dst_key").alias("field_key"))
    fields = labelled(nodes, "DatabaseField").select(
        F.col("key").alias("field_key"), fx.text("name").alias("field"), fx.text("data_type").alias("data_type"),
        F.coalesce(~F.array_contains("constraints", "NOT NULL"), F.lit(True)).alias("is_nullable"),
        F.coalesce(F.array_contains("constraints", "PRIMARY KEY"), F.lit(False)).alias("is_primary_key"),
    )
    linked = entities.drop("schema_name").join(links, "entity_key").join(fields, "field_key")
    firsts = first_per(linked, ["entity", "field"], [F.col("entity_key"), F.col("field_key")])
    return schema.join(firsts.drop("entity_key", "field_key"), "entity", "left")


def neighbourhood(nodes: DataFrame, rels: DataFrame, label: str) -> DataFrame:
    """SRC-19: outgoing and incoming relations of the nodes of a label."""
    centre = labelled(nodes, label).select(F.col("key").alias("node_key"))
    ends = nodes.select(F.col("key").alias("other_key"), F.get("labels", F.lit(0)).alias("other_label"), F.col("name").alias("other_name"))
    out = rels.select(F.col("src_key").alias("node_key"), F.lit("out").alias("direction"), "rel_type", F.col("dst_key").alias("other_key"))
    inc = rels.select(F.col("dst_key").alias("node_key"), F.lit("in").alias("direction"), "rel_type", F.col("src_key").alias("other_key"))
    return out.unionByName(inc).join(centre, "node_key", "left_semi").join(ends, "other_key")


def project_runs(nodes: DataFrame, project_id: int) -> DataFrame:
    """SRC-34: distinct runs of a project, ordered."""
    return nodes.where(F.col("project_id") == project_id).select("run_id").distinct().orderBy("run_id")


def property_keys(nodes: DataFrame) -> DataFrame:
    """SRC-34: property keys in use per label."""
    return nodes.select(F.explode("labels").alias("label"), F.map_keys("props").alias("ks")).select(
        "label", F.explode("ks").alias("property")
    ).distinct()
