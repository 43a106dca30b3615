"""Index a code base: files to chunks, function index and call edges, as stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgaudit.functions.profiles import DEFAULT_PROFILES, Profile
from kgaudit.operators import calls, chunking
from kgaudit.sources import tables


def index_code(files: DataFrame, out: str, profiles: dict[str, Profile] = DEFAULT_PROFILES) -> dict[str, DataFrame]:
    """Write ``chunks``, ``code_index`` and ``call_edges`` below ``out`` and return them.

    ``files`` has (path, content, language); form files are those of extension .dfm.
    File texts are parsed once; everything after reads the chunk table.
    """
    spark = files.sparkSession
    is_form = F.lower("path").like("%.dfm")
    forms = chunking.chunk_forms(files.where(is_form))
    found = chunking.chunk_definitions(files.where(~is_form), profiles)
    shared = ["chunk_id", "path", "language", "function_name", "class_name", "line_start", "line_end", "content"]
    none = F.array().cast("array<string>")
    every = found.select(*shared, none.alias("event_handlers")).unionByName(forms.select(*shared, "event_handlers"))
    tables.replace_table(chunking.keep_first_chunks(every), f"{out}/chunks")
    chunks = tables.read_table(spark, f"{out}/chunks")

    definitions = chunks.select("function_name", "class_name", F.col("path").alias("file_path"), "language", F.col("line_start").cast("bigint").alias("seq"))
    tables.replace_table(tables.build_code_index(definitions), f"{out}/code_index")

    form_chunks = chunks.where("size(event_handlers) > 0 OR lower(path) LIKE '%.dfm'")
    places = chunks.select("chunk_id", "path", "function_name", F.col("line_start").cast("bigint").alias("seq"))
    known = calls.known_names(chunks, form_chunks)
    extracted = calls.expand_sites(calls.extract_calls(chunks, known, profiles), chunks).drop("site")
    edges = calls.call_graph(extracted, places).unionByName(calls.handler_edges(form_chunks, places))
    tables.replace_table(edges, f"{out}/call_edges")
    return {n: tables.read_table(spark, f"{out}/{n}") for n in ("chunks", "code_index", "call_edges")}
