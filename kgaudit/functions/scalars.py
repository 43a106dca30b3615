"""Column expressions for names, paths, chunk ids and ratios (FN-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def is_blank(c: Column | str) -> Column:
    return strip(text(c)) == ""


def norm_name(c: Column | str) -> Column:
    return F.upper(strip(text(c)))


def slashes(c: Column | str) -> Column:
    return F.translate(text(c), "\\", "/")


def base_name(c: Column | str) -> Column:
    """Last path part, case kept."""
    return F.substring_index(slashes(c), "/", -1)


def norm_file(c: Column | str) -> Column:
    """FN-1: a file is identified by its upper-cased name without folders."""
    return F.upper(strip(base_name(strip(c))))


def bare_name(c: Column | str) -> Column:
    """FN-2: upper-cased part after the last dot."""
    return strip(F.substring_index(norm_name(c), ".", -1))


def bare_name_cased(c: Column | str) -> Column:
    return strip(F.substring_index(strip(text(c)), ".", -1))


def chunk_id(path: Column | str, cls: Column | str, fn: Column | str) -> Column:
    """FN-4."""
    return F.concat_ws("::", text(path), text(cls), text(fn))


def _id_parts(c: Column | str) -> Column:
    return F.transform(F.split(text(c), "::"), strip)


def chunk_file(c: Column | str) -> Column:
    return F.get(_id_parts(c), F.lit(0))


def chunk_class(c: Column | str) -> Column:
    parts = _id_parts(c)
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise("")


def chunk_last(c: Column | str) -> Column:
    """Last non-empty part of a chunk id."""
    return text(F.try_element_at(F.filter(_id_parts(c), lambda p: p != ""), F.lit(-1)))


def chunk_function(c: Column | str) -> Column:
    """FN-3: last non-empty part, blank when it is only the file path."""
    last = chunk_last(c)
    looks_like_path = last.contains("/") | last.contains("\\")
    return F.when((last == chunk_file(c)) & looks_like_path, "").otherwise(last)


def chunk_function_strict(c: Column | str) -> Column:
    """Variant of FN-3 that blanks whenever function and file are equal."""
    last = chunk_last(c)
    return F.when(last == chunk_file(c), "").otherwise(last)


def file_stem(c: Column | str) -> Column:
    """FN-8: file name up to its last dot."""
    return F.regexp_replace(base_name(c), r"\.[^.]*$", "")


def path_stem(c: Column | str) -> Column:
    """File name without suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(base_name(c), r"(.)\.[^.]*$", "$1")


def parent_dir(c: Column | str) -> Column:
    path = slashes(c)
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(base_name(c), r".(\.[^.]*)$", 1))


def shared_lead(a: Column, b: Column) -> Column:
    """FN-8: number of equal leading parts of two '/'-split arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_diff = F.array_position(same, False)
    return F.when(first_diff == 0, F.least(F.size(a), F.size(b))).otherwise(first_diff - 1)


def display_name(function_name: Column | str, name: Column | str, key: Column | str) -> Column:
    """FN-12."""
    return F.coalesce(F.nullif(col(function_name), F.lit("")), F.nullif(col(name), F.lit("")), col(key))


def truncate(c: Column | str, size: int = 500, marker: str = "\n... (truncated)") -> Column:
    """FN-10: stripped text, cut with a marker when longer than ``size``."""
    body = strip(text(c))
    return F.when(F.length(body) > size, F.concat(F.substring(body, 1, size), F.lit(marker))).otherwise(body)


def pick_label(labels: Column | str, default: str | Column) -> Column:
    """FN-9: first label that is not generic."""
    fallback = F.lit(default) if isinstance(default, str) else default
    specific = F.filter(col(labels), lambda x: ~x.isin("Node", "Resource"))
    return F.coalesce(F.get(specific, F.lit(0)), fallback)


def short_chunk(c: Column | str) -> Column:
    """FN-13: 'function (file)' label of a chunk id."""
    parts = F.split(col(c), "::")
    file_part = F.substring_index(F.translate(F.get(parts, F.lit(0)), "\\", "/"), "/", -1)
    third, second = F.get(parts, F.lit(2)), F.get(parts, F.lit(1))
    name = F.coalesce(F.nullif(third, F.lit("")), F.nullif(second, F.lit("")), file_part)
    return (
        F.when(F.size(parts) >= 3, F.concat(name, F.lit(" ("), file_part, F.lit(")")))
        .when(F.size(parts) == 2, F.concat(second, F.lit(" ("), file_part, F.lit(")")))
        .otherwise(col(c))
    )


def lenient_bool(c: Column | str) -> Column:
    """FN-11."""
    return F.lower(strip(text(c))).isin("true", "yes", "1", "t", "y")


def safe_ratio(x: Column, n: Column) -> Column:
    """FN-15."""
    return x / F.greatest(n, F.lit(1))
