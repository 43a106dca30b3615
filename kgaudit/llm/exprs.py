"""Column expressions and small DataFrame steps that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def narrow(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text (null: empty) of ``table``, under fixed names.

    Whatever other columns the table has, they can't clash with those of an operator.
    """
    return table.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold(doc_id: Column, folds: int) -> Column:
    """Fold of a document: crc32 of its id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def unused(table: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``table`` has it."""
    taken = {c.lower() for c in table.columns}
    while name in taken:
        name += "_"
    return name
