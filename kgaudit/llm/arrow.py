"""Row-wise Python steps over Arrow batches that keep the other columns as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def text_ranges(texts: list[str], chars: int = 1 << 20) -> Iterator[range]:
    """Ranges of texts of about ``chars`` characters together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield range(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


def map_texts(rows: DataFrame, start: Callable[[], Callable[[list[str]], list]], added: StructType) -> DataFrame:
    """``rows`` with their column ``text`` replaced by the columns ``added``.

    ``start`` runs once per task and returns a function from a list of texts to one list per
    added column. A batch is handed over in parts of about a million characters. Other columns
    never leave Arrow, so nulls and large integers stay what they are.
    """
    kept = [c for c in rows.columns if c != "text"]
    schema = StructType([rows.schema[c] for c in kept] + added.fields)
    types = [to_arrow_type(f.dataType) for f in added.fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = start()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in text_ranges(texts):
                own = batch.slice(part.start, len(part))
                columns = made(texts[part.start : part.stop])
                yield pa.RecordBatch.from_arrays(
                    [own.column(c) for c in kept] + [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names,
                )

    return rows.mapInArrow(run, schema)
