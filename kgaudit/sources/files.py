"""Source-tree scan (SRC-20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.functions import fixed
from kgaudit.functions import scalars as fx
from kgaudit.operators.profile import language_of


def is_source(path: Column | str, extensions: list[str]) -> Column:
    """Whether a path has a wanted extension and lies in no ignored folder."""
    folders = F.split(fx.parent_dir(path), "/")
    return fx.extension(path).isin([e.lower() for e in extensions]) & ~F.arrays_overlap(folders, F.array(*map(F.lit, fixed.IGNORED_FOLDERS)))


def scan_sources(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """SRC-20: (path, content, size, language) of every source file below ``root``.

    Files with other extensions are left out when the folders are listed. Those of ignored
    folders are left out after reading, before their bytes are decoded; bad UTF-8 is replaced.
    """
    wanted = extensions or list(fixed.EXTENSION_LANGUAGES)
    ends = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e.lstrip(".")) for e in wanted]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(ends) + "}").load(root)
    base = root.rstrip("/").removeprefix("file:")
    relative = F.regexp_replace("path", "^[a-z0-9]*:?/*" + "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in base.lstrip("/")) + "/", "")
    sources = found.withColumn("path", relative).where(is_source("path", wanted))
    return sources.select("path", F.col("content").cast("string").alias("content"), F.col("length").alias("size"), language_of("path").alias("language"))
