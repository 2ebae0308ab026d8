"""Scanning of source files: parse where a row is read, then keep the current state of each file over narrow results.

Contents are never shuffled to find the current state: every row is analysed where it was read, and only (file_id, mtime, result) moves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table

CODE = ("elixir", "erlang", "javascript", "python")
#: Paths of code files, and of all files that have a grammar.
CODE_PATH = r"(?i)\.(ex|exs|erl|js|py)$"
PARSED_PATH = r"(?i)\.(ex|exs|erl|js|py|json)$"


def analyse(files: DataFrame, fn: Callable[[str, str], object], result_type: str, path_pattern: str | None = CODE_PATH, keep: str = "") -> DataFrame:
    """(file_id, mtime, version, result[, keep...]) of every row, current or not; ``fn(path, content)`` must accept any text.

    ``keep`` names further columns of ``files`` with their types, for instance ``package string``.
    """
    kept = [c.split()[0] for c in keep.split(",") if c.strip()]
    if path_pattern:
        files = files.filter(F.col("path").rlike(path_pattern))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["file_id", "mtime", "version", *kept]].copy()
            out["result"] = pd.Series([fn(p, c) for p, c in zip(b["path"], b["content"])], index=b.index, dtype=object)
            yield out

    src = spread(files.select("file_id", "mtime", "path", "content", *[c for c in kept if c not in ("path", "content")]))
    src = src.withColumn("version", F.xxhash64("content", F.col("content").isNull()))
    return src.mapInPandas(run, f"file_id bigint, mtime bigint, version bigint, {keep + ', ' if keep else ''}result {result_type}")


def current(rows: DataFrame, *cols: str) -> DataFrame:
    """One row per file_id: the greatest mtime, of equal ones the greatest content hash.  A null mtime is below every other."""
    g = rows.groupBy("file_id").agg(F.max(F.struct("mtime", "version", *cols)).alias("_c"))
    return g.select("file_id", F.col("_c.mtime").alias("mtime"), *[F.col(f"_c.{c}").alias(c) for c in cols])


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_file")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)
