"""Source files that do not parse.

Each code or JSON file is lexed and its whole token stream is driven through the LALR(1) tables generated from the bundled grammar of the language
that the path's ending stands for; the first error the tables cannot recover from is reported.  Line ends, a byte-order mark and a missing last
newline do not matter; an empty code file is valid, an empty JSON file is not; a null content counts as empty; files of other endings give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .syntax import fault_of, language_of, normal
from .common import PARSED_PATH, analyse, current, ratio, source_files


def first_fault(path: str | None, content: str | None) -> tuple | None:
    """(language, message, line) of a file; message is null for a valid file."""
    lang = language_of(path)
    if lang is None:
        return None
    e = fault_of(lang, normal(content))
    return (lang, e.message, e.line) if e else (lang, None, None)


def parse_faults(files: DataFrame) -> DataFrame:
    """(file_id, package, language, message, line) of the current state of every file with a grammar."""
    rows = analyse(files, first_fault, "struct<language string, message string, line int>", PARSED_PATH, keep="package string")
    return current(rows, "package", "result").select("file_id", "package", "result.language", "result.message", "result.line")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return parse_faults(source_files(spark, folder)).filter(F.col("message").isNotNull()).select("file_id")


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Files, invalid files and their rate per package and language."""
    f = parse_faults(source_files(spark, folder))
    return f.groupBy("package", "language").agg(F.count("*").alias("files"), F.count("message").alias("invalid")).withColumn("rate", ratio(F.col("invalid"), F.col("files")))
