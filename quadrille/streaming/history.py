"""Neighbours in the histories of many sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of one slice of a history in units of its order: a week of seconds.
SLICE = 7 * 86_400


def neighbours(items: DataFrame, source: str, order: str, item: str, want: list[str], slice_width: int = SLICE) -> DataFrame:
    """``items`` with the item ``before`` and, or, ``after`` each (as ``want`` says) by ``order`` within its ``source``; null at the ends.

    One row per item is expected; ties of ``order`` are broken by ``item``; null orders come first.  A source with a third of all items is no single
    window: the history is cut into slices of ``slice_width``, neighbours are taken within them, and the ends of a slice take the last or first item
    of the next slice that holds any, found over one row per slice.
    """
    s = items.withColumn("_slice", F.floor(F.col(order) / F.lit(slice_width)))
    w = Window.partitionBy(source, "_slice").orderBy(F.col(order).asc_nulls_first(), F.col(item).asc_nulls_first())
    ends = s.groupBy(source, "_slice").agg(F.max(F.struct(F.col(order), F.col(item))).alias("_last"), F.min(F.struct(F.col(order), F.col(item))).alias("_first"))
    across = Window.partitionBy(source).orderBy(F.col("_slice").asc_nulls_first())
    steps = {"before": (F.lag, "_last"), "after": (F.lead, "_first")}
    carry = ends.select(F.col(source).alias("_src"), F.col("_slice").alias("_s"), *[steps[k][0](F.col(f"{steps[k][1]}.{item}")).over(across).alias(f"_carry_{k}") for k in want])
    inner = reduce(lambda d, k: d.withColumn(f"_own_{k}", steps[k][0](item).over(w)), want, s)
    joined = inner.join(carry, inner[source].eqNullSafe(carry["_src"]) & inner["_slice"].eqNullSafe(carry["_s"]), "left")
    for k in want:
        joined = joined.withColumn(k, F.coalesce(f"_own_{k}", f"_carry_{k}"))
    return joined.drop("_slice", "_src", "_s", *[f"_own_{k}" for k in want], *[f"_carry_{k}" for k in want])
