"""Structured Streaming: files into facts, updates of a fact store, and limited rates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def changed_files(spark: SparkSession, folder: str, schema, per_trigger: int = 1000) -> DataFrame:
    """Stream of a folder's Parquet files; the checkpoint of the query remembers which files were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def keep_current(stream: DataFrame, store: str, key: str, version: str, transform: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Keep a store with the transformed current state of each key.

    Each batch is merged into the store's next number: rows of the batch's keys are replaced where the batch is newer, all others are copied, and the
    batch's number names the result, so a batch that is repeated after a failure writes the same place again.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max(F.struct(version, *[c for c in batch.columns if c not in (key, version)])).alias("_r")).select(key, "_r.*")
        fresh = transform(newest)
        out = f"{store}/state-{number}"
        if number:
            old = spark.read.parquet(f"{store}/state-{number - 1}")
            both = old.unionByName(fresh, allowMissingColumns=True)
            fresh = both.groupBy(key).agg(F.max(F.struct(version, *[c for c in both.columns if c not in (key, version)])).alias("_r")).select(key, "_r.*")
        fresh.write.mode("overwrite").parquet(out)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts per kind and time window with a watermark for late rows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def token_bucket(stream: DataFrame, key: str, ts: str, per_minute: float, burst: int) -> DataFrame:
    """Rows with ``allowed``: a bucket per key that refills by time and holds ``burst`` tokens; state lives with the key."""

    def step(k, frames: Iterator[pd.DataFrame], state):
        tokens, last = state.get if state.exists else (float(burst), None)
        for f in frames:
            f = f.sort_values(ts)
            allowed = []
            for t in f[ts]:
                now = t.timestamp()
                tokens = min(float(burst), tokens + (0 if last is None else max(0.0, now - last)) * per_minute / 60)
                last = now if last is None else max(last, now)
                allowed.append(tokens >= 1)
                tokens -= allowed[-1]
            yield f.assign(allowed=allowed)
        state.update((tokens, last))

    out = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes) + ", allowed boolean"
    return stream.groupBy(key).applyInPandasWithState(step, out, "tokens double, last double", "append", "NoTimeout")
