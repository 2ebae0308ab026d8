"""Problems 1 and 7 over the tables: the history of all runs through the ledger, and of all complete listings through the snapshot index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, table
from ..streaming.ledger import ListingLedger, SnapshotIndex


def clean_path(path: Column) -> Column:
    """Path without leading ``./`` and doubled slashes; null stays null."""
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"^(?:\./)+", "")


def completed_runs(log: DataFrame) -> DataFrame:
    """(source, run, listing, at) of the runs that have a ``completed`` row, one row each; a run without a listing is none."""
    done = log.filter(F.col("status") == "completed").groupBy(F.col("run_id").alias("run")).agg(F.max("checkout_id").alias("source"), F.max("snapshot_id").alias("listing"), F.max("state_ts").alias("at"))
    return done.filter(F.col("listing").isNotNull())


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, path) that each completed run has to handle; see TESTDATA.md.  The whole history goes through a fresh ledger and is committed."""
    log = table(spark, folder, "analysis_run").select("run_id", "checkout_id", "snapshot_id", "state_ts", "status")
    listings = table(spark, folder, "file_state").select(F.col("snapshot_id").alias("listing"), clean_path(F.col("path")).alias("path"), "mtime", "size")
    ledger = ListingLedger(spark, shared_folder(spark, "ledger"), ["path"], ["mtime", "size"])
    batch = ledger.take(completed_runs(log), listings, first=False)
    ledger.commit()
    return batch.select(F.col("run").alias("run_id"), "path").distinct()


def _advanced(spark: SparkSession, folder: str) -> tuple[SnapshotIndex, DataFrame]:
    """The index with all listings staged, and the changes between consecutive complete ones of each checkout."""
    log = table(spark, folder, "analysis_run").groupBy(F.col("snapshot_id").alias("snapshot")).agg(F.max("checkout_id").alias("source"), F.max("state_ts").alias("at"), F.max("file_count").alias("file_count"))
    rows = table(spark, folder, "file_state").select(F.col("snapshot_id").alias("snapshot"), clean_path(F.col("path")).alias("path"), "mtime", "size")
    index = SnapshotIndex(spark, shared_folder(spark, "index"), "path", ["mtime", "size"])
    index.stage(rows.join(log.select("snapshot", "source"), "snapshot"), sized_by=rows)
    # a listing without a row is complete if its run says so
    whole = log.join(index.counts(), "snapshot", "left").filter(F.coalesce("keys", F.lit(0)) == F.col("file_count"))
    return index, index.advance(whole.select("source", "snapshot", "at"), first=False)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """(snapshot_id, path, change) between consecutive complete listings of each checkout; see TESTDATA.md.  The last ones become the index."""
    index, changes = _advanced(spark, folder)
    index.swap()
    return changes.select(F.col("snapshot").alias("snapshot_id"), "path", "change")


def p7_values(spark: SparkSession, folder: str) -> DataFrame:
    """The changes with what was there before and after; the values are fetched for changed paths only."""
    index, changes = _advanced(spark, folder)
    out = index.fetch(changes)
    return out.select(F.col("snapshot").alias("snapshot_id"), "path", "change", F.col("old.mtime").alias("old_mtime"), F.col("old.size").alias("old_size"), F.col("new.mtime").alias("new_mtime"), F.col("new.size").alias("new_size"))


_CLEAN_SQL = r"regexp_replace(regexp_replace(path, '/+', '/', 'g'), '^(\./)+', '')"

ORACLE = {
    "p1_found": f"""
WITH done AS (SELECT DISTINCT run_id, checkout_id, snapshot_id, state_ts FROM analysis_run WHERE status = 'completed'),
pairs AS (SELECT run_id, snapshot_id, lag(snapshot_id) OVER (PARTITION BY checkout_id ORDER BY state_ts, run_id) AS prev FROM done),
l AS (SELECT DISTINCT snapshot_id, {_CLEAN_SQL} AS path, mtime, size FROM file_state)
SELECT DISTINCT p.run_id, a.path FROM pairs p JOIN l a ON a.snapshot_id = p.snapshot_id
WHERE p.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l b WHERE b.snapshot_id = p.prev AND b.path = a.path AND b.mtime IS NOT DISTINCT FROM a.mtime AND b.size IS NOT DISTINCT FROM a.size)""",
    "p7_found": f"""
WITH l AS (SELECT snapshot_id, {_CLEAN_SQL} AS path, max(mtime) AS mtime, max(size) AS size FROM file_state GROUP BY 1, 2),
n AS (SELECT snapshot_id, count(*) AS n FROM l GROUP BY 1),
r AS (SELECT DISTINCT snapshot_id, checkout_id, state_ts, file_count FROM analysis_run),
c AS (SELECT r.*, lag(r.snapshot_id) OVER (PARTITION BY checkout_id ORDER BY state_ts, r.snapshot_id) AS prev FROM r LEFT JOIN n USING (snapshot_id) WHERE coalesce(n.n, 0) = r.file_count),
new AS (SELECT c.snapshot_id, l.path, l.mtime, l.size FROM c JOIN l USING (snapshot_id) WHERE c.prev IS NOT NULL),
old AS (SELECT c.snapshot_id, l.path, l.mtime, l.size FROM c JOIN l ON l.snapshot_id = c.prev)
SELECT coalesce(new.snapshot_id, old.snapshot_id) AS snapshot_id, coalesce(new.path, old.path) AS path,
  CASE WHEN old.snapshot_id IS NULL THEN 'added' WHEN new.snapshot_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM new FULL JOIN old ON new.snapshot_id = old.snapshot_id AND new.path = old.path
WHERE old.snapshot_id IS NULL OR new.snapshot_id IS NULL OR new.mtime IS DISTINCT FROM old.mtime OR new.size IS DISTINCT FROM old.size""",
}

ORACLE["p7_values"] = ORACLE["p7_found"].replace("'changed' END AS change", "'changed' END AS change, old.mtime AS old_mtime, old.size AS old_size, new.mtime AS new_mtime, new.size AS new_size")

QUERIES = {"p1_found": p1_found, "p7_found": p7_found, "p7_values": p7_values}
