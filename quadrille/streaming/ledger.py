"""Processing only new or changed records, run after run, and the differences of full snapshots.

Three stores below a shared folder, all with immutable numbered markers (``Marks``): what a run wrote counts from the moment its marker appears and not
before, so a run that dies anywhere leaves the last state whole and is redone with the same number.

* ``Ledger``: records with a transaction order.  A run rereads from the oldest transaction that was open at the last run and removes the overlap by an
  anti join of key-and-version pairs against the processed ones.
* ``ListingLedger``: sources that every run lists whole.  A listing is one transaction and is reread whole; the ledger of a run is what the last
  successful run of its source held.
* ``SnapshotIndex``: a bucketed index from key to hash of the last snapshot of each source, probed with new rows, and swapped.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from .history import neighbours


class Marks:
    """Markers 1, 2, ... below a folder, each a small JSON file that is written aside and renamed into place; never replaced once complete."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/_marks"

    def _path(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        p, fs = self._path(name)
        stream = fs.open(p)
        try:
            got = json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:  # cut off while it was written
            got = None
        finally:
            stream.close()
        return got if isinstance(got, dict) else None

    def last(self) -> tuple[int, dict]:
        """The greatest complete marker and its number; 0 and an empty state before the first."""
        p, fs = self._path()
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        for name in sorted((n for n in names if n.endswith(".json")), reverse=True):
            state = self._read(name)
            if state is not None:
                return int(name[:-5]), state
        return 0, {}

    def put(self, number: int, state: dict) -> None:
        name = f"{number:012d}.json"
        target, fs = self._path(name)
        aside, _ = self._path(f"aside-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(target):
            if self._read(name) is not None:
                fs.delete(aside, False)
                raise RuntimeError(f"run {number} was already committed by another writer")
            fs.delete(target, False)
        if not fs.rename(aside, target):
            raise RuntimeError(f"the marker of run {number} could not be put in place")


def same(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    """Null-safe equality of columns of both sides: a null is a value of its own."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])


@dataclass
class State:
    run: int = 0  # last run that succeeded
    low: str | None = None  # oldest transaction open at that run, as text
    parts: list = field(default_factory=list)  # folders of processed pairs with the greatest order in each


def _below(a: str, b: str) -> bool:
    """Whether an order given as text is below another: as numbers where both are, else as texts (times in ISO form)."""
    try:
        return float(a) < float(b)
    except ValueError:
        return a < b


class Ledger:
    """The processed pairs of key and version below ``folder``.

    A version of a record belongs to one transaction, so pairs older than every open transaction can never be read again and are left out of the
    anti join.  With ``redelivered`` a version may come again in a later transaction, and all pairs are kept.  Rows with a null order are always
    reread and their pairs always kept.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], version: list[str], order: str, redelivered: bool = False, compact_after: int = 32):
        self.spark, self.folder, self.keys, self.version, self.order = spark, folder.rstrip("/"), keys, version, order
        self.redelivered, self.compact_after, self.marks, self._taken = redelivered, compact_after, Marks(spark, folder), None

    def state(self) -> State:
        n, s = self.marks.last()
        return State(n, s.get("low"), s.get("parts", []))

    def _read(self, parts: list) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{p['name']}" for p in parts]).select(*self.keys, *self.version, self.order)

    def processed(self) -> DataFrame | None:
        parts = self.state().parts
        return self._read(parts) if parts else None

    def pending(self, source: DataFrame) -> DataFrame:
        """Rows of the source that no successful run has processed, each key and version once (the greatest other columns of equals)."""
        s = self.state()
        pairs = [*self.keys, *self.version]
        at_least = F.col(self.order).isNull() | (F.col(self.order) >= F.lit(s.low).cast(source.schema[self.order].dataType))
        if s.low is not None:
            source = source.filter(at_least)
        if s.parts:
            done = self._read(s.parts)
            if s.low is not None and not self.redelivered:
                done = done.filter(at_least)
            done = done.select(*pairs)
            source = source.join(done, same(source, done, pairs), "left_anti")
        rest = [c for c in source.columns if c not in pairs]
        if not rest:
            return source.distinct()
        return source.groupBy(*pairs).agg(F.max(F.struct(*rest)).alias("_r")).select(*pairs, "_r.*")

    def take(self, source: DataFrame) -> DataFrame:
        """The pending rows, written once: what is handed out is exactly what ``commit`` records, whatever arrives meanwhile."""
        name = f"batch-{self.state().run + 1}-{uuid.uuid4().hex}"
        self.pending(source).write.parquet(f"{self.folder}/{name}")
        self._taken = name
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def commit(self, low: str | None) -> int:
        """Record the batch taken and the oldest transaction still open; returns the run's number."""
        if self._taken is None:
            raise RuntimeError("nothing was taken")
        s = self.state()
        n = s.run + 1
        at = F.col(self.order)
        most, nulls = self.spark.read.parquet(f"{self.folder}/{self._taken}").agg(F.max(at).cast("string"), F.count_if(at.isNull())).first()
        parts = [*s.parts, {"name": self._taken, "max": most, "nulls": bool(nulls)}]
        if low is not None and not self.redelivered:
            parts = [p for p in parts if p["nulls"] or p["max"] is not None and not _below(p["max"], low)]
        if len(parts) > self.compact_after:
            merged = self._read(parts)
            if low is not None and not self.redelivered:
                merged = merged.filter(at.isNull() | (at >= F.lit(low).cast(merged.schema[self.order].dataType)))
            name = f"pairs-{n}-{uuid.uuid4().hex}"
            merged.distinct().write.parquet(f"{self.folder}/{name}")
            tops = [p["max"] for p in parts if p["max"] is not None]
            parts = [{"name": name, "max": reduce(lambda a, b: b if _below(a, b) else a, tops) if tops else None, "nulls": any(p["nulls"] for p in parts)}]
        self.marks.put(n, {"low": low, "parts": parts})
        self._taken = None
        return n


def oldest_open(transactions: DataFrame, started: str, finished: str, as_of: str) -> str | None:
    """Start of the oldest transaction that is not finished as of a time, else that time."""
    row = transactions.filter((F.col(started) <= F.lit(as_of)) & (F.col(finished).isNull() | (F.col(finished) > F.lit(as_of)))).agg(F.min(started).cast("string")).first()
    return row[0] or as_of


class ListingLedger:
    """What the last successful run of each source held, for sources that every run lists whole.

    ``take`` handles any number of runs of any number of sources in one plan: each run rereads its own listing, and an anti join removes the pairs of
    key and version that the last successful run before it held, which is a run of the same call or the one recorded.  Rows that came late belong to
    their listing and are found with it.  ``commit`` records the pairs of each source's last run.
    """

    HEAD = "source, run, listing, at"

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], version: list[str]):
        self.spark, self.folder, self.keys, self.version = spark, folder.rstrip("/"), keys, version
        self.marks, self._next = Marks(spark, folder), None

    def _stored(self, what: str) -> DataFrame | None:
        _, s = self.marks.last()
        return self.spark.read.parquet(f"{self.folder}/{s[what]}") if what in s else None

    def take(self, runs: DataFrame, listings: DataFrame, first: bool = True) -> DataFrame:
        """(run, key..., version...) that successful ``runs`` (source, run, listing, at), one row each, have to handle.

        ``listings`` has (listing, key..., version...); repeated rows count once.  Runs not after the recorded one of their source were handled
        before.  A run without any before it has to handle its whole listing, or nothing without ``first``.
        """
        pairs = [*self.keys, *self.version]
        heads, held = self._stored("heads"), self._stored("pairs")
        runs = runs.select("source", "run", "listing", "at")
        if heads is not None:
            h = heads.select(F.col("source").alias("_s"), F.struct("at", "run").alias("_head"), F.col("run").alias("_head_run"))
            runs = runs.join(h, F.col("source").eqNullSafe(F.col("_s")), "left").filter(F.col("_head").isNull() | (F.struct("at", "run") > F.col("_head"))).drop("_s", "_head")
        else:
            runs = runs.withColumn("_head_run", F.lit(None).cast(runs.schema["run"].dataType))
        linked = stored(neighbours(runs.withColumn("item", F.struct("at", "run", "listing")), "source", "at", "item", ["before"]), "runs")
        reread = listings.join(linked.filter(F.lit(first) | F.col("before").isNotNull() | F.col("_head_run").isNotNull()).select("listing", "run"), "listing").select("run", *pairs)
        done = listings.join(linked.filter("before is not null").select(F.col("before.listing").alias("listing"), "run"), "listing").select("run", *pairs)
        if held is not None:
            begin = linked.filter("before is null and _head_run is not null").select(F.col("source").alias("_s"), "run")
            done = done.unionByName(held.join(begin, F.col("source").eqNullSafe(F.col("_s"))).select("run", *pairs))
        name = uuid.uuid4().hex
        reread.join(done, same(reread, done, ["run", *pairs]), "left_anti").distinct().write.parquet(f"{self.folder}/batch-{name}")
        self._next = (name, linked.select("source", "run", "listing", "at"), listings)
        return self.spark.read.parquet(f"{self.folder}/batch-{name}")

    def commit(self) -> int:
        """Record the runs taken; returns the number of the commit."""
        if self._next is None:
            raise RuntimeError("nothing was taken")
        name, runs, listings = self._next
        n, _ = self.marks.last()
        heads, held = self._stored("heads"), self._stored("pairs")
        last = runs.groupBy("source").agg(F.max(F.struct("at", "run", "listing")).alias("h")).select("source", "h.run", "h.listing", "h.at")
        pairs = listings.join(last.select("source", "listing"), "listing").select("source", *self.keys, *self.version).distinct()
        if heads is not None:
            old, gone = heads.alias("o"), last.select(F.col("source").alias("_s"))
            keep = lambda df: df.join(gone, df["source"].eqNullSafe(gone["_s"]), "left_anti")
            last, pairs = last.unionByName(keep(old)), pairs.unionByName(keep(held))
        last.write.parquet(f"{self.folder}/heads-{name}")
        pairs.write.parquet(f"{self.folder}/pairs-{name}")
        self.marks.put(n + 1, {"heads": f"heads-{name}", "pairs": f"pairs-{name}", "batch": f"batch-{name}"})
        self._next = None
        return n + 1


def fingerprint(cols: list[str]) -> Column:
    """64-bit hash of a version; null differs from every value and keeps its place."""
    return F.xxhash64(*[F.col(c) for c in cols], *[F.col(c).isNull() for c in cols])


class SnapshotIndex:
    """Key-to-hash index of the last snapshot of each source, with the values beside it, in buckets of (source, key).

    ``stage`` writes the rows of new snapshots once, in the buckets of the index; this is the only shuffle of rows.  ``advance`` then goes through each
    key's rows inside its bucket, where every row of a snapshot probes the row of the snapshot before it.  ``fetch`` reads old and new values, for
    changes only.  ``swap`` makes the rows of each source's last snapshot the index.  Nulls in sources, keys and values are values of their own; of
    repeated keys in one snapshot the greatest hash counts.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, values: list[str], bytes_per_bucket: int = 64 << 20):
        self.spark, self.folder, self.key, self.values, self.bytes_per_bucket = spark, folder.rstrip("/"), key, values, bytes_per_bucket
        self.marks, self.held, self._next = Marks(spark, folder), None, None

    # --- bucketed files --------------------------------------------------------------------------------------------------------------------------

    def _open(self, name: str, buckets: int) -> DataFrame:
        """A bucketed folder as a table, so that its buckets spare a shuffle; registered in this session where it is not yet."""
        table = f"snapshot_{name}".replace("-", "_")
        if not self.spark.catalog.tableExists(table):
            path = f"{self.folder}/{name}"
            columns = ", ".join(f"`{c}` {t}" for c, t in self.spark.read.parquet(path).dtypes)
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (source, key) INTO {buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(table)

    def _write(self, df: DataFrame, name: str, buckets: int) -> DataFrame:
        table = f"snapshot_{name}".replace("-", "_")
        df.write.format("parquet").bucketBy(buckets, "source", "key").option("path", f"{self.folder}/{name}").saveAsTable(table)
        return self.spark.table(table)

    def buckets_for(self, df: DataFrame) -> int:
        """As many buckets as the index has, once there is one, else one for each ``bytes_per_bucket`` of the size that the planner sees in ``df``, at least one a core."""
        _, s = self.marks.last()
        if s:
            return s["buckets"]
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size >= 1 << 60:  # the planner does not know
            size = df.count() * 64
        return min(65_536, max(self.spark.sparkContext.defaultParallelism, -(-size // self.bytes_per_bucket)))

    def index(self) -> DataFrame | None:
        _, s = self.marks.last()
        return self._open(s["index"], s["buckets"]) if s else None

    # --- a call ----------------------------------------------------------------------------------------------------------------------------------

    def stage(self, rows: DataFrame, sized_by: DataFrame | None = None) -> DataFrame:
        """Write rows (source, snapshot, key, values...) in buckets, one row for each source, key and snapshot; returns them.

        ``sized_by`` is a scan whose size tells how many rows there are, where ``rows`` come from a join, which the planner overrates.
        """
        self.buckets = self.buckets_for(rows if sized_by is None else sized_by)
        hashed = rows.select("source", "snapshot", F.col(self.key).alias("key"), fingerprint(self.values).alias("h"), F.struct(*self.values).alias("v"))
        one = hashed.repartition(self.buckets, "source", "key").groupBy("source", "key", "snapshot").agg(F.max("h").alias("h"), F.max_by("v", "h").alias("v"))
        self.held = self._write(one, f"held-{uuid.uuid4().hex}", self.buckets)
        return self.held

    def counts(self) -> DataFrame:
        """(snapshot, keys) staged."""
        return self.held.groupBy("snapshot").agg(F.count("*").alias("keys"))

    def advance(self, snapshots: DataFrame, first: bool = True) -> DataFrame:
        """(snapshot, key, change, before, source) of the staged ``snapshots`` (source, snapshot, at), each against the one before it.

        change = added, removed or changed; ``before``: the snapshot that holds the old value.  Without ``first`` a source's first snapshot ever gives
        no rows.  Snapshots not after the index's one of their source are left out.
        """
        index = self.index()
        new = snapshots.select("source", "snapshot", "at", F.lit(False).alias("old"))
        if index is not None:
            h = self._heads().select(F.col("source").alias("_s"), F.struct("at", "snapshot").alias("_h"))
            new = new.join(h, F.col("source").eqNullSafe(F.col("_s")), "left").filter(F.col("_h").isNull() | (F.struct("at", "snapshot") > F.col("_h"))).drop("_s", "_h")
            new = new.unionByName(self._heads().select("source", "snapshot", "at", F.lit(True).alias("old")))
        # each snapshot with its neighbours: one small row each
        steps = stored(neighbours(new.withColumn("item", F.struct("at", "snapshot")), "source", "at", "item", ["before", "after"]), "snapshots")
        step = steps.select(F.col("snapshot").alias("_n"), F.col("source").alias("_o"), "old", "at", F.col("before.snapshot").alias("before"), F.col("after.snapshot").alias("after"))
        rows = self.held.select("source", "key", "snapshot", "h", F.lit(False).alias("_x"))
        if index is not None:
            rows = rows.unionByName(index.select("source", "key", "snapshot", "h", F.lit(True).alias("_x")))
        j = rows.join(step, (F.col("snapshot") == F.col("_n")) & F.col("source").eqNullSafe(F.col("_o")) & (F.col("old") == F.col("_x")))
        w = Window.partitionBy("source", "key").orderBy("at", "snapshot")
        j = j.select("source", "key", "snapshot", "h", "old", "before", "after", F.lag("snapshot").over(w).alias("lag"), F.lag("h").over(w).alias("lag_h"), F.lead("snapshot").over(w).alias("lead"))
        probed = F.col("lag").isNotNull() & (F.col("lag") == F.col("before"))
        here = F.when(F.col("old"), None).when(probed, F.when(F.col("lag_h") != F.col("h"), "changed")).when(F.lit(first) | F.col("before").isNotNull(), "added")
        gone = F.when(F.col("after").isNotNull() & (F.col("lead").isNull() | (F.col("lead") != F.col("after"))), "removed")
        both = F.array(F.struct("snapshot", here.alias("change"), "before"), F.struct(F.col("after").alias("snapshot"), gone.alias("change"), F.col("snapshot").alias("before")))
        self._next = steps
        return j.select("source", "key", F.explode(F.filter(both, lambda x: x["change"].isNotNull())).alias("c")).select("c.snapshot", F.col("key").alias(self.key), "c.change", "c.before", "source")

    def _values(self) -> DataFrame:
        index = self.index()
        cols = ["source", "key", "snapshot", "v"]
        return self.held.select(*cols) if index is None else self.held.select(*cols).unionByName(index.select(*cols))

    def fetch(self, changes: DataFrame) -> DataFrame:
        """The changes with ``old`` and ``new`` as structs of the values.  The changes are written once; where they are small they are broadcast, and no
        value of an unchanged key is moved."""
        v = self._values()
        c = stored(changes, "changes").withColumnRenamed(self.key, "_k")
        on = lambda at: v["source"].eqNullSafe(c["source"]) & v["key"].eqNullSafe(c["_k"]) & (v["snapshot"] == c[at])
        old = c.filter("change <> 'added'").join(v, on("before")).select("_k", c["snapshot"], c["source"], F.col("v").alias("old"), F.lit(None).cast(v.schema["v"].dataType).alias("new"))
        new = c.filter("change <> 'removed'").join(v, on("snapshot")).select("_k", c["snapshot"], c["source"], F.lit(None).cast(v.schema["v"].dataType).alias("old"), F.col("v").alias("new"))
        both = old.unionByName(new).groupBy("source", "snapshot", "_k").agg(F.max("old").alias("old"), F.max("new").alias("new"))
        change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
        return both.select("source", "snapshot", F.col("_k").alias(self.key), change.alias("change"), "old", "new")

    def _heads(self) -> DataFrame:
        _, s = self.marks.last()
        return self.spark.read.parquet(f"{self.folder}/{s['heads']}")

    def swap(self) -> int:
        """Make each source's last snapshot the index; sources without a new one keep theirs.  Returns the number of the index."""
        if self._next is None:
            raise RuntimeError("nothing was advanced")
        n, s = self.marks.last()
        name = uuid.uuid4().hex
        last = stored(self._next.groupBy("source").agg(F.max(F.struct("at", "snapshot", "old")).alias("h")).select("source", "h.*"), "heads")
        at = last.select(F.col("source").alias("_o"), F.col("snapshot").alias("_n"), "old")
        on = lambda x: F.col("source").eqNullSafe(F.col("_o")) & (F.col("snapshot") == F.col("_n")) & (F.col("old") == F.lit(x))
        rows = self.held.join(at, on(False), "left_semi")
        if s:
            rows = rows.unionByName(self.index().join(at, on(True), "left_semi"))
        last.drop("old").write.parquet(f"{self.folder}/heads-{name}")
        self._write(rows.select("source", "key", "snapshot", "h", "v"), f"index-{name}", self.buckets)
        self.marks.put(n + 1, {"index": f"index-{name}", "heads": f"heads-{name}", "buckets": self.buckets})
        self._next = None
        return n + 1

    def apply(self, snapshot: DataFrame) -> DataFrame:
        """(key, change, old, new) of one delivered snapshot of a single source against the index; ``swap`` then keeps it."""
        n, _ = self.marks.last()
        one = snapshot.select(F.lit(0).alias("source"), F.lit(n + 1).alias("snapshot"), self.key, *self.values)
        self.stage(one)
        at = self.spark.range(1).select(F.lit(0).alias("source"), F.lit(n + 1).alias("snapshot"), F.lit(n + 1).alias("at"))
        if not n:  # nothing to probe
            self._next = at.withColumn("old", F.lit(False))
            return self.held.select(F.col("key").alias(self.key), F.lit("added").alias("change"), F.lit(None).cast(self.held.schema["v"].dataType).alias("old"), F.col("v").alias("new"))
        return self.fetch(self.advance(at)).select(self.key, "change", "old", "new")
