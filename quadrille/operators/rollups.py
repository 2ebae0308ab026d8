"""Roll-ups, windows and joins over histories: developers, agents, blame, releases, versions, ownership, refactorings, batches."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import scalars as S
from ..session import stored
from ..streaming.history import neighbours


def developer_rollup(rows: DataFrame, person: str, ts: str, item: str, name: str | None = None) -> DataFrame:
    """Per person: latest name, names, first and last time, distinct items, in one aggregation with partial sums."""
    label = name or person
    return rows.groupBy(person).agg(
        F.max_by(label, F.struct(ts, item)).alias("latest"), F.array_sort(F.collect_set(label)).alias("names"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count_distinct(item).alias("items")
    )


def blame_rollup(lines: DataFrame, commit: str, author: str, ts: str, committed: Column | None = None) -> DataFrame:
    """One row: lines, distinct commits and authors, and the oldest and newest committed line's commit."""
    ok = committed if committed is not None else F.lit(True)
    when = F.when(ok, F.struct(ts, commit))
    return lines.agg(F.count("*").alias("lines"), F.count_distinct(commit).alias("commits"), F.count_distinct(author).alias("authors"), F.min(when)[commit].alias("oldest"), F.max(when)[commit].alias("newest"))


def blame_by(lines: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Per commit or author: lines, first and last time."""
    return lines.groupBy(*keys).agg(F.count("*").alias("lines"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def scope_totals(files: DataFrame, commit: str, path: str, added: str, deleted: str) -> DataFrame:
    """Per commit: files, added and deleted lines; a missing count, as binary files have it, is none."""
    return files.groupBy(commit).agg(F.count_distinct(path).alias("files"), F.coalesce(F.sum(added), F.lit(0)).alias("added"), F.coalesce(F.sum(deleted), F.lit(0)).alias("deleted"))


def _at(rows: DataFrame, order: str) -> Column:
    """The order as a number of seconds or as it is, for slicing."""
    kind = dict(rows.dtypes)[order]
    return F.unix_micros(F.col(order).cast("timestamp")) / 1e6 if kind.startswith("timestamp") or kind == "date" else F.col(order)


def dedup_consecutive(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before in their group; null differs from every value.  A hot group is cut into slices of its order."""
    item = F.struct(*order, F.col(value).alias("_v"))
    out = neighbours(rows.withColumn("_at", _at(rows, order[0])).withColumn("_item", item), group, "_at", "_item", ["before"])
    return out.filter(F.col("before").isNull() | ~F.col("before._v").eqNullSafe(F.col(value))).drop("_at", "_item", "before")


def release_chain(tags: DataFrame, project: str, version: str, compat: bool = False) -> DataFrame:
    """Releases newest first with the true predecessor; compat gives the newer neighbour instead."""
    w = Window.partitionBy(project).orderBy(S.semver_key(F.col(version)).desc())
    return tags.withColumn("position", F.row_number().over(w)).withColumn("previous", (F.lag if compat else F.lead)(version).over(w))


def derivations(versions: DataFrame, entity: str, order: list[str], content_hash: str, version: str) -> DataFrame:
    """(entity, version, derived_from) of consecutive versions and whether the content changed."""
    item = F.struct(*order, F.col(version).alias("_version"), F.col(content_hash).alias("_hash"))
    out = neighbours(versions.withColumn("_at", _at(versions, order[0])).withColumn("_item", item), entity, "_at", "_item", ["before"])
    return out.withColumn("derived_from", F.col("before._version")).withColumn("changed", ~F.col("before._hash").eqNullSafe(F.col(content_hash))).filter(F.col("derived_from").isNotNull()).drop("_at", "_item", "before")


def last_match_wins(paths: DataFrame, path: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Owner of each path by the last of an ordered list of (pattern, owner); null where none matches.  The list is code, not data: one CASE."""
    out = None
    for pattern, owner in reversed(rules):
        hit = F.rlike(path, F.lit(pattern))
        out = F.when(hit, owner) if out is None else out.when(hit, owner)
    return paths.withColumn("owner", out if out is not None else F.lit(None).cast("string"))


def enclosing(inner: DataFrame, outer: DataFrame, group: str, at: str, first: str, last: str, name: str, width: int) -> DataFrame:
    """Nearest enclosing interval of each position: intervals are cut into cells of ``width``, so the join is by group and cell."""
    o = outer.select(group, first, last, name, F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))).alias("_cell"))
    i = inner.withColumn("_cell", F.floor(F.col(at) / width))
    j = i.join(o, [group, "_cell"], "left").withColumn("_hit", F.when((F.col(at) >= F.col(first)) & (F.col(at) <= F.col(last)), F.struct(F.col(first), F.col(name))))
    return j.groupBy(*[c for c in inner.columns]).agg(F.max("_hit")[name].alias(name))


def failure_counts(results: DataFrame, status: str, kind: str) -> DataFrame:
    """Failures by type, with whether a retry may help."""
    return results.filter(F.col(status) == "failed").groupBy(F.coalesce(kind, F.lit("unknown")).alias("error_type")).agg(F.count("*").alias("n")).withColumn("retryable", F.col("error_type").isin("download_error", "timeout", "extraction_error"))


def progress_summary(results: DataFrame, status: str, millis: Column, total: int | Column) -> DataFrame:
    """One row: counts by status, whole-number mean duration, estimated rest and success rate (0 for an empty table)."""
    t = F.lit(total) if isinstance(total, int) else total
    g = results.agg(F.count_if(F.col(status) == "completed").alias("completed"), F.count_if(F.col(status) == "failed").alias("failed"), F.count("*").alias("processed"), F.coalesce(F.sum(millis), F.lit(0)).cast("bigint").alias("_ms"))
    mean = F.coalesce(F.expr("try_divide(_ms, processed)").cast("bigint"), F.lit(0))
    return g.withColumn("mean_ms", mean).withColumn("rest_ms", F.greatest(t - F.col("processed"), F.lit(0)) * F.col("mean_ms")).withColumn("success", F.coalesce(F.expr("try_divide(100.0D * completed, processed)"), F.lit(0.0))).drop("_ms")


def popularity_order(packages: DataFrame, recent: Column, total: Column, name: str) -> DataFrame:
    return packages.orderBy(recent.desc(), total.desc(), F.col(name).asc())


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to do: an anti join on the processed set."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def shingles(docs: DataFrame, key: str, text: str, width: int = 5) -> DataFrame:
    """(key, t) with 64-bit hashes of the runs of ``width`` words of each text; a shorter text is one run, one without words has a null."""
    words = docs.select(key, F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}_]+"), "").alias("_w"))
    run = lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(width)])  # noqa: E731  (a hash passes over the nulls after the last word)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - width, F.lit(0))), run)
    return words.select(key, F.when(F.size("_w") > 0, runs).alias("t"))


#: Bits of a token's place in the table of counts, of them the bits of its part; tokens whose places are held at once.
PLACE_BITS, PART_BITS, HELD = 26, 6, 8_000_000
#: Pairs of candidates whose keys are broadcast; with more, the sets are shuffled.
FEW = 500_000
#: Words of 64 bits in a set's parities: each bit is the parity of the number of its tokens at that place.
PARITIES = 8


def _places(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACE_BITS)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct tokens) of the rows that have tokens."""
    t = batch.column(1)
    at, flat = t.offsets.to_numpy(), t.values.to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(np.diff(at)):
        if t[i].is_valid:
            yield int(i), np.unique(flat[at[i]:at[i + 1]])


def _parities(h: np.ndarray) -> np.ndarray:
    """Two sets differ in at least as many tokens as there are bits in which their parities differ."""
    odd = np.bincount((_places(h) & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], schema: pa.Schema, min_size: int) -> Iterator[pa.RecordBatch]:
    """A row (k, n, class) for each set, and rows (part, places, counts) with the sets that hold a token, by place."""
    held, n_held = [], 0

    def flush() -> pa.RecordBatch:
        at, n = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(at, np.arange(1, 1 << PART_BITS) << (PLACE_BITS - PART_BITS))
        parts = [(i, a, c) for i, (a, c) in enumerate(zip(np.split(at, cuts), np.split(n, cuts))) if len(a)]
        low = (1 << (PLACE_BITS - PART_BITS)) - 1
        packed = lambda x: zlib.compress(x.astype("<u4").tobytes(), 1)
        return pa.record_batch([pa.nulls(len(parts), schema.types[0]), pa.nulls(len(parts), schema.types[1]), pa.nulls(len(parts), schema.types[2]), pa.array([i for i, _, _ in parts], pa.int32()), pa.array([packed(np.diff(a & low, prepend=0)) for _, a, _ in parts], pa.binary()), pa.array([packed(c) for _, _, c in parts], pa.binary())], schema=schema)

    for batch in batches:
        rows, sizes, ids = [], [], []
        for i, h in _sets(batch):
            if len(h) >= min_size:
                rows.append(i)
                sizes.append(len(h))
                ids.append(hashlib.sha256(h.tobytes()).digest())
                held.append(_places(h).astype(np.uint32))
                n_held += len(h)
        yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int32()), pa.array(ids, pa.binary()), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.binary())], schema=schema)
        if n_held > HELD:
            yield flush()
            held, n_held = [], 0
    if held:
        yield flush()


def _merged(rows: pa.Table, fold: int) -> pa.Table:
    """One part of the table of counts: each place as ten times the logarithm of its count, one byte."""
    total = np.zeros(1 << (PLACE_BITS - PART_BITS), np.int64)
    for at, n in zip(rows["at"].to_pylist(), rows["c"].to_pylist()):
        total[np.cumsum(np.frombuffer(zlib.decompress(at), "<u4").astype(np.int64))] += np.frombuffer(zlib.decompress(n), "<u4")
    total = total.reshape(-1, 1 << fold).sum(axis=1)
    level = np.minimum(np.rint(10 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)
    return pa.table({"part": rows["part"][:1], "level": pa.array([level.tobytes()], pa.binary())})


def _prefixes(batches: Iterator[pa.RecordBatch], levels, fold: int, threshold: float, min_size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(k, n, w, parities) of each set's rarest tokens; those that no other set has are left out, since they lead to no pair."""
    level = np.frombuffer(levels.value, np.uint8)
    for batch in batches:
        rows, sizes, tokens, odd = [], [], [], []
        for i, h in _sets(batch):
            n = len(h)
            if n < min_size:
                continue
            rare = level[_places(h) >> np.uint64(fold)]
            first = np.argsort(rare, kind="stable")[: n - math.ceil(n * threshold - 1e-9) + 1]
            w = h[first[rare[first] > 0]]
            rows.append(np.full(len(w), i))
            sizes.append(np.full(len(w), n, np.int32))
            tokens.append(w)
            odd.append(np.broadcast_to(_parities(h), (len(w), PARITIES)) if len(w) else np.empty((0, PARITIES), np.int64))
        if rows:
            bits = np.concatenate(odd)
            yield pa.record_batch([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(tokens)), *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(PARITIES)]], schema=schema)


def jaccard_links(docs: DataFrame, key: str, tokens: str | Callable[[DataFrame], DataFrame], threshold: float, min_size: int = 1) -> DataFrame:
    """(a, b, similarity) of sets with a Jaccard similarity of at least ``threshold``, a < b.

    Prefix filtering: tokens are ordered by rarity over all sets, and two similar sets share one of their first size - ceil(t * size) + 1 tokens,
    so only those are joined; sizes and parities that cannot reach the threshold are dropped before the exact check.  Any one order of all tokens finds every
    pair, so rarity is read off a table of counts by hash of at most 64 MB, and no token is shuffled for it: a place counted once is a token
    of one set.  Equal sets form a class first, and each class is compared once; its members are linked to the class's least key.  Null and
    empty sets have no links.  ``tokens`` is a column of ``docs``, or makes (key, t) of them in each of the three passes, in the last one of candidates only.
    """
    spark = docs.sparkSession
    made = lambda d: (d.select(key, F.col(tokens).alias("t")) if isinstance(tokens, str) else tokens(d)).select(F.col(key).alias("k"), "t")
    sets = made(docs)
    hashed = sets if sets.schema["t"].dataType.elementType == T.LongType() else sets.select("k", F.transform("t", lambda x: F.xxhash64(x)).alias("t"))
    kind = T.StructField("k", sets.schema["k"].dataType)
    form = T.StructType([kind, T.StructField("n", T.IntegerType()), T.StructField("id", T.BinaryType()), T.StructField("part", T.IntegerType()), T.StructField("at", T.BinaryType()), T.StructField("c", T.BinaryType())])
    arrow = to_arrow_schema(form)
    first = stored(hashed.mapInArrow(lambda b: _counted(b, arrow, min_size), form), "sets")
    known = first.filter("part is null").select("k", "n", "id")
    total = known.agg(F.sum("n")).first()[0] or 1
    bits = min(max(total.bit_length() + 1, PART_BITS + 4), PLACE_BITS)
    fold = PLACE_BITS - bits
    levels = bytearray(1 << bits)
    width = 1 << (bits - PART_BITS)
    for r in first.filter("part is not null").select("part", "at", "c").groupBy("part").applyInArrow(lambda x: _merged(x, fold), "part int, level binary").collect():
        levels[r.part * width:(r.part + 1) * width] = r.level
    table = spark.sparkContext.broadcast(bytes(levels))
    short = T.StructType([kind, T.StructField("n", T.IntegerType()), T.StructField("w", T.LongType()), *[T.StructField(f"p{i}", T.LongType()) for i in range(PARITIES)]])
    arrow_short = to_arrow_schema(short)
    same = known.join(known.groupBy("id").agg(F.min("k").alias("a")), "id").filter(F.col("k") > F.col("a")).select("a", F.col("k").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    prefix = hashed.mapInArrow(lambda b: _prefixes(b, table, fold, threshold, min_size, arrow_short), short).join(same.select(F.col("b").alias("k")), "k", "left_anti")
    a, b = prefix.alias("a"), prefix.alias("b")
    t = F.lit(threshold)
    fits = (F.col("a.n") >= F.col("b.n") * t - 1e-9) & (F.col("b.n") >= F.col("a.n") * t - 1e-9)
    differ = sum((F.bit_count(F.col(f"a.p{i}").bitwiseXOR(F.col(f"b.p{i}"))) for i in range(PARITIES)), F.lit(0))
    fits &= differ <= (F.col("a.n") + F.col("b.n")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    cand = stored(a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.k") < F.col("b.k")) & fits).select(F.col("a.k").alias("a"), F.col("b.k").alias("b")).distinct(), "candidates")
    keys = cand.select(F.col("a").alias(key)).union(cand.select(F.col("b").alias(key)))
    some = made(docs.join(F.broadcast(keys) if cand.count() <= FEW else keys, key, "left_semi")).select("k", F.array_distinct("t").alias("t"))
    x = cand.join(some.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(some.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
    x = x.select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).alias("c"))
    sim = F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))
    near = x.select("a", "b", sim.alias("similarity")).filter(F.col("similarity") >= threshold).distinct()
    return near.unionByName(same)
