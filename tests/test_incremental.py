import pytest
from pyspark.sql import functions as F

from quadrille.operators import incremental as I
from quadrille.streaming.history import SLICE, neighbours
from quadrille.streaming.ledger import Ledger, ListingLedger, Marks, SnapshotIndex, oldest_open

LOG = "log_id bigint, run_id bigint, checkout_id bigint, package string, snapshot_id bigint, state_ts bigint, file_count bigint, status string, extra string"
FILES = "snapshot_id bigint, checkout_id bigint, path string, mtime bigint, size bigint"


def _tables(spark, tmp_path, log, files):
    spark.createDataFrame(log, LOG).write.mode("overwrite").parquet(f"{tmp_path}/analysis_run.parquet")
    spark.createDataFrame(files, FILES).write.mode("overwrite").parquet(f"{tmp_path}/file_state.parquet")
    return str(tmp_path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_runs_and_snapshots(spark, tmp_path):
    week = SLICE
    log = [(1, 1, 9, "p", 11, 5, 2, "running", None), (2, 1, 9, "p", 11, 5, 2, "completed", None), (2, 1, 9, "p", 11, 5, 2, "completed", None), (3, 2, 9, "p", 12, 6, 2, "failed", None), (4, 3, 9, "p", 13, 9 * week, 3, "completed", None), (5, 4, 8, "p", 14, 7, 1, "completed", None), (6, 5, 9, "p", 15, 9 * week + 1, 9, "completed", None)]
    files = [(11, 9, "a", 1, None), (11, 9, "./b", 1, 1), (12, 9, "a", 2, 1), (12, 9, "c", 1, 1), (13, 9, "a", 1, None), (13, 9, "lib//b", 1, 1), (13, 9, "b", None, 1), (13, 9, "b", None, 1), (14, 8, "a", 1, 1), (15, 9, "z", 1, 1)]
    d = _tables(spark, tmp_path, log, files)
    assert rows(I.p1_found(spark, d)) == [(3, "b"), (3, "lib/b"), (5, "z")]
    # 15 broke off, so 12 follows 11 and 13 follows 12
    assert rows(I.p7_found(spark, d)) == [(12, "a", "changed"), (12, "b", "removed"), (12, "c", "added"), (13, "a", "changed"), (13, "b", "added"), (13, "c", "removed"), (13, "lib/b", "added")]


def test_empty_tables(spark, tmp_path):
    d = _tables(spark, tmp_path, [], [])
    assert I.p1_found(spark, d).count() == 0 and I.p7_found(spark, d).count() == 0


def test_neighbours_equal_plain_ones(spark):
    data = [(s, t, (s or 0) * 1000 + t) for s in (1, 2, None) for t in list(range(0, 40, 3)) + [10**9, 10**9 + 5]]
    df = spark.createDataFrame(data, "src bigint, ts bigint, item bigint")
    got = {(r.src, r.item): (r.before, r.after) for r in neighbours(df, "src", "ts", "item", ["before", "after"], slice_width=7).collect()}
    for s in (1, 2, None):
        own = [None, *sorted(i for x, _, i in data if x == s), None]
        for a, b, c in zip(own, own[1:], own[2:]):
            assert got[(s, b)] == (a, c)


def test_two_runs_on_one_listing(spark, tmp_path):
    log = [(1, 1, 9, "p", 10, 5, 1, "completed", None), (2, 2, 9, "p", 20, 6, 1, "completed", None), (3, 3, 9, "p", 20, 7, 1, "completed", None), (4, 4, 9, "p", 30, 8, 1, "completed", None)]
    files = [(10, 9, "a", 1, 1), (20, 9, "a", 2, 1), (30, 9, "a", 2, None)]
    assert rows(I.p1_found(spark, _tables(spark, tmp_path, log, files))) == [(2, "a"), (4, "a")]


RUNS = "source bigint, run bigint, listing bigint, at bigint"
LISTED = "listing bigint, k string, v bigint"


def test_listing_ledger_goes_on_where_it_stopped(spark, tmp_path):
    listed = spark.createDataFrame([(1, "a", 1), (1, "b", None), (2, "a", 1), (2, "b", 3), (2, "b", 3), (3, "a", 1), (3, "b", None), (4, "x", 1), (5, None, None)], LISTED)
    led = ListingLedger(spark, str(tmp_path / "led"), ["k"], ["v"])
    take = lambda *r: rows(led.take(spark.createDataFrame(list(r), RUNS), listed))
    assert take((7, 1, 1, 10), (8, 4, 4, 1)) == [(1, "a", 1), (1, "b", None), (4, "x", 1)]
    # died before the commit: the same run is handed out again
    assert take((7, 1, 1, 10)) == [(1, "a", 1), (1, "b", None)]
    led.commit()
    again = ListingLedger(spark, str(tmp_path / "led"), ["k"], ["v"])
    led = again
    # a run handled before, two new ones in a row, and a source with nulls only
    assert take((7, 1, 1, 10), (7, 2, 2, 20), (7, 3, 3, 30), (9, 5, 5, 1)) == [(2, "b", 3), (3, "b", None), (5, None, None)]
    led.commit()
    assert take((7, 3, 3, 30)) == []
    assert Marks(spark, str(tmp_path / "led")).last()[0] == 2


def test_markers_survive_a_crash_at_each_step(spark, tmp_path):
    m = Marks(spark, str(tmp_path))
    assert m.last() == (0, {})
    m.put(1, {"a": 1})
    (tmp_path / "_marks" / "aside-x").write_text('{"a": 2}')  # written aside, never renamed
    (tmp_path / "_marks" / "000000000002.json").write_text('{"a": ')  # cut off
    assert m.last() == (1, {"a": 1})
    m.put(2, {"a": 3})
    assert m.last() == (2, {"a": 3})
    with pytest.raises(RuntimeError):
        m.put(2, {"a": 4})


def test_ledger_survives_failures(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "ledger"), ["k"], ["v"], "at")
    one = spark.createDataFrame([("a", 1, 10), ("b", None, 11), ("a", 1, 10)], "k string, v bigint, at bigint")
    assert rows(led.take(one).select("k", "v")) == [("a", 1), ("b", None)]  # a run that died before its marker
    led = Ledger(spark, str(tmp_path / "ledger"), ["k"], ["v"], "at")
    assert led.take(one).count() == 2
    led.commit("11")
    two = spark.createDataFrame([("a", 1, 10), ("b", None, 11), ("b", 2, 11), ("c", 1, 12), ("z", 1, 3)], "k string, v bigint, at bigint")
    assert rows(led.take(two).select("k", "v")) == [("b", 2), ("c", 1)]
    led.commit("12")
    assert led.take(two).count() == 0


def test_what_arrives_after_the_batch_is_left_for_the_next_run(spark, tmp_path):
    src = str(tmp_path / "src")
    put = lambda *r: spark.createDataFrame(list(r), "k string, v bigint, at bigint").write.mode("append").parquet(src)
    put(("a", 1, 10))
    led = Ledger(spark, str(tmp_path / "ledger"), ["k"], ["v"], "at")
    batch = led.take(spark.read.parquet(src))
    put(("b", 1, 11))
    led.commit("10")
    assert batch.count() == 1 and rows(led.take(spark.read.parquet(src)).select("k")) == [("b",)]


@pytest.mark.parametrize("redelivered", [False, True])
def test_ledger_is_compacted_and_pruned(spark, tmp_path, redelivered):
    led = Ledger(spark, str(tmp_path / "ledger"), ["k"], ["v"], "at", redelivered=redelivered, compact_after=2)
    src = [(f"k{i}", i, i) for i in range(5)] + [("n", None, None)]
    for i in range(1, 6):
        led.take(spark.createDataFrame(src[:i] + src[5:], "k string, v bigint, at bigint"))
        led.commit(str(i - 1))
    assert len(led.state().parts) <= 2
    held = {r.k for r in led.processed().collect()}
    assert {"k4", "n"} <= held and ("k1" in held) == redelivered  # k0 shares a part with a null order
    assert led.take(spark.createDataFrame(src, "k string, v bigint, at bigint")).count() == 0


def test_oldest_open(spark):
    t = spark.createDataFrame([("2024-01-01", "2024-01-02"), ("2024-01-03", None), ("2024-01-04", "2024-01-09")], "s string, f string")
    assert oldest_open(t, "s", "f", "2024-01-05") == "2024-01-03"
    assert oldest_open(t.filter("f is not null"), "s", "f", "2024-02-01") == "2024-02-01"


def test_snapshot_index(spark, tmp_path):
    ix = SnapshotIndex(spark, str(tmp_path / "ix"), "k", ["a", "b"])
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 2)], "k bigint, a string, b bigint")
    assert sorted(r.change for r in ix.apply(a).collect()) == ["added"] * 3
    ix.swap()
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "w", 2)], "k bigint, a string, b bigint")
    got = {r.k: (r.change, r.old and r.old.b, r.new and r.new.b) for r in ix.apply(b).collect()}
    assert got == {2: ("changed", 1, None), 3: ("removed", 2, None), 4: ("added", None, 2)}
    # died before the swap: the same snapshot is probed again, by another process that has no tables registered
    for t in spark.catalog.listTables():
        if t.name.startswith("snapshot_"):
            spark.sql(f"DROP TABLE {t.name}")
    ix = SnapshotIndex(spark, str(tmp_path / "ix"), "k", ["a", "b"])
    assert ix.apply(b).count() == 3
    ix.swap()
    assert ix.apply(b).count() == 0


def test_a_hundred_snapshots_at_once_equal_one_by_one(spark, tmp_path):
    import random

    rng = random.Random(5)
    shots = {n: {k: (rng.choice([None, 1, 2]), rng.choice([None, 1])) for k in rng.sample("abcdef", rng.randint(0, 6))} for n in range(1, 13)}
    data = [(s, n, k, *v) for s in (1, None) for n, d in shots.items() for k, v in d.items() for _ in range(2)]
    all_rows = spark.createDataFrame([(s, n + (100 if s is None else 0), k, x, y) for s, n, k, x, y in data], "source bigint, snapshot bigint, k string, x bigint, y bigint")
    at = [(s, n + (100 if s is None else 0), n) for s in (1, None) for n in shots]
    want = []
    for a, b in zip(range(1, 12), range(2, 13)):
        for k in shots[a].keys() | shots[b].keys():
            o, n = shots[a].get(k), shots[b].get(k)
            if o != n:
                want += [(b + plus, k, "added" if o is None else "removed" if n is None else "changed") for plus in (0, 100)]
    ix = SnapshotIndex(spark, str(tmp_path / "ix"), "k", ["x", "y"])
    got = []
    for part in (range(1, 6), range(6, 13)):  # in two calls, the second against the index of the first
        ix.stage(all_rows)
        snaps = spark.createDataFrame([x for x in at if x[2] in part], "source bigint, snapshot bigint, at bigint")
        c = ix.advance(snaps, first=False)
        got += rows(c.select("snapshot", "k", "change"))
        v = {(r.snapshot, r.k): (r.change, r.old and tuple(r.old), r.new and tuple(r.new)) for r in ix.fetch(c).collect()}
        for (n, k), (change, old, new) in v.items():
            m = n % 100
            assert (old, new) == (shots[m - 1].get(k), shots[m].get(k)) and (n, k, change) in got
        ix.swap()
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("path,clean", [("./a//b", "a/b"), (".//a", "a"), ("a/b", "a/b"), ("././x", "x"), (None, None), ("", "")])
def test_paths(spark, path, clean):
    assert spark.createDataFrame([(path,)], "p string").select(I.clean_path(F.col("p"))).first()[0] == clean
