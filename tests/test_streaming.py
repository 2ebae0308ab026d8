from pyspark.sql import functions as F

from quadrille.streaming import jobs


def test_keep_current_store(spark, tmp_path):
    src, store, cp = str(tmp_path / "src"), str(tmp_path / "store"), str(tmp_path / "cp")
    schema = "k bigint, v bigint, t string"
    for rows in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (3, 1, None), (2, 0, "old")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.changed_files(spark, src, spark.createDataFrame([], schema).schema)
        jobs.keep_current(stream, store, "k", "v", lambda d: d.withColumn("u", F.upper("t")), cp).awaitTermination(60)
    last = max((tmp_path / "store").iterdir(), key=lambda p: int(p.name.split("-")[1]))
    assert {(r.k, r.v, r.u) for r in spark.read.parquet(str(last)).collect()} == {(1, 2, "C"), (2, 1, "B"), (3, 1, None)}


def test_token_bucket(spark, tmp_path):
    src = str(tmp_path / "ev")
    rows = [("a", f"2024-01-01 00:00:{s:02d}") for s in range(0, 6)] + [("a", "2024-01-01 00:01:30"), ("b", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "k string, at string").select("k", F.to_timestamp("at").alias("ts"))
    df.coalesce(1).write.parquet(src)
    out = jobs.token_bucket(spark.readStream.schema(df.schema).parquet(src), "k", "ts", per_minute=2, burst=3)
    q = out.writeStream.format("memory").queryName("bucket").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = spark.table("bucket").groupBy("k").agg(F.count_if("allowed").alias("y"), F.count("*").alias("n")).collect()
    assert {(r.k, r.y, r.n) for r in got} == {("a", 4, 7), ("b", 1, 1)}


def test_windows(spark, tmp_path):
    src = str(tmp_path / "w")
    df = spark.createDataFrame([("x", "2024-01-01 00:10:00"), ("x", "2024-01-01 00:50:00"), ("y", "2024-01-01 03:00:00")], "kind string, at string").select("kind", F.to_timestamp("at").alias("ts"))
    df.coalesce(1).write.parquet(src)
    q = jobs.windowed_counts(spark.readStream.schema(df.schema).parquet(src), "ts", "kind").writeStream.format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "cp")).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.kind, r.n) for r in spark.table("win").collect()} == {("x", 2), ("y", 1)}
