from pyspark.sql import functions as F

from tessella.streaming import pyramids


def run(spark, tmp_path, df, build, name):
    df.write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = build(stream)
    q = out.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
    q.awaitTermination()
    return spark.table(name)


def events(spark):
    return spark.range(500).select((F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 3).cast("string").alias("k"))


def test_closed_windows_equal_batch(spark, tmp_path):
    df = events(spark)
    got = {(r.z, r.start): (r.n, r["sum"]) for r in run(spark, tmp_path, df, lambda s: pyramids.pyramid(s, "ts", "v", 600, 2, "10 minutes"), "p").collect()}
    rows = df.select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "v").collect()
    for (z, start), (n, total) in got.items():
        w = 600 << (2 - z)
        a = int(start.timestamp()) if start.tzinfo else int((start - __import__("datetime").datetime(1970, 1, 1)).total_seconds())
        own = [r.v for r in rows if a <= r.t < a + w]
        assert (n, total) == (len(own), sum(own))
    assert {z for z, _ in got} == {0, 1, 2}


def test_stateful_tiler_emits_each_closed_bin_once(spark, tmp_path):
    df = events(spark)
    out = run(spark, tmp_path, df, lambda s: pyramids.closed_tiles(s, "ts", "v", "k", 3600, "1 hour"), "t").collect()
    assert len({(r.k, r.start) for r in out}) == len(out)
    rows = df.select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "v", "k").collect()
    for r in out:
        own = [x.v for x in rows if x.k == r.k and r.start <= x.t < r.start + 3600]
        assert (r.n, r["sum"]) == (len(own), sum(own))


def fed(spark, tmp_path, batches, build, name):
    """Rows of a stream that reads one file a batch, in order."""
    import time

    (tmp_path / name).mkdir()
    schema = "ts timestamp_ntz, v double, k string"
    for i, rows in enumerate(batches):
        text = "\n".join('{"ts": "2024-01-01T%02d:%02d:00", "v": %s, "k": "%s"}' % (h, m, v, k) for h, m, v, k in rows)
        (tmp_path / name / f"{i}.json").write_text(text)
        time.sleep(0.02)
    out = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/{name}"))
    q = out.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}_state").start()
    q.awaitTermination()
    return spark.table(name).collect()


#: The key's own rows run an hour ahead; the last row of the second batch is late, but within two hours.
LATE = [[(1, 10, 1.0, "a"), (2, 10, 1.0, "a")], [(3, 10, 1.0, "a"), (2, 20, 5.0, "a"), (1, 50, 7.0, "b")], [(9, 0, 1.0, "c")], [(9, 5, 1.0, "c")]]


def test_rows_within_the_delay_are_counted(spark, tmp_path):
    got = {(r.k, r.start // 3600 % 24): (r.n, r["sum"]) for r in fed(spark, tmp_path, LATE, lambda s: pyramids.closed_tiles(s, "ts", "v", "k", 3600, "2 hours"), "late_tiles")}
    assert got == {("a", 1): (1, 1.0), ("a", 2): (2, 6.0), ("a", 3): (1, 1.0), ("b", 1): (1, 7.0)}
    level = {(r.k, r.start.hour): (r.n, r["sum"]) for r in fed(spark, tmp_path, LATE, lambda s: pyramids.level(s, "ts", "v", "1 hour", "2 hours", ("k",)), "late_level")}
    assert level == got


def test_fine_levels_close_before_coarse_ones(spark, tmp_path):
    got = {(r.z, r.start.hour): r.n for r in fed(spark, tmp_path, LATE[:2] + [[(7, 30, 1.0, "a")]], lambda s: pyramids.pyramid(s, "ts", "v", 3600, 2, "1 hour"), "levels")}
    # the watermark is 06:30: hours up to 5 have ended, the pair from 6 and the four from 4 have not
    assert got == {(2, 1): 2, (2, 2): 2, (2, 3): 1, (1, 0): 2, (1, 2): 3, (0, 0): 5}


def test_running_counts_of_a_stream(spark, tmp_path):
    df = events(spark)
    df.write.parquet(f"{tmp_path}/in")
    out = pyramids.running_counts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "k")
    out.writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/rs").start().awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("running").collect()) == [("0", 167), ("1", 167), ("2", 166)]


def test_sessions_equal_gaps(spark, tmp_path):
    rows = [[(1, 0, 1.0, "a"), (1, 20, 1.0, "a"), (2, 0, 1.0, "a"), (1, 5, 2.0, "b")], [(9, 0, 1.0, "c")], [(9, 1, 1.0, "c")]]
    got = sorted((r.k, r.start.hour, r.start.minute, r.n) for r in fed(spark, tmp_path, rows, lambda s: pyramids.sessions(s, "ts", "v", "30 minutes", "10 minutes", ("k",)), "sess"))
    assert got == [("a", 1, 0, 2), ("a", 2, 0, 1), ("b", 1, 5, 1)]


def test_sessions_and_counts(spark, tmp_path):
    df = events(spark)
    assert run(spark, tmp_path, df, lambda s: pyramids.sliding(s, "ts", "v", "2 hours", "1 hour", "1 hour", ("k",)), "s").count() > 0
    assert {r.n for r in pyramids.running_counts(df, "k").collect()} == {167, 166}


def test_micro_batch_writer(spark, tmp_path):
    df = events(spark)
    df.write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = pyramids.write_batches(stream, lambda b, k: b.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/state")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 500
