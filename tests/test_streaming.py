import time

from tallyforge.streaming.jobs import first_of_each, limited_batch, limited_stream


def streamed(spark, df, path, name, build):
    """Three files, one after the other in time."""
    cuts = df.approxQuantile("at", [0.33, 0.66], 0)
    for low, high in zip([0, *cuts], [*cuts, 1e12]):
        df.where(f"at > {low} AND at <= {high}").drop("at").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema(df.drop("at").schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = build(stream).writeStream.outputMode("append").format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumnRenamed("event_type", "kind")


def with_seconds(df):
    return df.selectExpr("*", "CAST(unix_micros(CAST(ts AS timestamp)) / 1000000 AS double) AS at")


def test_limiter_on_a_stream_is_the_batch(spark, tmp_path):
    df = events(spark)
    got = streamed(spark, with_seconds(df), str(tmp_path / "in"), "limited", lambda s: limited_stream(s, "kind", 2, "24h"))
    want = limited_batch(df, "kind", 2, "24h").collect()
    assert sorted((r.event_id, r.allowed, r.used) for r in got) == sorted((r.event_id, r.allowed, r.used) for r in want)
    assert {r.allowed for r in want} == {True, False}


def test_repeated_jobs_on_a_stream(spark, tmp_path):
    df = events(spark).selectExpr("*", "event_id % 50 AS job_id")
    got = streamed(spark, with_seconds(df).withColumn("ts", df.ts.cast("timestamp")), str(tmp_path / "in"), "firsts", lambda s: first_of_each(s, "job_id", "ts", "400 days"))
    assert len(got) == len({r.job_id for r in got}) == first_of_each(df, "job_id", "ts").count() == 50


def test_limiter_edges(spark):
    df = spark.createDataFrame([(1, None, None)], "event_id long, kind string, ts timestamp_ntz")
    assert limited_batch(df, "kind", 1, "1h").collect() == []
