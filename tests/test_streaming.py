from gaussframe.streaming.windows import windowed_moments

D = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark, tmp_path):
    events = spark.read.parquet(f"{D}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    batch = windowed_moments(events, "ts", "event_type", "value", "1 day")
    stream = windowed_moments(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "event_type", "value", "1 day", "1 hour")
    q = stream.writeStream.format("memory").queryName("moments").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("moments").collect())) == sorted(map(key, batch.collect()))
