from tracefold.streaming import points


def test_stream_keeps_what_the_batch_keeps(spark, tmp_path):
    """Points in two files, read one a batch; the state carries over."""
    schema = "traj_id string, t double, lat double, lon double"
    rows = [("a", 0.0, 39.9, 116.3), ("a", 10.0, 39.9001, 116.3), ("a", 20.0, 40.5, 116.3), ("b", 5.0, 39.8, 116.2)]
    more = [("a", 30.0, 39.9002, 116.3), ("a", 25.0, 39.9001, 116.3), ("a", 8.0, 39.9, 116.3), ("b", 6.0, 41.0, 116.2)]
    for k, part in enumerate((rows, more)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = points.drop_fast(stream).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    for k in range(2):
        file, = (tmp_path / f"in{k}").glob("*.parquet")
        file.rename(source / f"part{k}.parquet")
        query.processAllAvailable()
    query.stop()
    assert sorted((r.traj_id, r.t) for r in spark.table("kept").collect()) == [("a", 0.0), ("a", 10.0), ("a", 25.0), ("a", 30.0), ("b", 5.0)]
