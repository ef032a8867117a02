from sievemark.streaming import monitors


def drained(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def stream(spark, df, path):
    df.repartition(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_means_are_those_of_the_batch(spark, tmp_path):
    rows = spark.range(100).selectExpr("id % 3 as run", "cast(id / 10 as int) as epoch", "cast(id as double) as v")
    batch = [tuple(r) for r in monitors.epoch_means(rows, "run", "epoch", "v").collect()]
    assert sorted(drained(monitors.epoch_means(stream(spark, rows, str(tmp_path / "s")), "run", "epoch", "v"), "complete", "means")) == sorted(batch)


def test_items_are_new_once(spark, tmp_path):
    rows = spark.range(50).selectExpr("id % 7 as item", "timestamp '2024-01-01 00:00:00' as at")
    got = drained(monitors.new_items(stream(spark, rows, str(tmp_path / "s")), "item", "at"), "append", "items")
    assert sorted(x for x, _ in got) == list(range(7)) == sorted(r.item for r in monitors.new_items(rows, "item", "at").collect())


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = spark.range(120).selectExpr("0 as device", "timestamp_seconds(1700000000 + id * 60) as at", "cast(id as double) as v")
    batch = {r[1]: r for r in (tuple(x) for x in monitors.device_summary(rows, "device", "at", "v").collect())}
    got = drained(monitors.device_summary(stream(spark, rows, str(tmp_path / "s")), "device", "at", "v"), "append", "devices")
    assert got and all(batch[r[1]] == r for r in got) and len(got) < len(batch)


def test_warm_up_frames_are_left_out(spark, tmp_path):
    rows = spark.range(40).selectExpr("id % 2 as camera", "cast(id / 2 as long) as frame", "1.5 as latency_ms")
    got = drained(monitors.measured_frames(stream(spark, rows, str(tmp_path / "s")), 5), "append", "frames")
    assert sorted((c, f) for c, f, _ in got) == [(c, f) for c in (0, 1) for f in range(5, 20)]


def test_batch_and_gate_leave_the_warm_up_out(spark):
    rows = spark.range(40).selectExpr("id % 2 as camera", "cast(id / 2 as long) as frame", "if(id % 8 = 7, null, 1.5) as latency_ms").union(spark.sql("select 9L, 1L, 2.0D"))
    got = [(r.camera, r.frame) for r in monitors.frames_behind_warmup(rows, 5).collect()]
    assert sorted(got) == [(c, f) for c in (0, 1) for f in range(5, 20)] and monitors.frames_behind_warmup(rows, 0).count() == 41
    gates = {r.camera: (r.frames, r.measured, r.status) for r in monitors.collection_gate(rows, 5, 12).collect()}
    assert gates == {0: (20, 15, "PASS"), 1: (20, 11, "FAIL"), 9: (1, 0, "FAIL")}
    assert monitors.collection_gate(rows.where("false"), 5, 1).count() == 0
