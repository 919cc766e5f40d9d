from wayfloor.streaming.replay import cleaned, event_windows, frame_voxels, keyframes, numbered, occupancy_counts, paired_poses, published, with_poses


def run(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_replay_equals_the_batch(spark, tmp_path):
    rows = [(f, i * 0.03, i * 0.02, 0.1 * (i % 12)) for f in range(3) for i in range(50)] + [(2, float("nan"), 0.0, 0.1)]
    df = spark.createDataFrame(rows, "frame long, x double, y double, z double")
    for f in range(3):
        df.where(f"frame = {f}").coalesce(1).write.mode("append").parquet(str(tmp_path / "k"))
    stream = keyframes(spark, str(tmp_path / "k"))
    run(frame_voxels(cleaned(stream)), "voxels", "complete")
    want = {tuple(r)[:5] for r in frame_voxels(cleaned(df)).collect()}
    assert {tuple(r)[:5] for r in spark.table("voxels").collect()} == want and want
    run(occupancy_counts(keyframes(spark, str(tmp_path / "k"))), "cells", "complete")
    assert sum(r.n for r in spark.table("cells").collect()) == len(rows)


def test_event_windows(spark):
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet("/root/testdata/sf0.001/events.parquet*")
    run(event_windows(stream), "windows", "complete")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert sum(r.n for r in spark.table("windows").collect()) == events.count()


def test_frames_pair_with_poses(spark):
    frames = spark.createDataFrame([(5,), (2,), (9,)], "frame long")
    poses = spark.createDataFrame([(2.0, 20.0), (1.0, 10.0)], "t double, tx double")
    assert {(r.frame, r.tx) for r in paired_poses(frames, poses).collect()} == {(2, 10.0), (5, 20.0)}


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).selectExpr("cast((id * 7919) % 1000 as double) AS t", "id")
    got = numbered(rows, "t", parts=8).collect()
    assert all(r.idx == r.t + 1 for r in got) and len(got) == 1000


def test_batches_are_published_once_with_their_poses(spark, tmp_path):
    df = spark.createDataFrame([(f, 0.1 * f, 0.0, 0.1) for f in range(3)], "frame long, x double, y double, z double")
    for f in range(3):
        df.where(f"frame = {f}").coalesce(1).write.mode("append").parquet(str(tmp_path / "k"))
    poses = spark.createDataFrame([(0, 5.0), (2, 7.0)], "frame long, tx double")
    stream = with_poses(keyframes(spark, str(tmp_path / "k")), poses)
    for _ in range(2):  # the second run finds nothing new
        published(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.frame, r.tx) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 5.0), (2, 7.0)]
