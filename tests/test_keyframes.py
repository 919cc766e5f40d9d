"""Key frames as a stream: order, poses, and a start from a checkpoint."""

import math

import numpy as np

from wayfloor.sources.keyframes import digits_key, keyframe_stream, pose_lines


def cloud(path, frame, n=3):
    rows = np.array([(frame, i, 0.5) for i in range(n)], "<f4")
    head = f"VERSION 0.7\nFIELDS X y z\nSIZE 4 4 4\nTYPE F F F\nWIDTH {n}\nHEIGHT 1\nPOINTS {n}\nDATA binary\n"
    path.write_bytes(head.encode() + rows.tobytes())


def taken(spark, tmp_path):
    stream = keyframe_stream(spark, str(tmp_path / "frames"), str(tmp_path / "poses.txt"))
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()


def test_order_and_poses():
    assert sorted(["b.pcd", "k_10.pcd", "9.pcd", "a.pcd", "007.pcd"], key=digits_key) == ["007.pcd", "9.pcd", "k_10.pcd", "a.pcd", "b.pcd"]
    assert pose_lines("# t\n\n2 1 0 0 0 0 0 2\n1 5 6 7 0 0 3 4 extra\nshort\n") == [(5.0, 6.0, 7.0, 0.0, 0.0, 0.6, 0.8), (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)]


def test_no_frame_twice_over_restarts(spark, tmp_path):
    (tmp_path / "frames").mkdir()
    poses = lambda n: (tmp_path / "poses.txt").write_text("".join(f"{i} {i * 10} 0 0 0 0 0 1\n" for i in range(n)))
    poses(4)
    assert taken(spark, tmp_path) == []
    cloud(tmp_path / "frames" / "10.pcd", 10)
    cloud(tmp_path / "frames" / "kf_2.pcd", 2)
    (tmp_path / "frames" / "notes.txt").write_text("no cloud")
    rows = taken(spark, tmp_path)
    assert {(r.frame, r.file, r.tx) for r in rows} == {(0, "kf_2.pcd", 0.0), (1, "10.pcd", 10.0)} and len(rows) == 6
    assert {r.x for r in rows if r.frame == 1} == {10.0}
    assert len(taken(spark, tmp_path)) == 6  # nothing new
    for k in (11, 12, 13):
        cloud(tmp_path / "frames" / f"{k}.pcd", k)
    rows = taken(spark, tmp_path)  # the fifth has no pose yet
    assert sorted({(r.frame, r.file, r.tx) for r in rows}) == [(0, "kf_2.pcd", 0.0), (1, "10.pcd", 10.0), (2, "11.pcd", 20.0), (3, "12.pcd", 30.0)] and len(rows) == 12
    poses(9)
    rows = taken(spark, tmp_path)
    assert len(rows) == 15 and {r.tx for r in rows if r.file == "13.pcd"} == {40.0}
    assert all(math.isclose(r.qx**2 + r.qy**2 + r.qz**2 + r.qw**2, 1) for r in rows)
