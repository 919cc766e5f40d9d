import numpy as np
import pytest

from wayfloor.sources.clouds import label_column, read_cloud, read_header, write_pcd, xyz
from wayfloor.sources.maps import map_size, metadata_text, parse_pgm, read_metadata, read_pgm, read_poses, with_image, write_pgm


def pcd(tmp_path, data, body, extra=""):
    p = tmp_path / f"{data}.pcd"
    p.write_bytes(f"# comment\nVERSION 0.7\nFIELDS x y z label\nSIZE 4 4 4 1\nTYPE F F F U\n{extra}WIDTH 3\nHEIGHT 1\nDATA {data}\n".encode() + body)
    return str(p)


ROWS = [(1.0, 2.0, 3.5, 7), (0.25, -1.0, 0.0, 200), (4.0, 5.0, 6.0, 0)]
KIND = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("label", "u1")])


def test_pcd_binary_and_ascii(spark, tmp_path):
    for path in (pcd(tmp_path, "binary", np.array(ROWS, KIND).tobytes()), pcd(tmp_path, "ascii", b"\n".join(" ".join(map(str, r)).encode() for r in ROWS))):
        assert sorted(tuple(r) for r in read_cloud(spark, path).collect()) == sorted(ROWS)


def test_what_cannot_be_read_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        read_header(pcd(tmp_path, "binary_compressed", b""))
    with pytest.raises(ValueError):
        read_header(str(tmp_path / "cloud.xyz"))
    bad = tmp_path / "list.ply"
    bad.write_bytes(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int v\nend_header\n1 2\n")
    with pytest.raises(ValueError):
        read_header(str(bad))
    with pytest.raises(Exception):
        read_cloud(spark, pcd(tmp_path, "binary", np.array(ROWS[:2], KIND).tobytes())).count()


@pytest.mark.parametrize("form, order", [("binary_little_endian", "<"), ("binary_big_endian", ">"), ("ascii", None)])
def test_ply(spark, tmp_path, form, order):
    p = tmp_path / "a.ply"
    head = f"ply\nformat {form} 1.0\ncomment c\nelement vertex 3\nproperty float x\nproperty double y\nproperty int z\nproperty uchar class\nelement face 0\nproperty list uchar int i\nend_header\n"
    rows = [(1.5, 2.0, 3, 4), (0.5, -1.0, -7, 255), (0.0, 0.0, 0, 0)]
    body = np.array(rows, np.dtype([("x", f"{order}f4"), ("y", f"{order}f8"), ("z", f"{order}i4"), ("c", "u1")])).tobytes() if order else "\n".join(" ".join(map(str, r)) for r in rows).encode()
    p.write_bytes(head.encode() + body)
    df = read_cloud(spark, str(p))
    assert sorted(tuple(r) for r in df.collect()) == sorted(rows)
    assert xyz(df).columns == ["x", "y", "z", "label"]


def test_label_column():
    assert label_column(["x", "y", "z", "classification"]) == "classification"
    assert label_column(["x", "y", "z", "scalar_Foo"]) == "scalar_Foo"
    assert label_column(["x", "y", "z", "intensity", "my_class"]) == "my_class"
    assert label_column(["x", "y", "z", "nx", "ny", "nz", "extra"]) == "extra"
    assert label_column(["x", "y", "z"]) is None


def test_written_cloud_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(float(i), i / 2, -i / 4) for i in range(100)], "x double, y double, z double")
    path = str(tmp_path / "out.pcd")
    assert write_pcd(df, path) == 100
    assert sorted(tuple(r) for r in xyz(read_cloud(spark, path)).collect()) == sorted(tuple(r) for r in df.collect())


def test_images(spark, tmp_path):
    assert parse_pgm(b"P5\n# c\n2 2\n255\n\x00\xfe\xcd\x01") == (2, 2, [0, 254, 205, 1])
    assert parse_pgm(b"P2 2 1 15\n15 0\n") == (2, 1, [255, 0])
    assert parse_pgm(b"P5 1 1 65535\n\xff\xff") == (1, 1, [255])
    cells = spark.createDataFrame([(gy, gx, (gy * 3 + gx) % 256) for gy in range(4) for gx in range(3)], "gy long, gx long, pixel int")
    path = str(tmp_path / "m.pgm")
    write_pgm(cells, 3, 4, path)
    back = read_pgm(spark, path).select("gy", "gx", "pixel").collect()
    assert sorted(map(tuple, back)) == sorted(map(tuple, cells.collect()))
    assert [tuple(r)[1:] for r in map_size(spark, path).collect()] == [(3, 4)]


def test_metadata_and_poses(spark, tmp_path):
    y = tmp_path / "m.yaml"
    y.write_text(metadata_text("m.pgm", 0.1, (1.0, -2.5, 0.5)))
    r = read_metadata(spark, str(y)).first()
    assert (r.resolution, r.ox, r.oy, r.theta, r.free_thresh, r.negate) == (0.1, 1.0, -2.5, 0.5, 0.25, 0)
    (tmp_path / "e.yaml").write_text("image: x.pgm\n")
    r = read_metadata(spark, str(tmp_path / "e.yaml")).first()
    assert (r.resolution, r.ox, r.free_thresh) == (0.05, 0.0, 0.196)
    assert with_image("image: a\nx: 1\n", "b") == "image: b\nx: 1\n" and with_image("x: 1\n", "b") == "image: b\nx: 1\n"
    t = tmp_path / "p.txt"
    t.write_text("# c\n\n1 0 0 0 0 0 0 2\n2 1 1 1 0 3 0 4\nshort line\n")
    got = read_poses(spark, str(t)).collect()
    assert len(got) == 2 and got[0].qw == 1.0 and abs(got[1].qy - 0.6) < 1e-12


def test_text_bodies_are_read_in_ranges(spark, tmp_path, monkeypatch):
    """Every line once, wherever the ranges cut; a body with faces stays in one."""
    import pyarrow as pa

    from wayfloor.sources import clouds

    body = "".join(f"{i} {i * 0.5} -{i}\n" + ("\n" if i % 7 == 0 else "") for i in range(200))
    path = str(tmp_path / "a.pcd")
    head = "VERSION 0.7\nFIELDS x y z\nSIZE 8 8 8\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 200\nHEIGHT 1\nPOINTS 200\nDATA ascii\n"
    open(path, "w").write(head + body)
    for size in (5, 17, 64, 1 << 20):
        monkeypatch.setattr(clouds, "PARTITION_BYTES", size)
        reader = clouds.CloudReader(path, clouds.read_header(path))
        parts = reader.partitions()
        assert (len(parts) > 1) == (size < 1 << 20)
        rows = pa.Table.from_batches([b for p in parts for b in reader.read(p)]).to_pylist()
        assert [(r["x"], r["y"], r["z"]) for r in rows] == [(i, i * 0.5, -i) for i in range(200)]
    faces = str(tmp_path / "b.ply")
    open(faces, "w").write("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 1 1\n3 0 1 1\n")
    monkeypatch.setattr(clouds, "PARTITION_BYTES", 4)
    reader = clouds.CloudReader(faces, clouds.read_header(faces))
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [2]
    assert clouds.read_cloud(spark, "file://" + path).count() == 200
