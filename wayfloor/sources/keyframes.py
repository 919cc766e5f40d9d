"""Key-frame clouds of a folder as a stream, in the order of the digits of their names, each with its pose.

An offset is the name of the last file taken, so a query that is started again
from its checkpoint takes up behind it and takes no frame twice.  A batch holds
all files that have come since; large files are read in ranges by many tasks.

Defined cases: the n-th file belongs to the n-th pose of the log, files without
a pose wait for one; names without digits come last, by name; a file that comes
after one of a greater number was taken is not read any more; a folder without
clouds has no rows.  Coordinates stay the sensor's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "frame long, file string, x double, y double, z double, tx double, ty double, tz double, qx double, qy double, qz double, qw double"


def digits_key(path: str) -> tuple[int, int, str]:
    """The order of key-frame files: the number that the digits of the name spell, then the name."""
    name = path.rsplit("/", 1)[-1]
    digits = "".join(c for c in name if c.isascii() and c.isdigit())
    return (0, int(digits), name) if digits else (1, 0, name)


def pose_lines(text: str) -> list[tuple[float, ...]]:
    """``(tx, ty, tz, qx, qy, qz, qw)`` of the lines of a pose log by time, with quaternions of length one."""
    rows = []
    for line in text.splitlines():
        words = line.split()
        if len(words) >= 8 and not words[0].startswith("#"):
            t, tx, ty, tz, *q = map(float, words[:8])
            size = math.sqrt(sum(v * v for v in q)) or 1.0
            rows.append((t, tx, ty, tz, *(v / size for v in q)))
    return [r[1:] for r in sorted(rows, key=lambda r: r[0])]


@dataclass
class Frame(InputPartition):
    """A range of the cloud of one frame."""

    frame: int
    path: str
    pose: tuple[float, ...]
    part: InputPartition


def _listed(folder: str) -> list[str]:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    root = folder.rstrip("/")
    found = store.get_file_info(fs.FileSelector(at.rstrip("/"), allow_not_found=True))
    names = [f.base_name for f in found if f.is_file and f.base_name.lower().endswith((".pcd", ".ply")) and not f.base_name.startswith(("_", "."))]
    return sorted((f"{root}/{n}" for n in names), key=digits_key)


def _text(path: str) -> str:
    from wayfloor.sources.clouds import _opened

    f, size = _opened(path)
    with f:
        return f.read(size).decode()


class KeyframeReader(DataSourceStreamReader):
    def __init__(self, folder: str, poses: str):
        self.folder, self.poses = folder, poses

    def _frames(self) -> list[tuple[int, str, tuple]]:
        return [(i, path, pose) for i, (path, pose) in enumerate(zip(_listed(self.folder), pose_lines(_text(self.poses))))]

    def initialOffset(self):
        return {"after": ""}

    def latestOffset(self):
        frames = self._frames()
        return {"after": frames[-1][1].rsplit("/", 1)[-1] if frames else ""}

    def partitions(self, start, end):
        from wayfloor.sources.clouds import CloudReader, read_header

        upto = lambda offset: digits_key(offset["after"]) if offset["after"] else (-1, 0, "")
        out = []
        for i, path, pose in self._frames():
            if upto(start) < digits_key(path) <= upto(end):
                out += [Frame(i, path, pose, part) for part in CloudReader(path, read_header(path)).partitions()]
        return out

    def read(self, partition):
        from wayfloor.sources.clouds import CloudReader, read_header

        for batch in CloudReader(partition.path, read_header(partition.path)).read(partition.part):
            by_lower = {n.lower(): i for i, n in enumerate(batch.schema.names)}
            n = batch.num_rows
            columns = [pa.array([partition.frame] * n, pa.int64()), pa.array([partition.path.rsplit("/", 1)[-1]] * n, pa.string())]
            columns += [batch.column(by_lower[c]).cast(pa.float64()) for c in "xyz"]
            columns += [pa.array([v] * n, pa.float64()) for v in partition.pose]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])

    def commit(self, end):
        """Nothing to release: the files stay."""


class KeyframeSource(DataSource):
    @classmethod
    def name(cls):
        return "keyframes"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return KeyframeReader(self.options["path"], self.options["poses"])


def keyframe_stream(spark: SparkSession, folder: str, poses: str) -> DataFrame:
    """``SCHEMA`` of the clouds of a folder as they come, with the poses of a log."""
    spark.dataSource.register(KeyframeSource)
    return spark.readStream.format("keyframes").option("poses", poses).load(folder)
