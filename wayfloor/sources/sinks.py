"""Clouds and maps written by many tasks: every task writes files of its own, and they appear together.

A cloud becomes a folder of binary PCD files, each whole in itself; a map a
folder of P5 images, each a band of rows, with a note of its size.  Tasks write
under a name of the job; when all are done the files are renamed into place, and
a job that fails leaves nothing.  A task holds one file's rows at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: PCD type and size, and the array type, of a column.
PCD_COLUMNS = {"double": ("F", 8, "<f8"), "float": ("F", 4, "<f4"), "bigint": ("I", 8, "<i8"), "int": ("I", 4, "<i4"), "smallint": ("I", 2, "<i2"), "tinyint": ("I", 1, "<i1")}
#: Points of a file, rows of a band, and the pixel of a cell that is not given.
FILE_POINTS, BAND_ROWS, UNKNOWN = 1 << 21, 512, 205
SIZE_NOTE = "map_size.json"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class PartWriter(DataSourceArrowWriter):
    """Writes files under a hidden folder of the job; ``files`` yields (name, content) of a task's batches."""

    def __init__(self, folder: str, overwrite: bool, ending: str):
        self.folder, self.overwrite, self.ending, self.job = folder.rstrip("/"), overwrite, ending, uuid.uuid4().hex

    def files(self, batches, part: str):
        raise NotImplementedError

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        store, folder = _store(self.folder)
        store.create_dir(f"{folder}/_job-{self.job}", recursive=True)
        names = []
        # A task that is tried again, or twice at once, writes under another name.
        for name, content in self.files(iterator, f"{context.partitionId():06d}-{uuid.uuid4().hex[:8]}"):
            with store.open_output_stream(f"{folder}/_job-{self.job}/{name}") as f:
                f.write(content)
            names.append(name)
        return Written(names)

    def commit(self, messages):
        from pyarrow import fs

        store, folder = _store(self.folder)
        store.create_dir(folder, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(folder)):
                if old.is_file and (old.base_name.endswith(self.ending) or old.base_name == SIZE_NOTE):
                    store.delete_file(old.path)
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{folder}/_job-{self.job}/{name}", f"{folder}/{name}")
        self.finish(store, folder)
        store.delete_dir(f"{folder}/_job-{self.job}") if store.get_file_info(f"{folder}/_job-{self.job}").type != fs.FileType.NotFound else None

    def finish(self, store, folder: str) -> None:
        """What the driver adds when all files are there."""

    def abort(self, messages):
        from pyarrow import fs

        store, folder = _store(self.folder)
        if store.get_file_info(f"{folder}/_job-{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{folder}/_job-{self.job}")


class CloudWriter(PartWriter):
    def __init__(self, folder: str, overwrite: bool, columns: list[tuple[str, str]]):
        super().__init__(folder, overwrite, ".pcd")
        self.columns = columns

    def files(self, batches, part):
        kind = np.dtype([(n, PCD_COLUMNS[t][2]) for n, t in self.columns])
        held, n, number = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, FILE_POINTS):
                piece = batch.slice(at, FILE_POINTS)
                rows = np.empty(piece.num_rows, kind)
                for i, (name, t) in enumerate(self.columns):
                    v = piece.column(i)
                    if v.null_count:
                        if t not in ("double", "float"):
                            raise ValueError(f"column {name} holds nulls, which a cloud has no value for")
                        v = v.fill_null(float("nan"))
                    rows[name] = v.to_numpy(zero_copy_only=False)
                held.append(rows)
                n += len(rows)
                if n >= FILE_POINTS:
                    yield self._file(held, f"part-{part}-{number}.pcd")
                    held, n, number = [], 0, number + 1
        if held:
            yield self._file(held, f"part-{part}-{number}.pcd")

    def _file(self, held, name):
        rows = np.concatenate(held)
        words = lambda i: " ".join(str(PCD_COLUMNS[t][i]) for _, t in self.columns)
        head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS {' '.join(c for c, _ in self.columns)}\nSIZE {words(1)}\nTYPE {words(0)}\nCOUNT {' '.join('1' for _ in self.columns)}\nWIDTH {len(rows)}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {len(rows)}\nDATA binary\n"
        return name, head.encode() + rows.tobytes()


class CloudSink(DataSource):
    @classmethod
    def name(cls):
        return "pcd_files"

    def writer(self, schema, overwrite):
        columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        wrong = [c for c, t in columns if t not in PCD_COLUMNS or " " in c]
        if wrong:
            raise ValueError(f"a cloud cannot hold the columns {', '.join(wrong)}")
        return CloudWriter(self.options["path"], overwrite, columns)


class MapWriter(PartWriter):
    def __init__(self, folder: str, overwrite: bool, width: int, height: int):
        super().__init__(folder, overwrite, ".pgm")
        self.width, self.height = width, height

    def files(self, batches, part):
        band, image = None, None
        for batch in batches:
            bands, gy, gx, pixel = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for at in np.split(np.arange(len(bands)), np.flatnonzero(bands[1:] != bands[:-1]) + 1):
                if not len(at):
                    continue
                if band is not None and bands[at[0]] != band:
                    yield self._file(band, image)
                    image = None
                band = int(bands[at[0]])
                if image is None:
                    image = np.full((min(BAND_ROWS, self.height - band * BAND_ROWS), self.width), UNKNOWN, np.uint8)
                image[self.height - 1 - gy[at] - band * BAND_ROWS, gx[at]] = pixel[at]
        if image is not None:
            yield self._file(band, image)

    def _file(self, band, image):
        return f"rows-{band * BAND_ROWS:010d}.pgm", f"P5\n{self.width} {len(image)}\n255\n".encode() + image.tobytes()

    def finish(self, store, folder):
        with store.open_output_stream(f"{folder}/{SIZE_NOTE}") as f:
            f.write(json.dumps({"width": self.width, "height": self.height}).encode())


class MapSink(DataSource):
    @classmethod
    def name(cls):
        return "pgm_bands"

    def writer(self, schema, overwrite):
        return MapWriter(self.options["path"], overwrite, int(self.options["width"]), int(self.options["height"]))


def write_cloud(points: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """A folder of PCD files, one or more a task; numeric columns keep their type and order.

    Null coordinates become NaN, nulls of other columns are refused; without
    rows the folder has no files.
    """
    points.sparkSession.dataSource.register(CloudSink)
    points.write.format("pcd_files").mode(mode).save(folder)


def write_map(cells: DataFrame, width: int, height: int, folder: str) -> None:
    """``(gy, gx, pixel)``, row 0 at the bottom, as a folder of images of ``BAND_ROWS`` rows; bands without a cell have no image.

    A cell that is not given is unknown, cells outside of the map are left out;
    of a cell given twice the greater pixel stays.
    """
    cells.sparkSession.dataSource.register(MapSink)
    inside = cells.where(F.col("gy").between(0, height - 1) & F.col("gx").between(0, width - 1))
    once = inside.groupBy(F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx")).agg(F.max(F.col("pixel").cast("int")).alias("pixel"))
    band = F.floor((F.lit(height - 1) - F.col("gy")) / BAND_ROWS).cast("long")
    rows = once.select(band.alias("band"), "gy", "gx", "pixel").repartition("band").sortWithinPartitions("band")
    rows.write.format("pgm_bands").option("width", width).option("height", height).mode("overwrite").save(folder)


def read_clouds(spark: SparkSession, folder: str) -> DataFrame:
    """All PCD and PLY files of a folder, which have the same fields, as one table; ``file`` names where a row is from."""
    from wayfloor.sources.clouds import read_header, spark_schema

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pcd,ply}").load(folder)
    files = files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    first = files.orderBy("path").limit(1).collect()
    if not first:
        raise ValueError(f"no cloud in {folder}")
    header = read_header(first[0]["path"])
    schema = spark_schema(header)
    schema.add("file", "string")

    def run(batches):
        from wayfloor.sources.clouds import CloudReader

        for batch in batches:
            for path in batch.column(0).to_pylist():
                reader = CloudReader(path, read_header(path))
                if reader.header["fields"] != header["fields"]:
                    raise ValueError(f"{path} has other fields than the first file")
                for part in reader.partitions():
                    for rows in reader.read(part):
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([path] * rows.num_rows, pa.string())], names=[*rows.schema.names, "file"])

    return files.repartition("path").mapInArrow(run, schema)


def read_map(spark: SparkSession, folder: str) -> DataFrame:
    """``(gy, gx, pixel)`` of a map that ``write_map`` wrote; one task a band."""
    from wayfloor.sources.maps import read_pgm

    folder = folder.rstrip("/")
    size = spark.read.json(f"{folder}/{SIZE_NOTE}").first()
    top = F.regexp_extract("path", r"rows-(\d+)\.pgm$", 1).cast("long")
    rows = F.least(F.lit(BAND_ROWS), F.lit(size["height"]) - top)
    return read_pgm(spark, f"{folder}/*.pgm").select((F.lit(size["height"]) - top - rows + F.col("gy")).alias("gy"), "gx", "pixel")
