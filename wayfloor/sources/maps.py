"""Map files: PGM images, their metadata, and pose logs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Metadata defaults.
DEFAULTS = {"resolution": 0.05, "origin": (0.0, 0.0, 0.0), "free_thresh": 0.196, "negate": 0}


def parse_pgm(data: bytes) -> tuple[int, int, list[int]]:
    """Width, height and 8-bit pixels, row by row from the top, of P5 (8 or 16 bit) and P2 images; other depths are rescaled."""
    import numpy as np

    at, words = 0, []
    while len(words) < 4:
        m = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\S+)").match(data, at)
        if not m:
            raise ValueError("the image header is incomplete")
        words.append(m[1])
        at = m.end()
    kind, (w, h, top) = words[0], map(int, words[1:])
    if kind == b"P5":
        body = data[at + 1 :]
        v = np.frombuffer(body, ">u2" if top > 255 else "u1", w * h).astype(np.int64)
    elif kind == b"P2":
        v = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: w * h], np.int64)
    else:
        raise ValueError(f"image type {kind!r} is not supported")
    if len(v) != w * h:
        raise ValueError("the image has too few pixels")
    return w, h, (np.rint(v * 255.0 / top).astype(int) if top != 255 else v).tolist()


def read_pgm(spark: SparkSession, path: str) -> DataFrame:
    """``(path, gy, gx, pixel)``, row 0 at the bottom; a folder or pattern reads many maps, one task a file."""

    def cells(frames):
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                w, h, v = parse_pgm(bytes(content))
                i = pd.RangeIndex(w * h)
                yield pd.DataFrame({"path": name, "gy": h - 1 - i // w, "gx": i % w, "pixel": v})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(cells, "path string, gy long, gx long, pixel int")


def map_size(spark: SparkSession, path: str) -> DataFrame:
    """``(path, width, height)`` from the header alone."""
    text = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    clean = F.regexp_replace(text, r"#[^\n]*\n", " ")
    size = lambda k: F.regexp_extract(clean, r"^P[25]\s+(\d+)\s+(\d+)", k).cast("int")
    return spark.read.format("binaryFile").load(path).select("path", size(1).alias("width"), size(2).alias("height"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(path, resolution, ox, oy, theta, free_thresh, negate)`` from YAML texts; missing keys take their defaults."""
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("t"))

    def key(name, default):
        found = F.regexp_extract("t", rf"(?m)^\s*{name}\s*:\s*{number}", 1)
        return F.when(found != "", found.cast("double")).otherwise(F.lit(default)).alias(name)

    def origin(k):
        found = F.regexp_extract("t", rf"(?m)^\s*origin\s*:\s*\[\s*{number}\s*,\s*{number}\s*,\s*{number}\s*\]", k + 1)
        return F.when(found != "", found.cast("double")).otherwise(F.lit(DEFAULTS["origin"][k]))

    return text.select(
        "path", key("resolution", DEFAULTS["resolution"]), origin(0).alias("ox"), origin(1).alias("oy"), origin(2).alias("theta"),
        key("free_thresh", DEFAULTS["free_thresh"]), key("negate", float(DEFAULTS["negate"])).cast("int").alias("negate"),
    )


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """``(t, tx, ty, tz, qx, qy, qz, qw)`` of a pose log; blank lines and comments are skipped, quaternions have length one."""
    line = F.trim("value")
    parts = F.split(line, r"\s+")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(parts.alias("p")).where(F.size("p") >= 8)
    names = ("t", "tx", "ty", "tz", "qx", "qy", "qz", "qw")
    rows = rows.select(*(F.col("p")[i].cast("double").alias(n) for i, n in enumerate(names)))
    size = F.sqrt(sum(F.col(q) * F.col(q) for q in names[4:]))
    return rows.select(*names[:4], *((F.col(q) / size).alias(q) for q in names[4:]))


def write_pgm(cells: DataFrame, width: int, height: int, path: str) -> None:
    """An 8-bit P5 image of ``(gy, gx, pixel)``, row by row from the top; the driver holds one row at a time."""
    rows = cells.groupBy("gy").agg(F.array_sort(F.collect_list(F.struct("gx", "pixel"))).alias("r")).orderBy(F.desc("gy"))
    with open(path.removeprefix("file://"), "wb") as f:
        f.write(f"P5\n{width} {height}\n255\n".encode())
        for row in rows.toLocalIterator():
            f.write(bytes(int(c["pixel"]) for c in row["r"]))


def metadata_text(image: str, resolution: float, origin=(0.0, 0.0, 0.0), negate: int = 0, occupied: float = 0.65, free: float = 0.25, mode: str = "trinary") -> str:
    return f"image: {image}\nmode: {mode}\nresolution: {resolution}\norigin: [{origin[0]}, {origin[1]}, {origin[2]}]\nnegate: {negate}\noccupied_thresh: {occupied}\nfree_thresh: {free}\n"


def with_image(text: str, image: str) -> str:
    """The metadata with another image line, put on top if there was none."""
    new, n = re.subn(r"(?m)^image:.*$", lambda _: f"image: {image}", text, count=1)
    return new if n else f"image: {image}\n{text}"


def level_maps(spark: SparkSession, folder: str) -> DataFrame:
    """``(level, path)`` of the images ``map_level<number>.pgm`` of a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "map_level*.pgm").load(folder).select("path")
    level = F.regexp_extract("path", r"map_level(\d+)\.pgm$", 1)
    return files.where(level != "").select(level.cast("int").alias("level"), "path")


#: Endings of the images that stand beside a map.
SIDECARS = ("_traversable", "_floor")


def sidecar_paths(path: str) -> dict[str, str]:
    """Where the images beside a map are looked for."""
    stem, dot, ending = path.rpartition(".")
    return {s[1:]: f"{stem}{s}{dot}{ending}" for s in SIDECARS}


def first_existing(spark: SparkSession, folder: str, stems: list[str], endings: list[str]) -> str | None:
    """The first file of a folder named by a stem and an ending, in that order; through Spark's file systems."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for stem in stems:
        for ending in endings:
            name = f"{folder.rstrip('/')}/{stem}{ending}"
            if store.exists(jvm.org.apache.hadoop.fs.Path(name)):
                return name
    return None


def costmap_pixels(cells: DataFrame, rx: int, ry: int) -> DataFrame:
    """``(gy, gx, pixel)`` of a map whose obstacles are grown by a robot's half sizes: 0 blocked, 254 free."""
    from wayfloor.operators import grid as G

    grown = G.dilate_rectangle(cells.select("gy", "gx", "blocked"), "blocked", rx, ry)
    return grown.select("gy", "gx", F.when(F.col("blocked"), 0).otherwise(254).alias("pixel"))
