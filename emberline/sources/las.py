"""Point clouds in LAS files (1.0 to 1.4, point formats 0 to 10, not compressed), read and written by ranges of points."""

from __future__ import annotations

import re
import struct
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline.schema import VEGETATION_CLASSES
from emberline.scratch import stage
from emberline.sources import files
from emberline.sources.points import keep_classes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

POINTS = "dataset string, x double, y double, z double, classification int, return_number int, number_of_returns int, epsg int"
#: points that are handed on together, and that a task reads
CHUNK = 100_000
RANGE_POINTS = 2_000_000
#: points of a written file, at most
FILE_POINTS = 2_000_000
#: points that a writing task gets, about
TASK_POINTS = 500_000
#: fixed values: EPSG keys of GeoTIFF, projected before geographic
EPSG_KEYS = (3072, 2048)


class LasError(ValueError):
    """Not a LAS file that can be read here."""


def header(data: memoryview) -> dict:
    """What the public header says that reading the points needs."""
    if len(data) < 227 or bytes(data[:4]) != b"LASF":
        raise LasError("no LAS signature")
    major, minor = data[24], data[25]
    size, offset, records = struct.unpack_from("<HII", data, 94)
    kind, length, count = struct.unpack_from("<BHI", data, 104)
    if kind & 0xC0:
        raise LasError("compressed points (LAZ) need a decoder that is not here")
    if kind > 10 or major != 1 or minor > 4:
        raise LasError(f"LAS {major}.{minor} with point format {kind}")
    if minor >= 4 and len(data) >= 255:
        count = struct.unpack_from("<Q", data, 247)[0] or count
    scale, shift = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    high_x, low_x, high_y, low_y = struct.unpack_from("<4d", data, 179)
    return {"box": (low_x, high_x, low_y, high_y), "size": size, "offset": offset, "records": records, "kind": kind, "length": length, "count": count, "scale": scale, "shift": shift}


def epsg_of(data: memoryview, h: dict) -> int | None:
    """The EPSG code from the variable length records: WKT, else the GeoTIFF keys."""
    at, found = h["size"], None
    for _ in range(h["records"]):
        if at + 54 > len(data):
            return found
        user = bytes(data[at + 2 : at + 18]).split(b"\0")[0]
        number, length = struct.unpack_from("<HH", data, at + 18)
        body = data[at + 54 : at + 54 + length]
        if user == b"LASF_Projection" and number == 2112:
            codes = re.findall(r'(?:AUTHORITY\["EPSG","(\d+)"\]|ID\["EPSG",(\d+)\])\]?\s*$', bytes(body).split(b"\0")[0].decode("utf-8", "replace"))
            if codes:
                return int(codes[-1][0] or codes[-1][1])
        if user == b"LASF_Projection" and number == 34735 and length >= 8:
            keys = np.frombuffer(body[: length // 8 * 8], "<u2").reshape(-1, 4)[1:]
            known = {int(k[0]): int(k[3]) for k in keys if k[1] == 0}
            found = next((known[k] for k in EPSG_KEYS if known.get(k)), None)
        at += 54 + length
    return found


def points(records: bytes, kind: int, length: int, scale, shift):
    """(x, y, z, classification, return number, number of returns) of whole point records."""
    raw = np.frombuffer(records, np.uint8).reshape(-1, length)
    place = np.ascontiguousarray(raw[:, :12]).view("<i4")
    xyz = [place[:, k] * scale[k] + shift[k] for k in range(3)]
    if kind < 6:
        return *xyz, raw[:, 15] & 31, raw[:, 14] & 7, (raw[:, 14] >> 3) & 7
    return *xyz, raw[:, 16], raw[:, 14] & 15, raw[:, 14] >> 4


PLAN = "path string, epsg int, at long, count long, kind int, length int, scale array<double>, shift array<double>"


def _planned(box):
    """Ranges of points of each file, from its header alone."""

    def run(batches):
        for b in batches:
            rows = []
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with files.opened(path) as f:
                        h = header(memoryview(f.small(0, 375)))
                        have = max(0, (size - h["offset"]) // max(h["length"], 1))
                        if have < h["count"]:
                            raise LasError(f"{h['count']} points are announced, {have} are there")
                        if box and (h["box"][0] > box[1] or h["box"][1] < box[0] or h["box"][2] > box[3] or h["box"][3] < box[2]):
                            continue
                        code = epsg_of(memoryview(f.small(0, h["offset"])), h)
                except LasError as e:
                    raise LasError(f"{path}: {e}") from e
                common = {"path": path, "epsg": code, "kind": h["kind"], "length": h["length"], "scale": list(h["scale"]), "shift": list(h["shift"])}
                rows += [common | {"at": h["offset"] + k * h["length"], "count": min(RANGE_POINTS, h["count"] - k)} for k in range(0, h["count"], RANGE_POINTS)]
            kinds = {"path": pa.string(), "epsg": pa.int32(), "at": pa.int64(), "count": pa.int64(), "kind": pa.int32(), "length": pa.int32(), "scale": pa.list_(pa.float64()), "shift": pa.list_(pa.float64())}
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))

    return run


def _read(batches):
    for b in batches:
        for r in b.to_pylist():
            name = r["path"].rsplit("/", 1)[-1]
            with files.opened(r["path"]) as f:
                for k in range(0, r["count"], CHUNK):
                    n = min(CHUNK, r["count"] - k)
                    found = f.read(r["at"] + k * r["length"], n * r["length"])
                    if len(found) < n * r["length"]:
                        raise LasError(f"{r['path']}: the file ends at point {k + len(found) // r['length']} of a range of {r['count']}")
                    x, y, z, kind, number, of = points(found, r["kind"], r["length"], r["scale"], r["shift"])
                    columns = [pa.repeat(name, n), *(pa.array(v) for v in (x, y, z)), *(pa.array(v.astype(np.int32)) for v in (kind, number, of)), pa.array([r["epsg"]] * n, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["dataset", "x", "y", "z", "classification", "return_number", "number_of_returns", "epsg"])


def read_las(
    spark: SparkSession, paths: str | list[str], classes: tuple[int, ...] | None = VEGETATION_CLASSES, exclude: str | None = ".copc.", box: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """Points of LAS files with the name of their file as dataset and the EPSG code of its coordinates.

    Folders are read whole; files whose path contains `exclude` are left out.  Headers alone
    give the ranges of points that tasks read, so a file of any size feeds many tasks.  With
    box (x from, x to, y from, y to) only points within it are kept, and files beyond it are
    not read.  A file that is not LAS, is cut short or is compressed is an error that names
    it; one without points gives none.
    """
    found = files.listed(spark, paths, "*.{las,LAS,laz,LAZ}")
    if exclude:
        found = found.where(~F.contains(F.col("path"), F.lit(exclude)))
    plan = stage(found.mapInArrow(_planned(box), PLAN), "las-ranges")
    out = files.dealt(plan, plan.count()).mapInArrow(_read, POINTS)
    if box:
        out = out.where(F.col("x").between(box[0], box[1]) & F.col("y").between(box[2], box[3]))
    return keep_classes(out, classes) if classes is not None else out


def las_bytes(x, y, z, classification, scale: float = 0.001, wkt: str | None = None, kind: int = 0) -> bytes:
    """A LAS 1.2 file (1.4 from point format 6 on) of arrays, for exchange and tests."""
    n, length = len(x), {0: 20, 1: 28, 6: 30}[kind]
    records = b""
    if wkt is not None:
        body = wkt.encode() + b"\0"
        records = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(body), b"") + body
    size = 375 if kind >= 6 else 227
    shift = [float(np.min(v)) if n else 0.0 for v in (x, y, z)]
    ends = [f(v) if n else 0.0 for v in (x, y, z) for f in (np.max, np.min)]
    head = bytearray(size)
    struct.pack_into("<4sHH16sBB32s32sHHHIIBHI5I", head, 0, b"LASF", 0, 0, b"", 1, 4 if kind >= 6 else 2, b"", b"", 1, 1970, size, size + len(records), 1 if wkt is not None else 0, kind, length, 0 if kind >= 6 else n, *[0] * 5)
    struct.pack_into("<12d", head, 131, scale, scale, scale, *shift, *map(float, ends))
    if kind >= 6:
        struct.pack_into("<Q", head, 247, n)
    rows = np.zeros((n, length), np.uint8)
    for k, (v, s) in enumerate(zip((x, y, z), shift, strict=True)):
        whole = np.round((np.asarray(v) - s) / scale)
        if n and whole.max() >= 1 << 31:
            raise LasError(f"a file of scale {scale} does not hold coordinates {ends[2 * k] - ends[2 * k + 1]} apart")
        rows[:, 4 * k : 4 * k + 4] = whole.astype("<i4").view(np.uint8).reshape(-1, 4)
    rows[:, 14] = 17 if kind >= 6 else 9
    rows[:, 16 if kind >= 6 else 15] = classification
    return bytes(head) + records + rows.tobytes()


WRITTEN = "file string, n long, min_x double, max_x double, min_y double, max_y double"


def _spread(v: Column) -> Column:
    """The bits of a number below 2^16, each with an empty one above it."""
    for step, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, step)).bitwiseAND(F.lit(mask))
    return v


def write_las(points: DataFrame, folder: str, scale: float = 0.001, wkt: str | None = None, kind: int = 0, file_points: int = FILE_POINTS) -> DataFrame:
    """(file, n, min_x, max_x, min_y, max_y): LAS files in folder of points (x, y, z, classification), written by tasks.

    A first pass gives bounds and count; a file holds a range of a space-filling curve of
    up to file_points points, so its bounds in its header are narrow and a reader with a box
    opens few.  A task writes many small files, so tasks follow the points and not the files.
    The scale is a step of the coordinates.  A point with a null or an infinite
    coordinate is an error; without points nothing is written.
    """
    spark = points.sparkSession
    given = points.select(*[F.col(c).cast("double").alias(c) for c in "xyz"], F.col("classification").cast("int").alias("classification"))
    bad = F.lit(False)
    for c in "xyz":
        bad = bad | ~F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    n, wrong, a, b, c, d = given.agg(F.count("*"), F.count_if(bad), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if wrong:
        raise LasError(f"{wrong} points without a place")
    if not n:
        return spark.createDataFrame([], WRITTEN)
    unit = lambda v, low, high: F.least(F.lit(65535), F.floor((F.col(v) - low) / ((high - low) or 1.0) * 65536)).cast("long")
    code = F.shiftleft(_spread(unit("x", a, b)), 1).bitwiseOR(_spread(unit("y", c, d)))
    order = ("_code", "x", "y", "z", "classification")
    ranged = given.withColumn("_code", code).repartitionByRange(-(-n // TASK_POINTS), *order).sortWithinPartitions(*order).drop("_code")

    def run(batches):
        from pyspark import TaskContext

        task, made, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def written():
            x, y, z, classes = (np.concatenate([h[k] for h in held]) for k in range(4))
            name = f"part-{task:06d}-{made:06d}.las"
            with files.created(f"{folder.rstrip('/')}/{name}") as out:
                out.write(las_bytes(x, y, z, np.nan_to_num(classes).astype(np.uint8), scale, wkt, kind))
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (name, len(x), x.min(), x.max(), y.min(), y.max())], ["file", "n", "min_x", "max_x", "min_y", "max_y"])

        for b in batches:
            columns, at = [c.to_numpy(zero_copy_only=False) for c in b.columns], 0
            while at < b.num_rows:
                to = min(b.num_rows, at + file_points - rows)
                held.append([c[at:to] for c in columns])
                rows, at = rows + to - at, to
                if rows == file_points:
                    yield written()
                    made, held, rows = made + 1, [], 0
        if rows:
            yield written()

    return stage(ranged.mapInArrow(run, WRITTEN), "las-files")
