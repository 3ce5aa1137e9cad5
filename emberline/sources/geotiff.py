"""Rasters in GeoTIFF files: strips or tiles, not compressed or deflated, and VRT stacks of them.

A header says where every strip or tile lies, so a table of blocks is planned from headers
alone; a window or some bands are a filter on that table, and tasks read the bytes of the
blocks that are left.  Written rasters are encoded tile by tile in parallel and streamed
together by one task for each file, which never holds more than some tiles.
"""

from __future__ import annotations

import struct
import sys
import zlib
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.scratch import stage
from emberline.sources import files, store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: fixed values of the format: sizes of field types, and tags
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, SCALE, TIE, MATRIX, KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
#: sources of a VRT, at most; cells along the side of a written tile
MAX_SOURCES = 10_000
TILE_SIDE = 256
#: cells that a task reads, about
TASK_CELLS = 1 << 21
RASTER = "raster_id string, band int, row int, col int, value double"
FRAME = "raster_id string, width int, height int, bands int, x0 double, top double, dx double, dy double, nodata double, epsg int"


class TiffError(ValueError):
    """Not a GeoTIFF that can be read here."""


def tags(fetch) -> tuple[dict, str]:
    """The fields of the first image, and the byte order.  fetch(at, size): bytes of the file."""
    first = fetch(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(first[:2])
    if order is None or len(first) < 8:
        raise TiffError("no TIFF signature")
    version = struct.unpack_from(order + "H", first, 2)[0]
    if version == 42:
        at, entry, count, inline = struct.unpack_from(order + "I", first, 4)[0], 12, "H", 4
    elif version == 43:
        at, entry, count, inline = struct.unpack_from(order + "Q", first, 8)[0], 20, "Q", 8
    else:
        raise TiffError(f"TIFF version {version}")
    lead = struct.calcsize(order + count)
    n, out = struct.unpack(order + count, fetch(at, lead))[0], {}
    table = fetch(at + lead, n * entry)
    for k in range(n):
        tag, kind = struct.unpack_from(order + "HH", table, k * entry)
        many = struct.unpack_from(order + ("I" if inline == 4 else "Q"), table, k * entry + 4)[0]
        if kind not in TYPES:
            continue
        size = struct.calcsize("=" + TYPES[kind]) * many
        body = table[(k + 1) * entry - inline : (k + 1) * entry]
        if size > inline:
            body = fetch(struct.unpack(order + ("I" if inline == 4 else "Q"), body)[0], size)
        if kind == 2:
            out[tag] = body[:many].split(b"\0")[0].decode("latin-1")
        else:
            out[tag] = struct.unpack_from(order + TYPES[kind] * many, body)
    return out, order


def _type(t: dict, order: str) -> np.dtype:
    bits, kind = t.get(BITS, (1,))[0], t.get(FORMAT, (1,))[0]
    name = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}.get((kind, bits))
    if name is None or len(set(t.get(BITS, (1,)))) > 1:
        raise TiffError(f"samples of {bits} bits of format {kind}")
    return np.dtype(order + name)


def _unpacked(block: bytes, t: dict, kind: np.dtype, shape: tuple[int, int, int]) -> np.ndarray:
    """(rows, columns, samples) of one strip or tile."""
    method, predictor = t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0]
    if method in (8, 32946):
        block = zlib.decompress(block)
    elif method != 1:
        raise TiffError(f"compression {method}")
    rows, width, samples = shape
    if predictor == 3:
        parts = np.frombuffer(block, np.uint8, rows * width * samples * kind.itemsize).reshape(rows, -1).copy()
        for k in range(samples):
            parts[:, k::samples] = np.cumsum(parts[:, k::samples], axis=1, dtype=np.uint8)
        planes = parts.reshape(rows, kind.itemsize, width * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape)
    out = np.frombuffer(block, kind, rows * width * samples).reshape(shape)
    if predictor == 2:
        out = np.cumsum(out, axis=1, dtype=kind.newbyteorder("="))
    elif predictor != 1:
        raise TiffError(f"predictor {predictor}")
    return out


def frame(t: dict) -> dict:
    """Size, upper left corner, cell size, nodata and EPSG code."""
    x0, top, dx, dy = 0.0, 0.0, 1.0, 1.0
    if SCALE in t and TIE in t:
        i, j, _, x, y, _ = t[TIE][:6]
        dx, dy = t[SCALE][:2]
        x0, top = x - i * dx, y + j * dy
    elif MATRIX in t:
        dx, x0, dy, top = t[MATRIX][0], t[MATRIX][3], -t[MATRIX][5], t[MATRIX][7]
    keys = {t[KEYS][k]: t[KEYS][k + 3] for k in range(4, len(t.get(KEYS, ())) - 3, 4) if t[KEYS][k + 1] == 0}
    nodata = t.get(NODATA)
    return {"width": t[WIDTH][0], "height": t[HEIGHT][0], "bands": t.get(SAMPLES, (1,))[0], "x0": x0, "top": top, "dx": dx, "dy": dy, "nodata": float(nodata) if nodata and nodata.strip() else None, "epsg": keys.get(3072) or keys.get(2048)}


BLOCKS = """path string, raster_id string, first_band int, bands int, row int, col int, rows int, cols int, high int, wide int,
at long, size long, kind string, compression int, predictor int, nodata double"""
_NAMES = [c.split()[0] for c in BLOCKS.replace("\n", " ").split(",")]


def _blocks_of(path: str, length: int, t: dict, order: str) -> pa.RecordBatch:
    """A row for each strip or tile of the first image."""
    kind, width, height, samples = _type(t, order), t[WIDTH][0], t[HEIGHT][0], t.get(SAMPLES, (1,))[0]
    apart = t.get(PLANAR, (1,))[0] == 2 and samples > 1
    if TILES in t:
        wide, high, places, sizes = t[TILE_WIDTH][0], t[TILE_HEIGHT][0], t[TILES], t[TILE_SIZES]
    else:
        wide, high, places, sizes = width, min(height, t.get(ROWS, (height,))[0]), t[STRIPS], t[STRIP_SIZES]
    across, down, n = -(-width // wide), -(-height // high), len(places)
    at, size = np.array(places, np.int64), np.array(sizes, np.int64)
    if n != across * down * (samples if apart else 1) or n != len(sizes):
        raise TiffError(f"{n} blocks for {width} x {height} cells of {samples} bands")
    if ((at + size > length) & (size > 0)).any():
        raise TiffError("the file is cut short")
    plane, k = np.divmod(np.arange(n), across * down)
    row, col = k // across * high, k % across * wide
    same = lambda v, dtype: pa.array(np.full(n, v), dtype)
    columns = [
        pa.repeat(path, n), pa.repeat(path.rsplit("/", 1)[-1], n), pa.array((plane if apart else np.zeros(n, int)).astype(np.int32) + np.int32(1)), same(1 if apart else samples, pa.int32()),
        pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(np.minimum(high, height - row).astype(np.int32)), pa.array(np.minimum(wide, width - col).astype(np.int32)),
        pa.array((np.full(n, high) if TILES in t else np.minimum(high, height - row)).astype(np.int32)), same(wide, pa.int32()),
        pa.array(at), pa.array(size), pa.repeat(kind.str, n), same(t.get(COMPRESSION, (1,))[0], pa.int32()), same(t.get(PREDICTOR, (1,))[0], pa.int32()), pa.array([frame(t)["nodata"]] * n, pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


_BROKEN = (TiffError, KeyError, struct.error, zlib.error, ValueError)


def _planned(batches):
    for b in batches:
        for path, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                with files.opened(path) as f:
                    yield _blocks_of(path, length, *tags(f.small))
            except _BROKEN as e:
                raise TiffError(f"{path}: {e!r}") from e


def _decoded(batches):
    """Cells of blocks; a block of no bytes has none."""
    for b in batches:
        path, f, close = None, None, None
        for r in b.to_pylist():
            try:
                if r["path"] != path:
                    if close is not None:
                        close.__exit__(None, None, None)
                    path, close = r["path"], files.opened(r["path"])
                    f = close.__enter__()
                if not r["size"]:
                    continue
                kind, t = np.dtype(r["kind"]), {COMPRESSION: (r["compression"],), PREDICTOR: (r["predictor"],)}
                whole = _unpacked(f.read(r["at"], r["size"]), t, kind, (r["high"], r["wide"], r["bands"]))
                low, high, left, right = r["from_row"] - r["row"], r["to_row"] - r["row"], r["from_col"] - r["col"], r["to_col"] - r["col"]
                for s in range(r["bands"]):
                    if r["only"] is not None and r["first_band"] + s not in r["only"]:
                        continue
                    values = whole[low:high, left:right, s]
                    flat, nodata = values.astype(np.float64).ravel(), r["nodata"]
                    none = np.isnan(flat) if nodata is None else np.isnan(flat) | (flat == nodata) | (values.ravel() == np.array(nodata).astype(values.dtype))
                    row, col = np.divmod(np.arange(len(flat)), right - left)
                    band = (r["first_band"] + s) if r["as_band"] is None else r["as_band"]
                    columns = [pa.repeat(r["raster_id"], len(flat)), pa.array(np.full(len(flat), band, np.int32)), pa.array((row + r["from_row"] + r["down"]).astype(np.int32)), pa.array((col + r["from_col"] + r["along"]).astype(np.int32)), pa.array(flat, mask=none)]
                    yield pa.RecordBatch.from_arrays(columns, ["raster_id", "band", "row", "col", "value"])
            except _BROKEN as e:
                raise TiffError(f"{r['path']}, block at {r['at']}: {e!r}") from e
        if close is not None:
            close.__exit__(None, None, None)


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return files.listed(spark, paths, "*.{tif,tiff,TIF,TIFF}")


def raster_blocks(spark: SparkSession, paths: str | list[str], bands: list[int] | None = None, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """The strips and tiles (BLOCKS) that hold these bands, rows and columns; nothing but headers is read."""
    return _within(_files(spark, paths).mapInArrow(_planned, BLOCKS), bands, rows, cols)


def _within(found: DataFrame, bands, rows, cols) -> DataFrame:
    if bands is not None:
        found = found.where(F.arrays_overlap(F.sequence("first_band", F.col("first_band") + F.col("bands") - 1), F.array(*[F.lit(int(b)) for b in bands]).cast("array<int>")))
    for span, at, size in ((rows, "row", "rows"), (cols, "col", "cols")):
        if span is not None:
            found = found.where((F.col(at) < span[1]) & (F.col(at) + F.col(size) > span[0]))
    return found


def _cells(found: DataFrame, bands, rows, cols) -> DataFrame:
    """Cells of planned blocks, cut to the window."""
    cut = lambda span, at, size: (F.greatest(F.lit(span[0]), F.col(at)), F.least(F.lit(span[1]), F.col(at) + F.col(size))) if span else (F.col(at), F.col(at) + F.col(size))
    (low, high), (left, right) = cut(rows, "row", "rows"), cut(cols, "col", "cols")
    only = F.lit(None).cast("array<int>") if bands is None else F.array(*[F.lit(int(b)) for b in bands]).cast("array<int>")
    extra = {"from_row": low, "to_row": high, "from_col": left, "to_col": right, "only": only}
    moved = {c: F.lit(None if c == "as_band" else 0).cast("int") for c in ("as_band", "down", "along") if c not in found.columns}
    plan = stage(found.withColumns({k: v for k, v in (extra | moved).items() if k not in found.columns}).where("from_row < to_row AND from_col < to_col"), "raster-blocks")
    cells = plan.agg(F.sum(F.col("high").cast("long") * F.col("wide") * F.col("bands"))).first()[0] or 0
    return files.dealt(plan, -(-cells // TASK_CELLS)).mapInArrow(_decoded, RASTER)


def read_rasters(spark: SparkSession, paths: str | list[str], bands: list[int] | None = None, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """(raster_id, band, row, col, value) of GeoTIFF files; nodata is null, bands count from 1.

    raster_id is the name of the file.  bands, rows and cols (from, to; without the latter)
    ask for a part, and only the strips and tiles that hold it are read, by many tasks,
    whatever the size of the file.  A file that cannot be read is an error that names it,
    and the block.
    """
    return _cells(raster_blocks(spark, paths, bands, rows, cols), bands, rows, cols)


def read_frames(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each GeoTIFF file: where it lies and what it holds, as FRAME; only headers are read."""

    def run(batches):
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                try:
                    with files.opened(path) as f:
                        rows.append({"raster_id": path.rsplit("/", 1)[-1]} | frame(tags(f.small)[0]))
                except _BROKEN as e:
                    raise TiffError(f"{path}: {e!r}") from e
            kinds = [pa.string(), *[pa.int32()] * 3, *[pa.float64()] * 5, pa.int32()]
            names = ["raster_id", "width", "height", "bands", "x0", "top", "dx", "dy", "nodata", "epsg"]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, kinds, strict=True))))

    return _files(spark, paths).mapInArrow(run, FRAME)


_STACK = "raster_id string, as_band int, path string, band int, from_row int, to_row int, from_col int, to_col int, down int, along int"


def _stacked(batches):
    """Where each band of a VRT comes from."""
    for b in batches:
        rows = []
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            folder, _, name = path.rpartition("/")
            try:
                for number, band in enumerate(ElementTree.fromstring(content).iter("VRTRasterBand"), 1):
                    for source in [*band.iter("SimpleSource"), *band.iter("ComplexSource")]:
                        file = source.find("SourceFilename")
                        side = lambda rect: [round(float(rect.get(k))) for k in ("xOff", "yOff", "xSize", "ySize")]
                        (x, y, w, h), (to_x, to_y, to_w, to_h) = side(source.find("SrcRect")), side(source.find("DstRect"))
                        if (w, h) != (to_w, to_h):
                            raise TiffError("a source of another resolution")
                        where = f"{folder}/{file.text}" if file.get("relativeToVRT", "0") == "1" else file.text
                        if ":" not in where.split("/", 1)[0]:
                            where = f"file:{where}"
                        rows.append({"raster_id": name, "as_band": int(band.get("band", number)), "path": where, "band": int(source.findtext("SourceBand") or 1), "from_row": y, "to_row": y + h, "from_col": x, "to_col": x + w, "down": to_y - y, "along": to_x - x})
            except (ElementTree.ParseError, AttributeError, TypeError, ValueError) as e:
                raise TiffError(f"{path}: {e!r}") from e
        kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 7]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip([c.split()[0] for c in _STACK.split(", ")], kinds, strict=True))))


def read_vrt(spark: SparkSession, paths: str | list[str], bands: list[int] | None = None, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """(raster_id, band, row, col, value) of VRT files, whose bands and places lie in GeoTIFF files of the same resolution.

    As read_rasters, over all sources: only their blocks within the window are read.
    """
    one = [paths] if isinstance(paths, str) else list(paths)
    texts = spark.read.format("binaryFile").option("pathGlobFilter", "*.{vrt,VRT}").option("recursiveFileLookup", "true").load(one).select("path", "content")
    parts = texts.mapInArrow(_stacked, _STACK)
    if bands is not None:
        parts = parts.where(F.col("as_band").isin([int(b) for b in bands]))
    for span, low, high, moved in ((rows, "from_row", "to_row", "down"), (cols, "from_col", "to_col", "along")):
        if span is not None:
            parts = parts.withColumns({low: F.greatest(F.col(low), F.lit(span[0]) - F.col(moved)), high: F.least(F.col(high), F.lit(span[1]) - F.col(moved))}).where(F.col(low) < F.col(high))
    parts = stage(parts, "vrt")
    sources = [r[0] for r in parts.select("path").distinct().limit(MAX_SOURCES + 1).collect()]
    if len(sources) > MAX_SOURCES:
        raise TiffError(f"more than {MAX_SOURCES} sources")
    found = files.listed(spark, sources, "*").mapInArrow(_planned, BLOCKS) if sources else spark.createDataFrame([], BLOCKS)
    own = parts.select("as_band", F.col("raster_id").alias("name"), F.col("path").alias("p"), F.col("band").alias("one"), *[F.col(c).alias(f"p_{c}") for c in ("from_row", "to_row", "from_col", "to_col")], "down", "along")
    met = found.join(own, (F.col("path") == F.col("p")) & F.col("one").between(F.col("first_band"), F.col("first_band") + F.col("bands") - 1))
    window = {"from_row": F.greatest("row", "p_from_row"), "to_row": F.least(F.col("row") + F.col("rows"), F.col("p_to_row")), "from_col": F.greatest("col", "p_from_col"), "to_col": F.least(F.col("col") + F.col("cols"), F.col("p_to_col"))}
    met = met.withColumns(window | {"only": F.array("one"), "raster_id": F.col("name")})
    return _cells(met.select(*_NAMES, *window, "only", "as_band", "down", "along"), None, None, None)


def write_vrt(spark: SparkSession, frames: DataFrame, path: str) -> None:
    """A VRT at path with a band for each band of the rasters of frames (FRAME, of one size, in the folder of path), in order of name."""
    rows = frames.orderBy("raster_id").limit(MAX_SOURCES + 1).collect()
    if not rows or len(rows) > MAX_SOURCES or len({(r.width, r.height) for r in rows}) > 1:
        raise TiffError(f"a stack needs 1 to {MAX_SOURCES} rasters of one size")
    r = rows[0]
    top = ElementTree.Element("VRTDataset", rasterXSize=str(r.width), rasterYSize=str(r.height))
    ElementTree.SubElement(top, "GeoTransform").text = ", ".join(map(repr, (r.x0, r.dx, 0.0, r.top, 0.0, -r.dy)))
    for number, (row, b) in enumerate(((row, b) for row in rows for b in range(1, row.bands + 1)), 1):
        band = ElementTree.SubElement(top, "VRTRasterBand", dataType="Float64", band=str(number))
        if row.nodata is not None:
            ElementTree.SubElement(band, "NoDataValue").text = repr(row.nodata)
        source = ElementTree.SubElement(band, "SimpleSource")
        ElementTree.SubElement(source, "SourceFilename", relativeToVRT="1").text = row.raster_id
        ElementTree.SubElement(source, "SourceBand").text = str(b)
        for rect in ("SrcRect", "DstRect"):
            ElementTree.SubElement(source, rect, xOff="0", yOff="0", xSize=str(r.width), ySize=str(r.height))
    store.write_text(spark, ElementTree.tostring(top, encoding="unicode"), path)


def _header(fields: list[tuple], places: np.ndarray, big: bool) -> bytes:
    """Signature and fields; (tag, form, values), of which those of STRIPS and TILES are places counted from the end of this header."""
    kinds = {"H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}
    wide, entry, inline, lead = ("Q", 20, 8, 8) if big else ("I", 12, 4, 2)
    table = (16 if big else 8) + lead + entry * len(fields) + struct.calcsize("<" + wide)
    size_of = lambda f, v: len(v[0]) if f == "s" else struct.calcsize("<" + f) * len(v)
    first = table + sum(-(-size_of(f, v) // 8) * 8 for _, f, v in fields if size_of(f, v) > inline)
    head = bytearray(struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, len(fields)) if big else struct.pack("<2sHIH", b"II", 42, 8, len(fields)))
    tail = bytearray()
    for tag, f, v in sorted(fields):
        if tag in (STRIPS, TILES):
            v = (places + first).tolist()
        body = v[0] if f == "s" else np.array(v, f"<{ {'H': 'u2', 'I': 'u4', 'Q': 'u8', 'd': 'f8'}[f] }").tobytes()
        place = body.ljust(inline, b"\0")
        if len(body) > inline:
            place = struct.pack("<" + wide, table + len(tail))
            tail += body.ljust(-(-len(body) // 8) * 8, b"\0")
        head += struct.pack("<HH" + wide, tag, kinds[f], len(body) if f == "s" else len(v)) + place
    return bytes(head) + struct.pack("<" + wide, 0) + bytes(tail)


def _fields(head: dict, kind: np.dtype, deflate: bool) -> list[tuple]:
    """What strips and tiles have in common."""
    bands = head["bands"]
    fields = [
        (WIDTH, "I", [head["width"]]), (HEIGHT, "I", [head["height"]]), (BITS, "H", [8 * kind.itemsize] * bands), (COMPRESSION, "H", [8 if deflate else 1]), (262, "H", [1]), (SAMPLES, "H", [bands]),
        (PLANAR, "H", [2 if bands > 1 else 1]), (FORMAT, "H", [{"u": 1, "i": 2, "f": 3}[kind.kind]] * bands), (SCALE, "d", [head["dx"], head["dy"], 0.0]), (TIE, "d", [0.0, 0.0, 0.0, head["x0"], head["top"], 0.0]),
    ]
    if head["epsg"] is not None:
        fields.append((KEYS, "H", [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, head["epsg"]]))
    if head["nodata"] is not None:
        fields.append((NODATA, "s", [repr(float(head["nodata"])).encode() + b"\0"]))
    return fields


def geotiff_bytes(values: np.ndarray, x0: float, top: float, dx: float, dy: float, nodata: float | None = None, epsg: int | None = None, deflate: bool = True) -> bytes:
    """A small GeoTIFF of [band, row, column], band after band, in strips of some rows."""
    bands, height, width = values.shape
    values = values.astype(values.dtype.newbyteorder("<"))
    high = max(1, min(height, (1 << 18) // max(1, width * values.itemsize)))
    strips = [values[b, r : r + high].tobytes() for b in range(bands) for r in range(0, height, high)]
    strips = [zlib.compress(s, 6) for s in strips] if deflate else strips
    sizes = [len(s) for s in strips]
    head = {"width": width, "height": height, "bands": bands, "x0": x0, "top": top, "dx": dx, "dy": dy, "nodata": nodata, "epsg": epsg}
    fields = [*_fields(head, values.dtype, deflate), (STRIPS, "I", sizes), (ROWS, "I", [high]), (STRIP_SIZES, "I", sizes)]
    return _header(fields, np.cumsum([0, *sizes])[:-1], False) + b"".join(strips)


def _encoded_tile(side: int, kind: np.dtype):
    """One tile of one band, deflated.  Of values for one cell the greatest counts."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        rows = rows.sort_values("value")
        values = np.full((side, side), np.nan_to_num(first["nodata"]), kind)
        values[rows["row"] % side, rows["col"] % side] = rows["value"]
        across, down = -(-int(first["width"]) // side), -(-int(first["height"]) // side)
        block = ((key[1] - 1) * down + key[2]) * across + key[3]
        return pd.DataFrame({"raster_id": [key[0]], "block": [block], "body": [zlib.compress(values.tobytes(), 6)]})

    return run


def _joined(folder: str, side: int, kind: np.dtype, big_from: int):
    """Heads, each before its tiles in order, to files; tiles stream through."""

    def run(batches):
        from contextlib import ExitStack

        now, stack, out = None, None, None
        for b in batches:
            for r in b.to_pylist():
                if r["block"] < 0:
                    if stack is not None:
                        stack.close()
                        yield pa.RecordBatch.from_arrays([pa.array([now])], ["raster_id"])
                    now = r["raster_id"]
                    across, down = -(-r["width"] // side), -(-r["height"] // side)
                    sizes = np.zeros(across * down * r["bands"], np.int64)
                    empty = zlib.compress(np.full((side, side), r["nodata"] or 0.0, kind).tobytes(), 6)
                    known = np.array([(s["block"], s["size"]) for s in r["sizes"] or ()], np.int64).reshape(-1, 2)
                    sizes[known[:, 0]] = known[:, 1]
                    # tiles without a cell are all one, right behind the header
                    places = np.where(sizes > 0, len(empty) + np.cumsum(sizes) - sizes, 0)
                    sizes = np.where(sizes > 0, sizes, len(empty))
                    big = int(sizes.sum()) + 32 * len(sizes) > big_from
                    form = "Q" if big else "I"
                    fields = [*_fields(r, kind, True), (TILE_WIDTH, "I", [side]), (TILE_HEIGHT, "I", [side]), (TILES, form, sizes.tolist()), (TILE_SIZES, form, sizes.tolist())]
                    name = now if now.lower().endswith((".tif", ".tiff")) else f"{now}.tif"
                    stack = ExitStack()
                    out = stack.enter_context(files.created(f"{folder.rstrip('/')}/{name}"))
                    out.write(_header(fields, places, big) + empty)
                else:
                    out.write(r["body"])
        if stack is not None:
            stack.close()
            yield pa.RecordBatch.from_arrays([pa.array([now])], ["raster_id"])

    return run


def write_rasters(rasters: DataFrame, frames: DataFrame, folder: str, kind: str = "f4", side: int = TILE_SIDE, big_from: int = 4_000_000_000) -> DataFrame:
    """(raster_id): a tiled GeoTIFF in folder for each raster of frames (FRAME), from its cells (raster_id, band, row, col, value).

    Tasks encode tiles of side x side cells; their sizes give the header, and one task for
    each raster streams header and tiles into the file, so a raster may be larger than the
    memory of any machine and never passes the driver.  Cells that are missing or null hold
    the nodata value of the frame (0 without one); cells beyond the frame are left out; of
    repeated cells the greatest counts.  Files from big_from bytes on are BigTIFF.  A file
    has its name only once it is complete.
    """
    spark, dtype = rasters.sparkSession, np.dtype(kind).newbyteorder("<")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = frames.select(F.col("raster_id").alias("f_id"), "width", "height", "bands", "nodata")
    cells = rasters.select("raster_id", "band", "row", "col", F.col("value").cast("double").alias("value")).where("value IS NOT NULL")
    cells = cells.join(sized, F.col("raster_id") == F.col("f_id")).where("band BETWEEN 1 AND bands AND row >= 0 AND row < height AND col >= 0 AND col < width")
    tile = [F.floor(F.col(c) / side).cast("int").alias(a) for c, a in (("row", "tile_row"), ("col", "tile_col"))]
    placed = cells.select("raster_id", "band", *tile, "row", "col", "value", "width", "height", "nodata")
    encoded = placed.groupBy("raster_id", "band", "tile_row", "tile_col").applyInPandas(_encoded_tile(side, dtype), "raster_id string, block long, body binary")
    encoded = stage(encoded, "tiles")
    sizes = encoded.groupBy("raster_id").agg(F.collect_list(F.struct("block", F.octet_length("body").cast("long").alias("size"))).alias("sizes"))
    heads = frames.join(sizes, "raster_id", "left").withColumns({"block": F.lit(-1).cast("long"), "body": F.lit(None).cast("binary")})
    rows = heads.unionByName(encoded, allowMissingColumns=True)
    dealt = rows.repartition(parts, "raster_id").sortWithinPartitions("raster_id", "block")
    return stage(dealt.mapInArrow(_joined(folder, side, dtype, big_from), "raster_id string"), "written")
