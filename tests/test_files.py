"""LAS and GeoTIFF files, logs and the rules of the scratch folder."""


import numpy as np
import pytest

from emberline import scratch
from emberline.sources import geotiff, las, store

WKT = 'PROJCS["ETRS89 / UTM zone 30N",GEOGCS["a",AUTHORITY["EPSG","4258"]],AUTHORITY["EPSG","25830"]]'


def cloud(n):
    rng = np.random.default_rng(n)
    return rng.uniform(500_000, 500_100, n), rng.uniform(4_000_000, 4_000_100, n), rng.uniform(-2, 30, n), rng.integers(1, 7, n)


@pytest.mark.parametrize("kind", [0, 1, 6])
def test_las_round_trip(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(las, "CHUNK", 300)
    monkeypatch.setattr(las, "RANGE_POINTS", 700)
    x, y, z, c = cloud(1000)
    (tmp_path / "a.las").write_bytes(las.las_bytes(x, y, z, c, wkt=WKT, kind=kind))
    (tmp_path / "b.copc.las").write_bytes(las.las_bytes(x, y, z, c))
    (tmp_path / "empty.las").write_bytes(las.las_bytes(x[:0], y[:0], z[:0], c[:0]))
    (tmp_path / "notes.txt").write_text("x")
    found = las.read_las(spark, str(tmp_path), None).toPandas()
    assert len(found) == 1000 and set(found.dataset) == {"a.las"} and set(found.epsg) == {25830}
    places = lambda *v: np.stack(v, axis=1)[np.lexsort(np.round(v, 2))]
    assert np.abs(places(*(found[n].to_numpy() for n in ("classification", "z", "y", "x"))) - places(c, z, y, x)).max() < 0.0006
    assert set(found.return_number) == {1}
    assert las.read_las(spark, str(tmp_path), (4, 5)).count() == np.isin(c, (4, 5)).sum()


@pytest.mark.parametrize("spoil", [lambda b: b[:900], lambda b: b"XXXX" + b[4:], lambda b: b[:104] + bytes([b[104] | 128]) + b[105:]])
def test_what_is_not_las_is_an_error(spark, tmp_path, spoil):
    x, y, z, c = cloud(100)
    (tmp_path / "a.las").write_bytes(spoil(las.las_bytes(x, y, z, c)))
    with pytest.raises(Exception, match="a.las"):
        las.read_las(spark, str(tmp_path), None).collect()


@pytest.mark.parametrize(("kind", "deflate"), [("f4", True), ("f8", False), ("u1", True), ("i2", False)])
def test_geotiff_round_trip(spark, tmp_path, kind, deflate):
    values = (np.random.default_rng(1).uniform(0, 100, (2, 300, 41))).astype(kind)
    values[0, 3, 4] = 7
    (tmp_path / "a.tif").write_bytes(geotiff.geotiff_bytes(values, 10.0, 900.0, 5.0, 2.5, 7.0, 25830, deflate))
    found = geotiff.read_rasters(spark, str(tmp_path)).toPandas()
    out = np.full(values.shape, np.nan)
    out[found.band - 1, found.row, found.col] = found.value
    expected = values.astype(float)
    expected[values == 7] = np.nan
    assert np.array_equal(out, expected, equal_nan=True)
    frame = geotiff.read_frames(spark, str(tmp_path)).first()
    assert (frame.width, frame.height, frame.bands, frame.x0, frame.top, frame.dx, frame.dy, frame.nodata, frame.epsg) == (41, 300, 2, 10.0, 900.0, 5.0, 2.5, 7.0, 25830)


def test_predictors():
    import zlib

    values = np.arange(60, dtype="<i2").reshape(5, 12) ** 2
    step = np.diff(values, axis=1, prepend=np.zeros((5, 1), "<i2")).astype("<i2")
    t = {geotiff.COMPRESSION: (8,), geotiff.PREDICTOR: (2,)}
    assert np.array_equal(geotiff._unpacked(zlib.compress(step.tobytes()), t, np.dtype("<i2"), (5, 12, 1))[:, :, 0], values)
    real = np.random.default_rng(0).normal(size=(5, 12)).astype("<f4")
    planes = real.astype(">f4").view(np.uint8).reshape(5, 12, 4).transpose(0, 2, 1).reshape(5, -1)
    coded = np.diff(planes, axis=1, prepend=np.zeros((5, 1), np.uint8)).astype(np.uint8)
    t[geotiff.PREDICTOR] = (3,)
    assert np.array_equal(geotiff._unpacked(zlib.compress(coded.tobytes()), t, np.dtype("<f4"), (5, 12, 1))[:, :, 0], real)


@pytest.mark.parametrize("big_from", [4_000_000_000, 0])
def test_write_rasters(spark, tmp_path, big_from):
    frames = spark.createDataFrame([("one", 40, 30, 1, 0.0, 3.0, 1.0, 1.0, -1.0, 4326), ("two", 2, 2, 2, 0.0, 2.0, 1.0, 1.0, None, None), ("none", 2, 1, 1, 0.0, 1.0, 1.0, 1.0, -5.0, None)], geotiff.FRAME)
    cells = [("one", 1, 0, 0, 1.5), ("one", 1, 29, 39, 2.5), ("one", 1, 1, 1, None), ("one", 1, 0, 0, 0.5), ("one", 1, 30, 0, 9.0), ("one", 2, 0, 0, 9.0), ("two", 1, 0, 1, 3.0), ("two", 2, 1, 0, 4.0), ("gone", 1, 0, 0, 1.0)]
    done = geotiff.write_rasters(spark.createDataFrame(cells, geotiff.RASTER).repartition(3), frames, str(tmp_path / "out"), side=16, big_from=big_from)
    assert sorted(r[0] for r in done.collect()) == ["none", "one", "two"] and not list((tmp_path / "out").glob(".*.tif.*"))
    found = geotiff.read_rasters(spark, str(tmp_path / "out"))
    known = found.where("value IS NOT NULL AND value <> 0").collect()
    assert sorted((r.raster_id, r.band, r.row, r.col, r.value) for r in known) == [("one.tif", 1, 0, 0, 1.5), ("one.tif", 1, 29, 39, 2.5), ("two.tif", 1, 0, 1, 3.0), ("two.tif", 2, 1, 0, 4.0)]
    assert found.where("raster_id = 'one.tif'").count() == 1200
    frame = geotiff.read_frames(spark, str(tmp_path / "out")).where("raster_id = 'one.tif'").first()
    assert (frame.width, frame.height, frame.nodata, frame.epsg) == (40, 30, -1.0, 4326)


def test_a_window_reads_its_tiles_alone(spark, tmp_path):
    """Bytes beyond the tiles of the window are spoilt, and only a wider read finds that."""
    side, n = 16, 64
    rows = [("a", b, r, c, float(b * 10_000 + r * 100 + c)) for b in (1, 2) for r in range(n) for c in range(n)]
    frames = spark.createDataFrame([("a", n, n, 2, 0.0, 64.0, 1.0, 1.0, None, None)], geotiff.FRAME)
    geotiff.write_rasters(spark.createDataFrame(rows, geotiff.RASTER), frames, str(tmp_path), "f8", side).count()
    path = tmp_path / "a.tif"
    window = {"bands": [2], "rows": (10, 20), "cols": (30, 33)}
    asked, whole = geotiff.raster_blocks(spark, str(tmp_path), **window).collect(), geotiff.raster_blocks(spark, str(tmp_path)).collect()
    assert len(asked) == 4 and len(whole) == 32
    assert sum(r.size for r in asked) < sum(r.size for r in whole) / 6
    data, kept = bytearray(path.read_bytes()), {(r.at, r.size) for r in asked}
    for r in whole:
        if (r.at, r.size) not in kept:
            data[r.at : r.at + r.size] = b"x" * r.size
    path.write_bytes(data)
    found = geotiff.read_rasters(spark, str(tmp_path), **window).collect()
    assert sorted((r.band, r.row, r.col, r.value) for r in found) == [(2, r, c, 20_000.0 + r * 100 + c) for r in range(10, 20) for c in range(30, 33)]
    with pytest.raises(Exception, match="a.tif, block at"):
        geotiff.read_rasters(spark, str(tmp_path)).collect()


def test_a_raster_of_over_two_gigabytes(spark, tmp_path):
    """A file with holes: 20 000 x 30 000 cells of 4 bytes, of which a window and a part of one are known."""
    width, height, high = 20_000, 30_000, 100
    strips = height // high
    sizes = [high * width * 4] * strips
    head = {"width": width, "height": height, "bands": 1, "x0": 0.0, "top": 0.0, "dx": 1.0, "dy": 1.0, "nodata": None, "epsg": None}
    fields = [*geotiff._fields(head, np.dtype("<f4"), False), (geotiff.STRIPS, "Q", sizes), (geotiff.ROWS, "I", [high]), (geotiff.STRIP_SIZES, "Q", sizes)]
    lead = geotiff._header(fields, np.cumsum([0, *sizes])[:-1], True)
    with open(tmp_path / "large.tif", "wb") as f:
        f.write(lead)
        f.seek(len(lead) + (29_950 * width + 19_990) * 4)
        f.write(np.arange(10, dtype="<f4").tobytes())
        f.truncate(len(lead) + sum(sizes))
    assert (tmp_path / "large.tif").stat().st_size > 1 << 31
    assert geotiff.raster_blocks(spark, str(tmp_path), rows=(29_950, 29_951)).count() == 1
    found = geotiff.read_rasters(spark, str(tmp_path), rows=(29_950, 29_951), cols=(19_988, 20_000)).collect()
    assert [r.value for r in sorted(found, key=lambda r: r.col)] == [0.0, 0.0, *map(float, range(10))]


def test_a_mosaic_vrt(spark, tmp_path):
    for name, base in (("a", 0), ("b", 1000)):
        (tmp_path / f"{name}.tif").write_bytes(geotiff.geotiff_bytes(np.arange(12, dtype="f4").reshape(1, 3, 4) + base, 0, 0, 1, 1))
    part = lambda f, sx, sy, w, h, dx, dy: f'<SimpleSource><SourceFilename relativeToVRT="1">{f}.tif</SourceFilename><SourceBand>1</SourceBand><SrcRect xOff="{sx}" yOff="{sy}" xSize="{w}" ySize="{h}"/><DstRect xOff="{dx}" yOff="{dy}" xSize="{w}" ySize="{h}"/></SimpleSource>'
    (tmp_path / "m.vrt").write_text(f'<VRTDataset rasterXSize="6" rasterYSize="3"><VRTRasterBand dataType="Float32" band="1">{part("a", 0, 0, 4, 3, 0, 0)}{part("b", 1, 1, 2, 2, 4, 1)}</VRTRasterBand></VRTDataset>')
    cells = {(r, c): float(r * 4 + c) for r in range(3) for c in range(4)} | {(r, c): 1000.0 + r * 4 + c - 3 for r in (1, 2) for c in (4, 5)}
    found = geotiff.read_vrt(spark, str(tmp_path)).collect()
    assert {(r.row, r.col): r.value for r in found} == cells and {(r.raster_id, r.band) for r in found} == {("m.vrt", 1)}
    some = geotiff.read_vrt(spark, str(tmp_path), rows=(1, 2), cols=(3, 5)).collect()
    assert {(r.row, r.col): r.value for r in some} == {k: v for k, v in cells.items() if k in ((1, 3), (1, 4))}


def test_points_are_written_by_tasks_and_read_by_box(spark, tmp_path):
    x, y, z, c = cloud(3000)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, z, c, strict=True)], "x double, y double, z double, classification double")
    done = las.write_las(rows, str(tmp_path), wkt=WKT, kind=6, file_points=200).collect()
    assert sum(r.n for r in done) == 3000 and len(done) >= 10 and not list(tmp_path.glob(".*"))
    found = las.read_las(spark, str(tmp_path), None).toPandas()
    assert len(found) == 3000 and set(found.epsg) == {25830} and sorted(found.classification) == sorted(c)
    assert np.abs(np.sort(found.x.to_numpy()) - np.sort(x)).max() < 0.0006
    box = (500_020.0, 500_030.0, 4_000_040.0, 4_000_055.0)
    inside = (x > box[0]) & (x < box[1]) & (y > box[2]) & (y < box[3])
    beyond = [r.file for r in done if r.max_x < box[0] - 1 or r.min_x > box[1] + 1 or r.max_y < box[2] - 1 or r.min_y > box[3] + 1]
    assert len(beyond) > len(done) / 2
    for name in beyond:  # the points of files beyond the box are spoilt; their headers are not
        data = (tmp_path / name).read_bytes()
        (tmp_path / name).write_bytes(data[:600] + bytes(len(data) - 600))
    assert las.read_las(spark, str(tmp_path), None, box=box).count() == inside.sum()
    with pytest.raises(las.LasError, match="1 points"):
        las.write_las(spark.createDataFrame([(1.0, None, 1.0, 2)], "x double, y double, z double, classification int"), str(tmp_path / "b"))
    assert las.write_las(rows.limit(0), str(tmp_path / "c")).count() == 0
    wide = spark.createDataFrame([(0.0, 0.0, 0.0, 2), (1e7, 0.0, 0.0, 2)], "x double, y double, z double, classification int")
    with pytest.raises(Exception, match="does not hold"):
        las.write_las(wide, str(tmp_path / "d")).count()


def test_many_small_files_take_few_tasks(spark, tmp_path):
    """Files do not cost the driver a task each, and each of them holds a range of the curve."""
    x, y, z, c = cloud(6000)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, z, c, strict=True)], "x double, y double, z double, classification double")
    state = spark.sparkContext._jsc.sc()

    def tasks():
        state.listenerBus().waitUntilEmpty()
        return state.statusStore().executorList(False).head().totalTasks()

    before = tasks()
    done = las.write_las(rows, str(tmp_path), file_points=20).collect()
    assert tasks() - before < 60
    assert len(done) == len(list(tmp_path.glob("*.las"))) == 300 and {r.n for r in done} == {20}
    assert sum((r.max_x - r.min_x) * (r.max_y - r.min_y) for r in done) < 4 * 100 * 100
    found = las.read_las(spark, str(tmp_path), None).toPandas()
    assert np.abs(np.sort(found.x.to_numpy()) - np.sort(x)).max() < 0.0006 and sorted(found.classification) == sorted(c)


def test_a_broken_tiff_is_an_error(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(geotiff.geotiff_bytes(np.ones((1, 50, 50), "f4"), 0, 0, 1, 1, deflate=False)[:2000])
    with pytest.raises(Exception, match="a.tif"):
        geotiff.read_rasters(spark, str(tmp_path)).collect()


def test_logs(spark, tmp_path):
    store.write_readme(spark, str(tmp_path), {"profile": "heights"})
    assert "profile: heights" in (tmp_path / "README.txt").read_text()
    with pytest.raises(ZeroDivisionError), store.error_log(spark, str(tmp_path)):
        1 / 0
    assert "ZeroDivisionError" in (tmp_path / "error_log.txt").read_text()


def test_tile_callbacks(spark, tmp_path):
    seen = []
    kept = store.TileStore(spark, str(tmp_path / "t"), lambda x, y: seen.append(("load", x, y)), lambda x, y: seen.append(("unload", x, y)))
    kept.put(spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "tile_x int, tile_y int, v double"))
    assert kept.get(0, 1).count() == 1 and kept.get(5, 5) is None
    kept.remove(0, 0)
    assert seen == [("load", 0, 1), ("unload", 0, 0)]


class _Cluster:
    """A session of a cluster without a shared folder."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(_Cluster)


def test_nearest_ground_everywhere(spark):
    from emberline.operators import joins

    rng = np.random.default_rng(2)
    ground = [(float(a), float(b), float(c)) for a, b, c in rng.uniform(0, 50, (300, 3))] + [(10.0, 10.0, 5.0), (10.0, 10.0, 4.0)]
    asked = [(i, float(a), float(b), 9.0) for i, (a, b) in enumerate(rng.uniform(-20, 70, (200, 2)))] + [(900, 1e6, -3e5, 1.0), (901, 10.0, 10.0, 7.0), (901, 10.0, 10.0, 7.0), (902, None, 1.0, 2.0), (903, float("nan"), 1.0, 2.0), (904, float("inf"), 1.0, 2.0)]
    out = joins.normalise_heights(spark.createDataFrame(asked, "id int, x double, y double, z double"), spark.createDataFrame(ground, "x double, y double, z double")).collect()
    assert len(out) == len(asked)
    g = np.array(ground)
    for r in out:
        if r.id >= 902:
            assert r.hag is None
            continue
        d = np.hypot(g[:, 0] - r.x, g[:, 1] - r.y)
        assert abs(r.z - r.hag - g[d <= d.min() * (1 + 1e-12), 2].min()) < 1e-9
    none = joins.normalise_heights(spark.createDataFrame(asked[:3], "id int, x double, y double, z double"), spark.createDataFrame([], "x double, y double, z double"))
    assert [r.hag for r in none.collect()] == [None] * 3


def test_uneven_intervals(spark):
    from emberline.operators import joins

    values = spark.createDataFrame([(float(v),) for v in (-1, 0, 1, 2.5, 5, 6, 9, 10)] + [(None,), (float("nan"),)], "z double")
    edges = spark.createDataFrame([(5.0, 6.0), (0.0, 2.0), (2.0, 3.0), (9.0, 10.0)], "low double, high double")
    assert sorted((r.z, r.low) for r in joins.to_edges(values, edges).collect()) == [(0.0, 0.0), (1.0, 0.0), (2.5, 2.0), (5.0, 5.0), (9.0, 9.0)]
    assert joins.to_edges(values, edges.limit(0)).collect() == []
    with pytest.raises(ValueError):
        joins.to_edges(values, spark.createDataFrame([(0.0, 3.0), (2.0, 4.0)], "low double, high double"))


def test_merging_ends_and_is_complete(spark):
    from emberline.operators import tiles

    rng = np.random.default_rng(3)
    boxes = [(int(x), int(x + w), int(y), int(y + h)) for x, y, w, h in zip(rng.integers(0, 400, 150), rng.integers(0, 400, 150), rng.integers(1, 12, 150), rng.integers(1, 12, 150), strict=True)]
    boxes += [(x, x + 1, 600 - x, 601 - x) for x in range(500, 620)] + [(-50, -40, -900, 900)]
    found = tiles.merge_regions(spark.createDataFrame(boxes, "x_min int, x_max int, y_min int, y_max int")).collect()
    out = [tuple(r) for r in found]
    touch = lambda a, b: a[0] <= b[1] and a[1] >= b[0] and a[2] <= b[3] and a[3] >= b[2]
    assert not any(touch(a, b) for i, a in enumerate(out) for b in out[:i])
    assert all(any(o[0] <= b[0] and o[1] >= b[1] and o[2] <= b[2] and o[3] >= b[3] for o in out) for b in boxes)
