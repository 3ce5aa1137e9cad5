import gzip
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from emberline.llm import warc
from emberline.scratch import new_path


def page_rows():
    long = "<p>" + "x" * 2000 + "ü</p>"
    rows = [(i, f"http://h/{i}?a b\r\nX: y", f"<p>{i}</p>" * (i % 60)) for i in range(200)]
    rows += [(1000 + i, None, long) for i in range(30)] + [(2000, "u", "y" * 999), (2001, "u", "y" * 999), (2002, "u", "z" * 1000), (2003, "u", "z" * 1000), (2003, "u", "z" * 1000)]
    rows += [(3000, "u", None), (None, "u", long), (None, None, None), (None, None, "short"), (7, "again", "other text")]
    return rows


def expected(rows):
    most = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            most[b] = max(i, most.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = most.get(b) if len(b) >= 1000 and most.get(b) != i else None
        out.append((i is None, i or 0, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to or -1))
    return sorted(out)


def show(r):
    return (r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to)


@pytest.mark.parametrize(("roll", "shard"), [(16 << 20, 48 << 20), (300, 3000), (2000, 1)])
def test_round_trip(spark, roll, shard):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "e", 1) for r in rows], "page_id long, url string, html string, digest string, shard int")
    folder = new_path(spark, "warc")
    manifest = warc.write(pages.repartition(5), folder, roll, shard)
    found = warc.read(spark, folder, payloads=True).collect()
    assert sorted(map(show, found)) == expected(rows)
    payloads = {(r.page_id, r.payload_digest): r.payload for r in found if r.record_type == "response"}
    for i, _, h in rows:
        b = (h or "").encode()
        if (i, hashlib.sha1(b).hexdigest()) in payloads:
            assert bytes(payloads[i, hashlib.sha1(b).hexdigest()] or b"") == b
    assert sum(m["records"] for m in manifest) == len(rows)
    local = folder.removeprefix("file://")
    names = sorted(n for n in os.listdir(local) if not n.endswith(".crc"))
    assert names == sorted([m["name"] for m in manifest] + ["manifest.json"])
    for m in json.loads(open(f"{local}/manifest.json").read()):
        data = open(f"{local}/{m['name']}", "rb").read()
        assert hashlib.sha256(data).hexdigest() == m["sha256"] and len(data) == m["bytes"]
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")


def test_archives_do_not_depend_on_partitions(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    sums = [[(m["name"], m["sha256"]) for m in warc.write(p, new_path(spark, "warc"), 2000, 4000)] for p in (pages.repartition(3), pages.coalesce(1).orderBy(F.desc("page_id")))]
    assert sums[0] == sums[1]


def test_a_wrong_byte_is_noticed():
    data = bytearray(warc.record(1, "u", b"hello world", None))
    data[data.index(b"world")] ^= 1
    with pytest.raises(ValueError):
        warc.parse_record(bytes(data))
    with pytest.raises(ValueError):
        list(warc.members(gzip.compress(b"abc")[:-4]))


def test_url_cannot_break_the_header():
    head = warc.record(1, "a\r\nWARC-Type: x y", b"", None).split(b"\r\n\r\n")[0]
    assert head.count(b"WARC-Type: ") == 1


def test_no_pages(spark):
    out = warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"))
    assert out.collect() == []


def test_borders_split_heavy_bins(spark):
    rows = spark.range(3000).select((F.col("id") * F.col("id")).alias("page_id"), F.lit(10).alias("w"))
    ends = warc.shard_borders(rows, "page_id", "w", 1000)
    ids = [i * i for i in range(3000)]
    import bisect

    sizes = {}
    for i in ids:
        k = bisect.bisect_left(ends, i)
        sizes[k] = sizes.get(k, 0) + 10
    assert ends == sorted(set(ends)) and max(sizes.values()) <= 1000


def test_extreme_ids_and_hot_ids(spark):
    rows = [(-(2**63), "u", "a" * 1200), (2**63 - 1, "u", "a" * 1200), (0, "u", "b")] + [(7, "u", f"x{i}" * 40) for i in range(200)] + [(None, "u", f"y{i}" * 40) for i in range(200)]
    folder = new_path(spark, "warc")
    manifest = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6), folder, 1 << 20, 4000)
    assert sorted(map(show, warc.read(spark, folder).collect())) == expected(rows)
    assert max(m["records"] for m in manifest) < 60


def test_the_manifest_decides(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i}" * 50) for i in range(40)], "page_id long, url string, html string")
    folder = new_path(spark, "warc")
    manifest = warc.write(pages, folder, 500, 3000)
    local = folder.removeprefix("file://")
    with open(f"{local}/part-999999-0000.warc.gz", "wb") as f:  # a file that was never committed
        f.write(gzip.compress(warc.record(99, "u", b"stray", None)))
    assert warc.read(spark, folder).count() == 40
    data = open(f"{local}/{manifest[1]['name']}", "rb").read()
    os.remove(f"{local}/.{manifest[1]['name']}.crc") if os.path.exists(f"{local}/.{manifest[1]['name']}.crc") else None
    with open(f"{local}/{manifest[1]['name']}", "wb") as f:
        f.write(data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(Exception, match="not the file of the manifest"):
        warc.read(spark, folder).collect()
    os.remove(f"{local}/{manifest[1]['name']}")
    with pytest.raises(Exception):
        warc.read(spark, folder).collect()
    os.remove(f"{local}/manifest.json")
    with pytest.raises(FileNotFoundError):
        warc.read(spark, folder)


def test_names_of_file_systems():
    with pytest.raises(OSError, match="cannot write"):
        warc._filesystem("nothing://x/y")
    assert warc._filesystem("file:///tmp/x")[1] == "/tmp/x"


def test_borders_take_few_jobs(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") * 10**14).alias("page_id"), F.lit(10).alias("w"))
    tracker, before = spark.sparkContext.statusTracker(), set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    ends = warc.shard_borders(rows, "page_id", "w", 1000)
    assert len(set(tracker.getJobIdsForGroup(None)) - before) <= 16 and 150 < len(ends) < 450
