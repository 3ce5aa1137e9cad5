"""WARC archives: a deterministic sharded writer and a reader.

Records are ordered by page id and payload digest and dealt into shards of consecutive
keys.  Shard borders come from histograms of ids and bytes, one job for each level, and
from one of digests for ids that are too heavy for a shard, so they depend on the rows
alone.  A task streams one shard into gzip members, one for each record, and starts a new
file when the compressed size is reached.  Files are written under names of the task
attempt; once all shards are written, tasks rename those of the attempts that count, and one
task streams the manifest, which gets its name last.  The driver sees counts alone, however
many files there are.  A lost executor leaves nothing but temporary files behind.  What the
manifest lists is the archive: readers take their files and checksums from it, so a writer
that was stopped half way has written nothing.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.llm.arrow import own_partitions, widened
from emberline.scratch import drop, new_path, stage

ROLL_BYTES = 8 << 20
#: uncompressed bytes of a shard, about
SHARD_BYTES = 48 << 20
MAX_SHARDS = 65_536
#: bins of a histogram, of all that are counted in one job, together
BINS = 1 << 16
REVISIT_BYTES = 1_000
#: fixed values of the format
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

MANIFEST_NAME = "manifest.json"
#: where files are until they count
TEMPORARY = "_temporary"
#: compressed bytes that a task reads, about
READ_BYTES = 64 << 20
MANIFEST = "shard int, file int, temporary string, name string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _sums(rows: DataFrame, keys: np.ndarray, weight: str, fresh: np.ndarray) -> np.ndarray:
    """Weights of the bins that end (inclusive) at these keys; rows in bins that are not fresh are left out."""

    def run(batches):
        for b in batches:
            at = np.searchsorted(keys, b.column(0).to_numpy(zero_copy_only=False))
            sums = np.bincount(at, weights=b.column(1).to_numpy(zero_copy_only=False), minlength=len(keys))
            there = np.flatnonzero((sums > 0) & fresh)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there].astype(np.int64))], ["bin", "sum"])

    out = np.zeros(len(keys), np.int64)
    for r in rows.mapInArrow(run, "bin long, sum long").groupBy("bin").agg(F.sum("sum").alias("sum")).collect():  # a row for each bin at most
        out[r["bin"]] = r["sum"]
    return out


def shard_borders(rows: DataFrame, key: str, weight: str, target: int) -> list[int]:
    """Upper ends (inclusive) of consecutive key ranges of about `target` bytes.

    One job counts a histogram of BINS bins; those that are too heavy are all split by the
    next job, until they are light or a single key.  Bins that are light are joined.  Keys
    may be any longs; rows without key or weight count nowhere.
    """
    rows = rows.select(key, weight).where(F.col(key).isNotNull() & (F.col(weight) > 0))
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return []
    ranges, done = [(low, high)], []  # Python's integers do not overflow
    while ranges:
        per, fresh = max(2, BINS // len(ranges)), []
        for low, high in ranges:
            width = max(1, -(-(high - low + 1) // per))
            fresh += [(x, min(high, x + width - 1)) for x in range(low, high + 1, width)]
        # a bin of no interest before each run of bins takes what lies between
        gaps = [(a[1] + 1, z[0] - 1) for a, z in zip([(None, None), *fresh], fresh, strict=False) if a[1] is not None and a[1] + 1 < z[0]]
        first = fresh[0][0] - 1
        bins = sorted([*fresh, *gaps, *([(first, first)] if first >= -(1 << 63) else [])])
        wanted = set(fresh)
        ends = np.array([e for _, e in bins], np.int64)
        ends = ends if ends[-1] == np.iinfo(np.int64).max else np.r_[ends, np.iinfo(np.int64).max]
        sums = _sums(rows, ends, weight, np.array([*[x in wanted for x in bins], False][: len(ends)]))
        ranges, held = [], None
        for x, n in zip(bins, sums.tolist(), strict=False):
            if x not in wanted or not n:
                continue
            if n > target and x[0] < x[1]:
                ranges.append(x)
                held = None
            elif held is not None and done[held][2] + n <= target:
                done[held] = (done[held][0], x[1], done[held][2] + n)
            else:
                done.append((*x, n))
                held = len(done) - 1
    borders, held, last = [], 0, None
    for _, end, n in sorted(done):
        if held and held + n > target:
            borders.append(last)
            held = 0
        held, last = held + n, end
    return borders


def _filesystem_error(uri: str) -> str:
    return f"tasks cannot write to {uri}: pyarrow opens file, hdfs, viewfs (with libhdfs), s3/s3a, gs, abfs/abfss"


def _header(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _clean(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, digest: str, n: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{n}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, n: int = 0) -> bytes:
    """One record; a revisit keeps the HTTP head and leaves the payload to the response."""
    digest = hashlib.sha1(payload).hexdigest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Record-ID", record_id(page_id, digest, n)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{_base32(digest)}"), ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).hexdigest())}")]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to)), ("WARC-Profile", PROFILE)]
    return _header("revisit" if refers_to is not None else "response", fields, block)


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _filesystem(uri: str):
    """The file system and path of a URI; what Hadoop calls s3a and s3n is s3 here."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    name = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}.get(scheme, scheme)
    try:
        return fs.FileSystem.from_uri(f"{name}{colon}{rest}")
    except (pa.ArrowInvalid, NotImplementedError) as e:
        raise OSError(_filesystem_error(uri)) from e


def _write_shards(folder: str, roll: int):
    def run(batches):
        where, root = _filesystem(folder)
        context = TaskContext.get()
        attempt = f"{context.stageId()}-{context.partitionId()}-{context.taskAttemptId()}"
        out, state, done, refers, seen = None, {}, [], {}, {}

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((state["shard"], state["file"], state["temporary"], f"part-{state['shard']:06d}-{state['file']:04d}.warc.gz", state["records"], state["bytes"], state["sum"].hexdigest()))
                out = None

        for b in batches:
            for r in b.to_pylist():
                if r["shard"] != state.get("shard"):
                    close()
                    state, refers, seen = {"shard": r["shard"], "file": -1}, {}, {}
                if r["kind"] == 0:  # which page each revisit of this shard refers to comes first
                    refers[(r["page_id"], r["digest"])] = r["refers_to"]
                    continue
                if out is None:
                    name = f"{TEMPORARY}/{attempt}-{r['shard']:06d}-{state['file'] + 1:04d}"
                    state |= {"file": state["file"] + 1, "temporary": name, "records": 0, "bytes": 0, "sum": hashlib.sha256()}
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                payload, key = r["payload"] or b"", (r["page_id"], r["digest"])
                seen = {key: seen.get(key, -1) + 1}
                data = _gzip(record(r["page_id"], r["url"], payload, refers.get(key), seen[key]))
                out.write(data)
                state["sum"].update(data)
                state["records"] += 1
                state["bytes"] += len(data)
                if state["bytes"] >= roll:
                    close()
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "file", "temporary", "name", "records", "bytes", "sha256"), x, strict=True)) for x in done], pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    return run


def write(pages: DataFrame, folder: str, roll: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, revisit_bytes: int = REVISIT_BYTES) -> Manifest:
    """Write pages (page_id, url, html) below folder; returns the manifest.

    A null page is an empty payload, a null url leaves out the target, a null page_id
    sorts first and goes without an id.  Of pages with equal payloads of revisit_bytes
    bytes or more the largest page_id is the response and the others revisit it; rows
    repeated with that id are responses too.  Rows of one id, or of none, may fill many
    shards, by their digests; rows equal in id and payload are in one shard.  Without rows
    there are no files but an empty manifest.  Further columns are not read.
    """
    spark = pages.sparkSession
    _filesystem(folder)  # before any work
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    facts = stage(rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("n")), "payloads")
    long = facts.where(F.col("n") >= revisit_bytes)
    kept = stage(long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("m")).where("m > 1 AND refers_to IS NOT NULL").select(F.col("digest").alias("d"), "refers_to"), "responses")
    revisits = long.join(kept, long.digest == kept.d).where("page_id IS NULL OR page_id <> refers_to")
    weighed = facts.withColumn("weight", F.col("n") + 400)
    total = weighed.agg(F.sum("weight")).first()[0] or 0
    target = max(shard_bytes, -(-total // MAX_SHARDS))
    shards = Shards(shard_borders(weighed, "page_id", "weight", target), _heavy(weighed, target))
    asked = revisits.select("page_id", F.lit(0).alias("kind"), "digest", "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload")).distinct()
    told = rows.select("page_id", F.lit(1).alias("kind"), "digest", F.lit(None).cast("long").alias("refers_to"), "url", "payload")
    placed = _with_shard(asked.unionByName(told), shards)
    dealt = placed.repartition(shards.count, "place").sortWithinPartitions("shard", "kind", "page_id", "digest", "url")
    _make_folder(spark, f"{folder}/{TEMPORARY}")
    manifest = stage(dealt.mapInArrow(_write_shards(folder, roll), MANIFEST), "warc-files")  # the attempts that count
    drop(facts), drop(kept)
    return commit(spark, folder, manifest)


def _heavy(weighed: DataFrame, target: int) -> list[tuple[int | None, int]]:
    """(id, shards) of the ids, null among them, of several rows too heavy for one shard; there are at most total / target."""
    found = weighed.groupBy("page_id").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).where((F.col("w") > target) & (F.col("n") > 1)).collect()
    return sorted(((r["page_id"], min(r["n"], -(-r["w"] // target))) for r in found), key=lambda x: (x[0] is not None, x[0] or 0))


class Shards:
    """Numbers of shards: by the borders that ids lie between, and within a heavy id by the digest."""

    def __init__(self, borders: list[int], heavy: list[tuple[int | None, int]]):
        self.ends = np.array(borders, np.int64)
        self.none = next((n for i, n in heavy if i is None), 1)
        self.ids = np.array([i for i, _ in heavy if i is not None], np.int64)
        self.parts = np.array([n for i, n in heavy if i is not None], np.int64)
        # shards of an id take the place of the one that it lies in
        at = np.searchsorted(self.ends, self.ids)
        extra = np.zeros(len(self.ends) + 1, np.int64)
        np.add.at(extra, at, self.parts)
        self.first = self.none + np.arange(len(self.ends) + 1) + np.cumsum(extra) - extra
        before = np.cumsum(self.parts) - self.parts
        self.heavy_first = self.none + at + 1 + before
        self.count = int(self.none + len(self.ends) + 1 + self.parts.sum())

    def of(self, ids: pa.Array, digests: pa.Array) -> np.ndarray:
        plain = ids.fill_null(0).to_numpy(zero_copy_only=False)
        none = ids.is_null().to_numpy(zero_copy_only=False)
        out = self.first[np.searchsorted(self.ends, plain)]
        share = np.array([int(d[:13], 16) for d in digests.to_pylist()], np.int64) if len(self.ids) or self.none > 1 else np.zeros(len(ids), np.int64)
        if len(self.ids):
            k = np.minimum(np.searchsorted(self.ids, plain), len(self.ids) - 1)
            hit = self.ids[k] == plain
            out = np.where(hit, self.heavy_first[k] + share * self.parts[k] // (1 << 52) if self.parts.max() < 1 << 11 else self.heavy_first[k] + share % self.parts[k], out)
        return np.where(none, share % self.none, out)


def _with_shard(rows: DataFrame, shards: Shards) -> DataFrame:
    """rows with their shard; what every task gets is at most some MAX_SHARDS numbers.

    place is a number for each shard that hash partitioning sends to a partition of its own.
    """
    places = own_partitions(rows.sparkSession, shards.count)

    def run(batches):
        for b in batches:
            at = shards.of(b.column(b.schema.get_field_index("page_id")), b.column(b.schema.get_field_index("digest")))
            yield b.append_column("shard", pa.array(at.astype(np.int32))).append_column("place", pa.array(places[at]))

    return rows.mapInArrow(run, widened(rows, "shard int, place int"))


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _make_folder(spark: SparkSession, folder: str) -> None:
    where, p = _hadoop(spark, folder)
    where.mkdirs(p)


class Manifest:
    """The files of an archive: a table, and rows in order of name, of which the driver holds some at a time."""

    def __init__(self, files: DataFrame):
        self.files = files

    def __iter__(self):
        for r in self.files.orderBy("name").toLocalIterator():
            yield r.asDict()

    def __getitem__(self, at: int) -> dict:
        return next(islice(self, at, None))


def _move(where, source: str, target: str) -> None:
    """Rename; a task that does so again finds the work done."""
    from pyarrow import fs

    if where.get_file_info(source).type == fs.FileType.NotFound and where.get_file_info(target).type == fs.FileType.File:
        return
    where.move(source, target)


def _renamed(folder: str):
    def run(batches):
        where, root = _filesystem(folder)
        for b in batches:
            for r in b.to_pylist():
                _move(where, f"{root}/{r['temporary']}", f"{root}/{r['name']}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    return run


def _listed(folder: str):
    def run(batches):
        where, root = _filesystem(folder)
        context, n = TaskContext.get(), 0
        hidden = f"{root}/{TEMPORARY}/manifest-{context.stageId()}-{context.taskAttemptId()}"
        with where.open_output_stream(hidden, compression=None) as out:
            out.write(b"[")
            for b in batches:
                for r in b.to_pylist():
                    out.write((",\n" if n else "\n").encode() + json.dumps({k: r[k] for k in ("name", "records", "bytes", "sha256")}).encode())
                    n += 1
            out.write(b"\n]\n")
        where.move(hidden, f"{root}/{MANIFEST_NAME}")
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return run


def commit(spark: SparkSession, folder: str, manifest: DataFrame) -> Manifest:
    """Rename the files of the attempts that count, by tasks, then publish the manifest, then drop what lost attempts have left."""
    n = manifest.count()
    named = manifest.repartition(max(1, min(1_000, n // 64))).mapInArrow(_renamed(folder), "n long")
    if (named.agg(F.sum("n")).first()[0] or 0) != n:
        raise OSError(f"cannot publish all files in {folder}")
    # one task for the rows of the manifest, which is a small part of what it lists
    manifest.coalesce(1).sortWithinPartitions("name").mapInArrow(_listed(folder), "n long").collect()
    where, p = _hadoop(spark, f"{folder}/{TEMPORARY}")
    where.delete(p, True)
    return Manifest(manifest)


def members(archive):
    """The records of an archive, each from its own gzip member.  archive: its bytes, or a function of n that gives up to n next ones."""
    read, left = io.BytesIO(archive).read if isinstance(archive, bytes | bytearray) else archive, b""
    while left or (left := read(1 << 16)):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            piece = left or read(1 << 16)
            if not piece:
                raise ValueError("the archive ends within a record")
            parts.append(unpacker.decompress(piece))
            left = unpacker.unused_data
        yield b"".join(parts)


def parse_record(data: bytes) -> dict:
    """Fields of one record; digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{_base32(hashlib.sha1(block).hexdigest())}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not hold")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not hold")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "payload": payload if response else None}


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, records, bytes, sha256) of the files of an archive; an error if none was published."""
    where, p = _hadoop(spark, folder)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, MANIFEST_NAME)
    if not where.exists(at):
        raise FileNotFoundError(f"{folder} has no manifest: nothing was committed there")
    return spark.read.schema("name string, records long, bytes long, sha256 string").option("multiLine", "true").json(at.toString())


def _sound(name: str, records):
    """records, whose failure names the file."""
    try:
        yield from records
    except (zlib.error, ValueError) as e:
        raise ValueError(f"{name} is not the file of the manifest: {e}") from e


def _records(folder: str, payloads: bool):
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        where, root = _filesystem(folder)
        for b in batches:
            for m in b.to_pylist():
                held, size, count, told, total = [], 0, 0, hashlib.sha256(), 0
                with where.open_input_stream(f"{root}/{m['name']}", compression=None) as file:

                    def read(n):
                        nonlocal total
                        piece = file.read(n)  # noqa: B023
                        told.update(piece)  # noqa: B023
                        total += len(piece)
                        return piece

                    for record_bytes in _sound(m["name"], members(read)):
                        r = parse_record(record_bytes)
                        count += 1
                        size += len(record_bytes) if payloads else 200
                        held.append(r if payloads else r | {"payload": None})
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, kind)
                            held, size = [], 0
                if told.hexdigest() != m["sha256"] or total != m["bytes"]:
                    raise ValueError(f"{m['name']} is not the file of the manifest")
                if count != m["records"]:
                    raise ValueError(f"{m['name']} has {count} records, not {m['records']}")
                yield pa.RecordBatch.from_pylist(held, kind)

    return run


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of all archives of the manifest in folder, as RECORD; payload stays null unless asked for.

    A missing file, one whose bytes or number of records are not those of the manifest,
    and a record whose digests do not hold are errors; files that the manifest does not
    have are not read.  An empty manifest gives an empty table.  Files are streamed, one
    at a time in each task.
    """
    files = read_manifest(spark, folder)
    total = files.agg(F.sum("bytes")).first()[0] or 0
    dealt = files.repartitionByRange(max(1, -(-total // READ_BYTES)), "name")
    return dealt.mapInArrow(_records(folder, payloads), RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to a new folder of the shared scratch and read the archives back, as RECORD.

    One row for each page, repeated ones too; nulls and ties as in write, and an empty
    table gives an empty result.
    """
    folder = new_path(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder)
