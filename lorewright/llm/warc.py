"""A deterministic sharded WARC writer, and the reader of what it wrote.

Records are dealt into shards by range of page_id and sorted there. Ranges come from a histogram of fixed width (HISTOGRAM
bins reach the driver, whatever the input), so the same rows give the same files. A task streams its shard into archives of
one gzip member a record, rolled by compressed size. Archives are written under temporary names that hold the attempt;
the manifest of the attempts that succeeded is a written table, and a second job renames what it lists. Readers go by the
manifest, so what failed attempts left is never read.

Executors open the folder with pyarrow's file systems: file, s3, gs, hdfs and abfs paths work.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.llm.shared import new_folder, written

#: Payloads of so many bytes and more are written once.
LEAST_REVISITED = 1000
#: Payload bytes of a shard, compressed bytes at which an archive is closed, bins of the histogram.
SHARD_BYTES, ROLL_BYTES, HISTOGRAM = 32 << 20, 16 << 20, 4096
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6f9b1d52-0c1e-5d0a-9a53-2d6b8a7c4e10")
MANIFEST = "name string, temporary string, records long, bytes long, sha1 string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id} {digest}')}>"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    sha1 = hashlib.sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, sha1.hexdigest())), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]|")))
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, sha1.hexdigest())), ("WARC-Refers-To-Page-ID", str(refers_to))]
    fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1.digest()).decode()), ("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _written(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pfs.FileSystem.from_uri(folder)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        done: list[tuple] = []
        shard, part, out, size, records, sha1 = None, 0, None, 0, 0, None

        def put(data: bytes) -> None:
            nonlocal size
            out.write(data)
            sha1.update(data)
            size += len(data)

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{names[0]}.warc.gz", names[1], records, size, sha1.hexdigest()))
                out = None

        names = ("", "")
        pending: dict[str, int] = {}
        last = None
        for batch in batches:
            for s, page_id, digest, tag, refers_to, url, html in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "digest", "tag", "refers_to", "url", "html")), strict=True):
                if (s, page_id) != last:
                    last, pending = (s, page_id), {}
                if tag == 0:
                    pending[digest] = refers_to
                    continue
                if s != shard or size >= roll:
                    close()
                    shard, part = s, part + 1 if s == shard else 0
                if out is None:
                    names, size, records, sha1 = (f"shard-{shard:06d}-{part:05d}", f"_temporary-{shard:06d}-{part:05d}-{attempt}"), 0, 0, hashlib.sha1()
                    out = files.open_output_stream(f"{root}/{names[1]}")
                    info = b"software: lorewright\r\nformat: WARC File Format 1.1\r\n"
                    put(_member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id(None, names[0])}\r\nWARC-Date: {DATE}\r\nWARC-Filename: {names[0]}.warc.gz\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
                put(_member(_record(page_id, url, (html or "").encode(), pending.get(digest), digest in pending)))
                records += 1
        close()
        columns = list(zip(*done, strict=True)) if done else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

    return run


def _renamed(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pfs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, temporary in zip(batch.column("name").to_pylist(), batch.column("temporary").to_pylist(), strict=True):
                if files.get_file_info(f"{root}/{temporary}").type != pfs.FileType.NotFound:
                    files.move(f"{root}/{temporary}", f"{root}/{name}")
                elif files.get_file_info(f"{root}/{name}").type == pfs.FileType.NotFound:
                    raise FileNotFoundError(f"{folder}/{name}")
            yield batch

    return run


def _by_shard(manifest: DataFrame) -> DataFrame:
    """The manifest dealt by the shard in its names, a task a shard; a count of partitions that is given isn't coalesced."""
    shard = F.substring("name", 7, 6).cast("int")
    last = manifest.agg(F.max(shard)).first()[0]
    return manifest.repartitionById((last or 0) + 1, shard)


def _shards(thin: DataFrame, shard_bytes: int) -> tuple[Column, int]:
    """The shard of a row by page_id and, where one bin holds more than a shard, by digest; and how many there are. A null
    page_id sorts first."""
    low, high = thin.agg(F.min("page_id"), F.max("page_id")).first()
    low, high = low or 0, high or 0
    width = max(1.0, (float(high) - float(low) + 1) / (HISTOGRAM - 1))
    at = F.coalesce(1 + F.least(F.floor((F.col("page_id").cast("double") - float(low)) / width), F.lit(HISTOGRAM - 2)), F.lit(0)).cast("int")
    bins = {r[0]: r[1] for r in thin.groupBy(at.alias("bin")).agg(F.sum("payload_bytes")).collect()}  # HISTOGRAM rows at most
    first, parts, shard, held = [], [], 0, 0
    for k in range(HISTOGRAM):
        own = bins.get(k, 0)
        if held and held + own > shard_bytes:
            shard, held = shard + 1, 0
        first.append(shard)
        parts.append(max(1, -(-own // shard_bytes)))
        if parts[-1] > 1:
            shard, held = shard + parts[-1], 0
        else:
            held += own
    spelled = lambda xs: F.expr(f"array({','.join(map(str, xs))})")
    return F.get(spelled(first), at) + F.pmod(F.hash("digest"), F.get(spelled(parts), at)), shard + 1


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write pages (page_id long, url string, html string; other columns are left) to folder; gives the manifest (name,
    temporary, records, bytes, sha1), one row an archive.

    A null html is an empty payload. Of records with equal payloads of LEAST_REVISITED bytes or more, those of the largest
    page_id are responses and the others revisit it; where every page_id of them is null, all are responses. A null page_id
    or url has no header. An empty table writes no archive.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    facts = pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes"), "url", "html")
    thin = written(facts.drop("url", "html"), "payloads")
    top = thin.where(F.col("payload_bytes") >= LEAST_REVISITED).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    again = thin.join(top, ["digest", "payload_bytes"]).where("page_id is null or page_id < refers_to").select("page_id", "digest", F.lit(0).alias("tag"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")).distinct()
    shard, count = _shards(thin, shard_bytes)
    rows = facts.select("page_id", "digest", F.lit(1).alias("tag"), F.lit(None).cast("long").alias("refers_to"), "url", "html").unionAll(again).withColumn("shard", shard)
    files, root = pfs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    dealt = rows.repartitionById(count, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "tag")
    staged = written(dealt.mapInArrow(_written(folder, roll_bytes), MANIFEST), "manifest")
    manifest = _by_shard(staged).mapInArrow(_renamed(folder), MANIFEST)
    manifest.write.parquet(f"{folder.rstrip('/')}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/_manifest")


def _members(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member."""
    offset, at, packer, data, rest = 0, 0, zlib.decompressobj(31), [], b""
    while chunk := rest or stream.read(1 << 20):
        data.append(packer.decompress(chunk))
        rest = packer.unused_data
        at += len(chunk) - len(rest)
        if packer.eof:
            yield offset, b"".join(data)
            offset, packer, data = at, zlib.decompressobj(31), []
    if data:
        raise ValueError("the archive ends within a record")


def _parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pfs.FileSystem.from_uri(folder)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows: list[tuple] = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for offset, record in _members(stream):
                        fields, block = _parsed(record)
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        if _digest(block) != fields["WARC-Block-Digest"]:
                            raise ValueError(f"{name} at {offset}: the block does not match its digest")
                        head, _, payload = block.partition(b"\r\n\r\n")
                        sha1 = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                        if fields["WARC-Type"] == "response":
                            sha1, size = hashlib.sha1(payload).hexdigest(), len(payload)
                        number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                        rows.append((number("WARC-Page-ID"), size, sha1, fields["WARC-Type"], number("WARC-Refers-To-Page-ID"), fields.get("WARC-Target-URI"), name, offset))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in READ.split(", ")])

    return run


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives of a manifest, digests and lengths taken from what was read: page_id, payload_bytes,
    payload_digest, record_type, refers_to, url (percent-encoded), archive, offset."""
    return _by_shard(manifest.select("name")).mapInArrow(_read(folder), READ)


def round_trip(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """Write pages to a fresh folder of the shared one, and read the archives."""
    folder = new_folder(spark, "warc")
    return read(write(pages, folder), folder)
