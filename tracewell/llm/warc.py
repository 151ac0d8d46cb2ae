"""WARC archives written in parallel, the same bytes for the same pages.

Pages are dealt by ranges of their id whose bounds depend on the rows alone, sorted
within each range, and written as one gzip member per record. A file is closed and
the next begun once its compressed size reaches a limit. Headers and digests are
made anew from the payload. Of pages with equal payloads the smallest id is the
response and the others are revisits that name it. Files are committed as
`files.py` says.

A null html is an empty payload and a null url `about:blank`. Null ids come first,
and refer to the smallest id of an equal payload if there is one. Of rows with
equal id and payload the first is what its id says and the others revisit that id.
An empty table gives no files and no rows. Further columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.batches import Batches, map_batches
from tracewell.llm.files import FILE_COLUMNS, ShardFile, one_file_per_task, opened, publish
from tracewell.llm.ranges import range_bounds, range_of
from tracewell.sources.workspace import fresh_path

#: Bytes of payload in a range of ids, and compressed bytes after which a file is closed.
SHARD_BYTES, ROLL_BYTES = 16 << 20, 4 << 20
#: Pages with fewer bytes are never revisits.
REVISIT_BYTES = 0
DATE = "2026-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 20

_RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
    ]
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def target_uri(url: str | None) -> str:
    """The url without signs that would end the header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() if revisit else http.encode() + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest + ("-revisit" if revisit else "")),
        "WARC-Date": DATE,
        "WARC-Target-URI": target_uri(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1_base32(block)}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(block),
    }
    if page_id is not None:
        headers["X-Page-ID"] = page_id
    if revisit:
        headers |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": record_id(refers_to, digest)}
        if refers_to is not None:
            headers["X-Refers-To-Page-ID"] = refers_to
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    return packer.compress(data) + packer.flush()


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, sha1, first) of pages whose payload a page with a smaller id has too."""
    digests = pages.where(F.octet_length("html") >= least).select("page_id", F.sha1("html").alias("sha1"))
    firsts = digests.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = firsts.where("n > 1 AND first IS NOT NULL").select("sha1", "first")
    return digests.join(shared, "sha1").where("page_id IS NULL OR page_id > first").select("page_id", "sha1", "first")


def write_warc(
    df: DataFrame,
    root: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
    revisit_bytes: int = REVISIT_BYTES,
) -> DataFrame:
    """Write a record per row to archives below `root`; the manifest of the files."""
    pages = df.select(
        F.col(key).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"),
    )
    bounds = range_bounds(pages, F.col("page_id"), F.octet_length("html"), shard_bytes)
    # What a page refers to travels as a row of its own that sorts before the page, so
    # pages are shuffled once and joined with nothing.
    marks = revisits(pages, revisit_bytes).selectExpr(
        "page_id", "CAST(NULL AS STRING) AS url", "CAST(NULL AS STRING) AS html", "sha1", "first"
    )
    rows = pages.withColumns({"sha1": F.lit(None).cast("string"), "first": F.lit(None).cast("long")}).unionByName(marks)
    rows = rows.withColumn("shard", range_of(F.col("page_id"), bounds))
    dealt = rows.repartitionById(len(bounds), "shard").sortWithinPartitions(
        "shard", "page_id", F.col("html").isNotNull(), "html", "url"
    )

    def write(batches: Batches) -> Batches:
        file = shard = here = None
        first_of, seen = {}, set()
        for batch in batches:
            for row in batch.to_pylist():
                if (row["shard"], row["page_id"]) != here:
                    here, first_of, seen = (row["shard"], row["page_id"]), {}, set()
                if row["html"] is None:
                    first_of[row["sha1"]] = row["first"]
                    continue
                if row["shard"] != shard:
                    if file:
                        yield file.close()
                    shard, file = row["shard"], ShardFile(root, row["shard"], 0, "warc.gz")
                elif file.bytes >= roll_bytes:
                    yield file.close()
                    file = ShardFile(root, shard, file.number + 1, "warc.gz")
                payload = row["html"].encode()
                sha1 = hashlib.sha1(payload).hexdigest()
                first = first_of.get(sha1, row["page_id"])
                revisit = sha1 in first_of or (sha1 in seen and len(payload) >= revisit_bytes)
                seen.add(sha1)
                data = record(row["page_id"], row["url"], payload, first if revisit else None, revisit)
                file.write(data)
                file.count(row["page_id"], len(payload))
        if file:
            yield file.close()

    return publish(map_batches(dealt, write, FILE_COLUMNS), root)


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpacker, parts = zlib.decompressobj(31), []
    data = stream.read(_READ)
    while data:
        parts.append(unpacker.decompress(data))
        if unpacker.eof:
            yield b"".join(parts)
            data = unpacker.unused_data or stream.read(_READ)
            unpacker, parts = zlib.decompressobj(31), []
        else:
            data = stream.read(_READ)
    if any(parts):
        raise ValueError("the archive ends within a record")


def parsed(data: bytes) -> dict:
    """What a record says of its page, with digests and lengths tried on its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = fields["WARC-Type"] == "response"
    if (
        rest[len(block) :] != b"\r\n\r\n"
        or fields["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}"
        or (whole and (len(payload) != size or sha1_base32(payload) != digest))
    ):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    number = {name: fields.get(name) and int(fields[name]) for name in ("X-Page-ID", "X-Refers-To-Page-ID")}
    return {
        "page_id": number["X-Page-ID"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number["X-Refers-To-Page-ID"],
        "url": fields["WARC-Target-URI"],
    }


def read_warc(files: DataFrame, root: str) -> DataFrame:
    """A row per record of the archives in a manifest."""

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                with opened(root, name) as file:
                    for data in members(file):
                        rows.append(parsed(data))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, _RECORDS)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, _RECORDS)

    return map_batches(
        one_file_per_task(files),
        read,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string",
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "warc")
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return read_warc(files, root).drop("url")
