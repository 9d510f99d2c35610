"""WARC archives: write, index first, then coalesced byte-range reads.

Writing deals the pages over tasks; each task appends gzip members (one per
record) to archives of bounded size and returns one index row per record:
file, offset, length, URL and digest.  Reading selects index rows with any
DataFrame filter, deals them by (file, block), sorts them by offset, joins
neighbouring ranges into one read and parses only the selected records.

Of records with equal payloads of at least ``min_bytes`` bytes, those with the
smallest id are responses, the others revisits that refer to it.

Defined cases: a null payload is empty; a null URL becomes ``urn:page:<id>``;
a null id is never referred to and its record is always a response; equal
payloads repeated with the same smallest id are all responses; an empty table
writes no archive and reads back no row; columns other than the three named
ones are not read, so their names cannot clash.
"""

from __future__ import annotations

import gzip
import hashlib
import os
import re
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm.common import note_written, store
from wearline.session import scratch_path

INDEX_SCHEMA = (
    "page_id long, url string, payload_digest string, payload_bytes long, "
    "record_type string, refers_to long, file string, offset long, length long"
)
READ_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, stored_bytes long, payload binary"
)
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def decide_types(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int, salts: int = 16) -> DataFrame:
    """Payload, digest and record type of each page; one narrow join on the digest.

    The smallest id per digest is aggregated map-side first.  Only digests that
    occur twice or more come back, copied over ``salts`` so that one payload on
    a third of all pages is spread over that many tasks.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    rows = rows.withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"),
        "payload_digest": F.sha2("payload", 256),
        "_salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)),
    })
    first = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") > 1) & F.col("_first").isNotNull())
        .select("payload_digest", "_first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("_salt"))
    )
    revisit = F.col("_first").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("_first"))
    return rows.join(first, ["payload_digest", "_salt"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def _target(page_id, url) -> str:
    if url is None:
        return f"urn:page:{page_id}"
    return _UNSAFE.sub(lambda m: quote(m[0]), url)


def record_id(page_id, payload_digest: str) -> str:
    """Id of a page's record: the same whenever and wherever it is written, so that revisits can name it."""
    return uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}:{payload_digest}").urn


def record(row: dict) -> bytes:
    """One WARC/1.1 record: response with the payload, or revisit without it."""
    page_id, body = row["page_id"], row["payload"] if row["record_type"] == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{record_id(page_id, row['payload_digest'])}>",
        f"WARC-Target-URI: {_target(page_id, row['url'])}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if row["url"] is None:
        head.append("X-No-Url: 1")
    elif _UNSAFE.search(row["url"]):
        head.append(f"X-Url: {quote(row['url'])}")
    if row["record_type"] == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{record_id(row['refers_to'], row['payload_digest'])}>")
        head.append(f"X-Refers-To-Page: {row['refers_to']}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Read back what ``record`` wrote."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Target-URI']} doesn't have its digest")
    return {
        "page_id": int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None,
        "url": None if "X-No-Url" in fields else unquote(fields["X-Url"]) if "X-Url" in fields else fields["WARC-Target-URI"],
        "payload_bytes": len(body) if kind == "response" else int(fields["X-Payload-Length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(fields["X-Refers-To-Page"]) if "X-Refers-To-Page" in fields else None,
        "stored_bytes": len(body),
        "payload": body if kind == "response" else None,
    }


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{os.path.abspath(uri)}")


def _writer(folder: str, archive_bytes: int):
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ])

    def write(batches):
        system, top = _filesystem(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for lo in range(0, batch.num_rows, 256):
                    for row in batch.slice(lo, 256).to_pylist():
                        if out is not None and at >= archive_bytes:
                            out.close()
                            out = None
                        if out is None:
                            # a retried task writes new names; only rows of the committed index count
                            name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                            out = system.open_output_stream(f"{top}/{name}", compression=None)
                        member = gzip.compress(record(row), 4, mtime=0)
                        out.write(member)
                        row.pop("payload")
                        index.append(row | {"file": name, "offset": at, "length": len(member)})
                        at += len(member)
                yield pa.RecordBatch.from_pylist(index, schema)
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 100, archive_bytes: int = 1 << 30) -> DataFrame:
    """Write the pages as archives under ``folder``; return the stored index."""
    rows = decide_types(pages, id_col, url_col, html_col, min_bytes)
    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
    index = rows.mapInArrow(_writer(folder, archive_bytes), INDEX_SCHEMA)
    return store(index, "warc-index")


def _reader(folder: str, gap: int, read_bytes: int, with_payload: bool):
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("stored_bytes", pa.int64()), ("payload", pa.binary()),
    ])

    def read_run(system, top, run):
        name, begin = run[0][0], run[0][1]
        with system.open_input_file(f"{top}/{name}") as f:
            f.seek(begin)
            data = f.read(run[-1][1] + run[-1][2] - begin)
        for _, offset, length in run:
            yield parse(zlib.decompress(data[offset - begin : offset - begin + length], 31))

    def read(batches):
        system, top = _filesystem(folder)
        for batch in batches:
            spans = zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)
            runs: list[list] = []
            for span in spans:
                last = runs[-1] if runs else None
                near = last and last[-1][0] == span[0] and 0 <= span[1] - last[-1][1] - last[-1][2] <= gap
                if near and span[1] + span[2] - last[0][1] <= read_bytes:
                    last.append(span)
                else:
                    runs.append([span])
            for run in runs:
                rows = list(read_run(system, top, run))
                if not with_payload:
                    rows = [r | {"payload": None} for r in rows]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_records(selected: DataFrame, folder: str, block_bytes: int = 8 << 20, gap: int = 64 << 10, with_payload: bool = True) -> DataFrame:
    """Read the selected index rows back.

    Rows are dealt by (file, block of ``block_bytes``) and sorted by offset, so
    that a task reads ascending, mostly adjacent ranges; ranges up to ``gap``
    bytes apart are one read of at most ``block_bytes``.
    """
    block = F.floor(F.col("offset") / F.lit(block_bytes))
    sorted_ranges = (
        selected.select("file", "offset", "length")
        .withColumn("_block", block)
        .repartition("file", "_block")
        .sortWithinPartitions("file", "offset")
        .drop("_block")
    )
    return sorted_ranges.mapInArrow(_reader(folder, gap, block_bytes, with_payload), READ_SCHEMA)


def read_payloads(selected: DataFrame, index: DataFrame, folder: str, **reading) -> DataFrame:
    """The selected index rows with their payloads, those of revisits from the response they refer to.

    Each response that a selected revisit needs is read once and joined on its
    digest; a payload that many revisits share is spread by adaptive execution.
    """
    read = read_records(selected, folder, **reading)
    wanted = selected.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    responses = index.where("record_type = 'response'").join(wanted, ["page_id", "payload_digest"], "left_semi").dropDuplicates(["payload_digest"])
    bodies = read_records(responses, folder, **reading).select("payload_digest", F.col("payload").alias("_body"))
    own, found = read.where("record_type = 'response'"), read.where("record_type = 'revisit'").join(bodies, "payload_digest", "left")
    return own.unionByName(found.withColumn("payload", F.col("_body")).drop("_body"))


def archive_round_trip(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """Write all pages to a new shared folder and read all records back."""
    folder = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    note_written(folder)
    index = write_archives(pages, folder)
    return read_records(index, folder, with_payload=False).drop("payload", "url")
