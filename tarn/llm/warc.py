"""WARC archives: a writer that revisits equal payloads, and a splittable reader.

The writer makes one archive per task, each record a gzip member of its own.
The reader needs no index: its tasks take byte ranges, scan them for gzip
magic, accept a candidate only if it inflates to a WARC header, and own the
records that start inside their range, reading past its end for the last one.

A null payload counts as empty.  Of equal payloads of at least ``least`` bytes
the one with the smallest page_id is a response, the others revisit it; rows
that repeat a page_id are all responses if that page_id is the smallest of its
payload.  A null page_id is written as a response without digest lookup.  An
empty table writes no archive and reads back empty; further columns of the
input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import _store

#: Bytes of an archive that one read task takes.
SPLIT = 8 << 20
#: Bytes that a read task fetches at once.
FETCH = 1 << 20
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.UUID("6c1e4b57-9d5a-4f0e-8a51-000000000000").int


def record_id(page_id: int | None) -> str:
    """A record's URI; the page_id is its last 64 bits."""
    return f"<urn:uuid:{uuid.UUID(int=_IDS >> 64 << 64 | (page_id & (1 << 64) - 1))}>" if page_id is not None else f"<urn:uuid:{uuid.UUID(int=0)}>"


def page_of(record: str) -> int | None:
    value = uuid.UUID(record[10:-1]).int
    if value == 0:
        return None
    low = value & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record that has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    target = "".join(c for c in (url or "") if c.isprintable())
    fields = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
        *([("WARC-Target-URI", target)] if target else []), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        *([("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT)] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(raw: bytes) -> dict:
    """Fields, HTTP head and payload of an inflated record; ValueError if it isn't one or its digest is wrong."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if fields["warc-type"] == "response" and fields.get("warc-payload-digest") not in (None, f"sha1:{digest(payload)}"):
        raise ValueError(f"payload digest of {fields['warc-record-id']} is wrong")
    return {"fields": fields, "payload": payload, "payload_bytes": sizes[0] if sizes else len(payload)}


def assign(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: the smallest page_id with an equal payload, null for responses.

    Digests meet, not payloads: the smallest page_id of each digest is found
    with partial sums, and the join of the few repeated digests is one that
    Spark can split at a hot digest.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.when((F.octet_length("html") >= least) & F.col("page_id").isNotNull(), F.sha1(F.col("html").cast("binary"))))
    firsts = rows.where("sha IS NOT NULL").groupBy(F.col("sha").alias("of_sha")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = _store.written(firsts, "warc-firsts")
    joined = rows.join(firsts, F.col("sha") == F.col("of_sha"), "left")
    return joined.select("page_id", "url", "html", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, directory: str, least: int = 0) -> DataFrame:
    """Writes the archives; the manifest: path and bytes of each, committed by Spark."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at, out, size, path = None, "", None, 0, ""
        for batch in batches:
            for i in range(len(batch)):
                page_id, url, html, refers_to = (c[i].as_py() for c in batch.columns)
                if out is None:
                    path = f"{directory}/pages-{uuid.uuid4().hex}.warc.gz"
                    where, at = _store.opened(path)
                    where.create_dir(at.rpartition("/")[0], recursive=True)
                    out = where.open_output_stream(at, compression=None)
                out.write(member := record(page_id, url, html.encode(), refers_to))
                size += len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], ["path", "size"])

    return _store.written(assign(pages, least).mapInArrow(written, "path string, size long"), "warc-manifest")


def members(path: str, start: int, end: int, fetch: int = FETCH) -> Iterator[tuple[int, bytes]]:
    """Offset and inflated bytes of the members that start in a byte range and hold a WARC record."""
    where, at = _store.opened(path)
    with where.open_input_file(at) as f:
        size = f.size()
        base, held = start, b""

        def more() -> bool:
            nonlocal held
            if base + len(held) >= size:
                return False
            held += f.read_at(min(fetch, size - base - len(held)), base + len(held))
            return True

        pos = 0
        while base + pos < min(end, size):
            k = held.find(MAGIC, pos)
            if k < 0:
                pos = max(pos, len(held) - len(MAGIC) + 1)  # magic may straddle the next bytes
                held, base, pos = held[pos:], base + pos, 0
                if not more():
                    return
                continue
            if base + k >= end:
                return
            inflate, out, at_byte = zlib.decompressobj(31), [], k
            good = False
            try:
                while not inflate.eof:
                    if at_byte >= len(held) and not more():
                        break
                    out.append(inflate.decompress(held[at_byte : at_byte + fetch]))
                    at_byte = min(at_byte + fetch, len(held))
                    if not good and (head := b"".join(out))[:5] != b"WARC/"[: len(head)]:
                        break
                    good = good or len(head) >= 5
            except zlib.error:
                good = False
            if good and inflate.eof:
                yield base + k, b"".join(out)
                held, base, pos = held[at_byte - len(inflate.unused_data) :], base + at_byte - len(inflate.unused_data), 0
            else:
                pos = k + 1


def splits(manifest: DataFrame, split: int = SPLIT) -> DataFrame:
    """path, start, end of the byte ranges of all archives."""
    rows = manifest.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    rows = rows.select("path", "start", F.least(F.col("start") + split, F.col("size")).alias("end"))
    return rows.repartition(_store.partitions(manifest.sparkSession), "path", "start")


def read(manifest: DataFrame, split: int = SPLIT, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to (and url, payload)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                found, held = [], 0
                for _, raw in members(path, start, end):
                    found.append(parse(raw))
                    held += len(raw)
                    if held > FETCH * 8:
                        yield table(found)
                        found, held = [], 0
                if found:
                    yield table(found)

    def table(found: list[dict]) -> pa.RecordBatch:
        refers = [page_of(x["fields"]["warc-refers-to"]) if "warc-refers-to" in x["fields"] else None for x in found]
        columns = {
            "page_id": pa.array([page_of(x["fields"]["warc-record-id"]) for x in found], pa.int64()),
            "payload_bytes": pa.array([x["payload_bytes"] for x in found], pa.int64()),
            "payload_digest": pa.array([x["fields"]["warc-payload-digest"].removeprefix("sha1:") for x in found], pa.string()),
            "record_type": pa.array([x["fields"]["warc-type"] for x in found], pa.string()),
            "refers_to": pa.array(refers, pa.int64()),
        }
        if with_payload:
            columns["url"] = pa.array([x["fields"].get("warc-target-uri") for x in found], pa.string())
            columns["payload"] = pa.array([x["payload"] for x in found], pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload
    return splits(manifest, split).mapInArrow(rows, schema)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes every page and reads the archives back."""
    return read(write(pages, _store.shared(spark, "warc"), least))
