"""WARC archives: records written with an index, and read back by coalesced byte ranges.

Each task writes its pages as gzip members, one for each record, to archive files of its own in the shared folder and returns the
index: archive, offset, length, URL and digest of every record. The index is the commit: it is saved through Spark's writer, so a task
that runs twice leaves at most a file that no index row names. A read selects index rows, sorts them by archive and offset,
joins neighbours that lie at most ``gap`` bytes apart into reads of at most ``read_bytes``, and checks every payload against its digest.

Records of equal payloads of at least ``min_bytes`` bytes: the one with the largest page_id is a response, the others are
revisits, which hold no payload but its length and digest and refer to that response. Smaller payloads are always responses.
Repeated rows of that page_id are all responses. A null html is an empty payload; a null page_id revisits if any
equal payload has an id. A null URL leaves out its header; line breaks in a URL are escaped. One record for each page row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from cohortlab.llm.batches import sliced
from cohortlab.llm.store import measured, written
from cohortlab.session import scratch_path

MIN_BYTES = 0
GAP = 64 << 10
READ_BYTES = 8 << 20
ARCHIVE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
INDEX = "archive string, offset bigint, length bigint, url string, digest string, page_id bigint"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record: a response with its payload, or a revisit if ``refers_to`` is set."""
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>".encode(), f"WARC-Date: {DATE}".encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode())
    head += [b"WARC-Payload-Digest: sha1:" + digest.encode(), f"X-Payload-Length: {len(payload)}".encode()]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        block += payload
    else:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>".encode()]
    head += [b"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; the payload of a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and "sha1:" + base32_sha1(payload) != fields["WARC-Payload-Digest"]:
        raise ValueError(f"digest of {fields['WARC-Record-ID']} differs")
    return fields, payload


def with_response(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html as bytes, and refers_to: the page whose record holds an equal payload, null for responses."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("_key", F.when(F.octet_length("payload") >= min_bytes, F.sha2("payload", 256)))
    groups = rows.filter("_key IS NOT NULL").groupBy("_key").agg(F.max("page_id").alias("_response"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = rows.join(measured(written(groups, "payloads")[0], "_key"), "_key", "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("_response")), F.col("_response")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page to archives below ``folder`` (a URI all executors share) and return the saved index."""

    def run(batches):
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top)
        file, name, at = None, "", 0
        try:
            for batch in sliced(batches, "payload"):
                index: list[list] = [[] for _ in range(6)]
                for page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    if file is None or at >= archive_bytes:
                        if file is not None:
                            file.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        file = store.open_output_stream(f"{top}/{name}", compression=None)
                    digest = base32_sha1(payload)
                    data = member(record(page_id, url, payload, digest, refers_to))
                    file.write(data)
                    for column, value in zip(index, (name, at, len(data), url, digest, page_id), strict=True):
                        column.append(value)
                    at += len(data)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(index, kinds, strict=True)], ["archive", "offset", "length", "url", "digest", "page_id"])
        finally:
            if file is not None:
                file.close()

    return written(with_response(pages, min_bytes).mapInArrow(run, INDEX), "index")[0]


def ranges(places: list[tuple[str, int, int]], gap: int, read_bytes: int):
    """Group sorted (archive, offset, length) places: (archive, from, to, first place, last place + 1) of each read."""
    start = 0
    for k in range(1, len(places) + 1):
        archive, low, _ = places[start]
        last = places[k - 1]
        if k < len(places):
            name, offset, length = places[k]
            if name == archive and offset - (last[1] + last[2]) <= gap and offset + length - low <= read_bytes:
                continue
        yield archive, low, last[1] + last[2], start, k
        start = k


def read_records(index: DataFrame, folder: str, gap: int = GAP, read_bytes: int = READ_BYTES) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits) of the records that ``index`` names."""
    shape = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    number = lambda text: int(text) if (text := text.removeprefix("<urn:page:").removesuffix(">")) else None

    def run(batches):
        store, top = fs.FileSystem.from_uri(folder)
        opened, name = None, ""
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
            for archive, low, high, first, last in ranges(places, gap, read_bytes) if places else ():
                if archive != name:
                    if opened is not None:
                        opened.close()
                    opened, name = store.open_input_file(f"{top}/{archive}"), archive
                data = opened.read_at(high - low, low)
                out: list[list] = [[] for _ in range(7)]
                for _, offset, length in places[first:last]:
                    fields, payload = parsed(zlib.decompress(data[offset - low : offset - low + length], 31))
                    response = fields["WARC-Type"] == "response"
                    values = (
                        number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), len(payload) if response else int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                        fields["WARC-Type"], None if response else number(fields["WARC-Refers-To"]), payload if response else None,
                    )
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if opened is not None:
            opened.close()

    spread = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return index.select("archive", "offset", "length").repartitionByRange(spread, "archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(run, shape)


def archived(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder, then read all records back by the index."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder, min_bytes), folder)
