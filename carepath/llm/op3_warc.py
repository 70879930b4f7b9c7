"""WARC archives: gzip members written per record, read back by tasks that own byte ranges.

Writing: one row gives one record in a gzip member of its own. Rows with equal payloads of at least
``least_bytes`` share one response, that of the smallest page_id; the others revisit it. Only digests and
ids are grouped, with partial sums before the shuffle, and a hot payload is split by the skew join.

Reading: an archive is cut into byte ranges. A task looks for the gzip magic in its range, takes the first
candidate whose member decodes to a WARC header and a sound checksum and which another member or the end of
the file follows, and then goes from member to member. It owns the records that start inside its range and
reads past the range's end to finish the last.

Recovery: a task writes to a name of its own attempt, and only names in the stored manifest are read, so a
lost executor leaves at most files nobody reads.

Defined results: a null html is the empty payload; a null or many-line url is written empty or on one line; a
null page_id makes a response record without an id and is never referred to; rows that repeat the smallest
page_id of a payload are all responses; an empty table gives no archive and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.llm.common import stored
from carepath.session import new_folder

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
URN = "urn:page:"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RANGE_BYTES = 16 << 20
WINDOW_BYTES = 1 << 20
MANIFEST = "path string, bytes long, records long"
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a string's UTF-8 bytes."""
    digits = F.sha1(payload)
    return F.concat(
        *(
            F.translate(F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0"), HEX32, BASE32)
            for k in range(4)
        )
    )


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Each page with its payload's size and digest, its record type and the page it refers to."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).select(
        "*", F.octet_length("html").cast("long").alias("payload_bytes"), base32_sha1(F.col("html")).alias("digest")
    )
    first = (
        rows.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.max("payload_bytes").alias("payload_bytes"))
    )
    # joined on the size as well, so that both sides are dealt anew and a hot digest can be split
    joined = rows.join(first, ["digest", "payload_bytes"], "left")
    revisits = F.col("page_id") != F.col("first_id")
    return joined.select(
        "page_id",
        "url",
        "html",
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first_id")).alias("refers_to"),
    )


def _member(page_id, url, html: str, size: int, digest: str, kind: str, refers_to) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    else:
        block += html.encode()
    head.append(f"Content-Length: {len(block)}")
    record = VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(wbits=31)
    return packer.compress(record) + packer.flush()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write one archive per task under ``folder``; the stored manifest of path, bytes and records."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        out, path, written, n = None, None, 0, 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if out is None:
                    store, base = fs.FileSystem.from_uri(folder)
                    store.create_dir(base)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path = f"{folder}/{name}"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = _member(*row)
                out.write(member)
                written, n = written + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [written], "records": [n]})

    fields = ("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return stored(records.select(*fields).mapInArrow(write, MANIFEST), "warc-manifest")


def _inflate(source, at: int, size: int, most: int | None = None) -> tuple[bytes, int] | None:
    """The member at ``at`` and where it ends, or its first ``most`` bytes; None if it isn't sound."""
    unpacker, parts, length, here = zlib.decompressobj(wbits=31), [], 0, at
    while not unpacker.eof:
        if here >= size:
            return None
        source.seek(here)
        data = source.read(WINDOW_BYTES if most is None else 4096)
        here += len(data)
        try:
            while data and not unpacker.eof:
                parts.append(unpacker.decompress(data, most or 0))
                length += len(parts[-1])
                if most and length >= most:
                    return b"".join(parts)[:most], at
                data = unpacker.unconsumed_tail
        except zlib.error:
            return None
    return b"".join(parts), here - len(unpacker.unused_data)


def _sound(source, at: int, size: int) -> bool:
    """Whether a record starts at ``at``: header decodes, checksum holds, a member or the end follows."""
    opening = _inflate(source, at, size, len(VERSION))
    if opening is None or opening[0] != VERSION:
        return False
    whole = _inflate(source, at, size)
    if whole is None:
        return False
    source.seek(whole[1])
    return whole[1] >= size or source.read(len(MAGIC)) == MAGIC


def first_record(source, start: int, end: int, size: int) -> int | None:
    """Where the first record that starts in ``[start, end)`` does."""
    here, step = start, WINDOW_BYTES
    while here < end:
        source.seek(here)
        data = source.read(min(step, end - here) + len(MAGIC) - 1)
        k = data.find(MAGIC)
        while k >= 0:
            if here + k < end and _sound(source, here + k, size):
                return here + k
            k = data.find(MAGIC, k + 1)
        here += step
    return None


def records_in(source, start: int, end: int, size: int) -> Iterator[bytes]:
    """The records of an open archive that start in ``[start, end)``."""
    at = first_record(source, start, end, size)
    while at is not None and at < end:
        found = _inflate(source, at, size)
        if found is None:  # damaged: look for the next sound record
            at = first_record(source, at + 1, end, size)
            continue
        yield found[0]
        at = found[1]


def _parsed(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")).split(b": ")[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]

    def page(name: str) -> int | None:
        text = fields.get(name, "")[len(URN) + 1 : -1]
        return int(text) if text else None

    if kind == "response" and (len(payload) != size or b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
    body = payload if kind == "response" else None
    return page("WARC-Record-ID"), fields["WARC-Target-URI"], size, digest, kind, page("WARC-Refers-To"), body


def read_archives(
    spark: SparkSession, manifest: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True
) -> DataFrame:
    """Every record of the manifest's archives; ``payloads=False`` leaves the payload column null."""
    ranges = manifest.select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes))).alias("start")
    )
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes)).alias("n")).first()["n"] or 1

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        schema = pa.schema(list(zip(names, types, strict=True)))

        def batch_of(rows: list[tuple]):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema
            )

        for batch in batches:
            for path, size, start in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(place) as source:
                    for record in records_in(source, start, min(start + range_bytes, size), size):
                        row = _parsed(record)
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(record) if payloads else 200
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.repartition(int(n)).mapInArrow(read, RECORDS)


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives; the manifest."""
    return write_archives(plan_records(pages, least_bytes), folder or new_folder(pages.sparkSession, "warc"))
