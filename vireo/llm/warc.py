"""WARC archives: index first, then coalesced byte-range reads.

Writing: each task writes its pages as gzip members, one for each record, into archives of about
``ARCHIVE_BYTES`` in the shared folder and returns one index row for each record: archive, offset, length, URL,
digest, kind. A payload of at least ``MIN_REVISIT`` bytes that several pages have is stored once, as the
response of the smallest page; the others are revisits that name it. Archive names are unique to an attempt,
and the index, a written table, only holds those of tasks that ended well, so lost executors do no harm.

Reading: index rows are dealt by archive and region of it, sorted by offset, and neighbours less than ``GAP``
bytes apart are fetched by one read of at most ``READ_BYTES``. Every payload is checked against its digest.

Only (page, digest) moves between tasks to find equal payloads. The pages that have an equal elsewhere are joined
back: by broadcast if their list is small (it is counted), else by a shuffle of the pages. A payload shared by a
third of all pages is one row of an aggregate and a join that adaptive execution splits.

Defined cases: null html is an empty payload; smaller payloads than ``MIN_REVISIT`` are responses always; of
rows with the same smallest page_id and payload one is the response and the others revisit it; a null page_id
comes after all others; null urls are written as ``urn:page:<page_id>``, and control characters and blanks of a url, such as
line ends, percent-encoded; ids of any type and text, as ids are percent-encoded in record ids; a very long payload is
held whole by one task; an empty table gives no archive and no
rows; extra columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, ensure_importable, fresh_path, materialize, n_partitions, open_store

MIN_REVISIT = 100
ARCHIVE_BYTES = 256 << 20
REGION_BYTES = 16 << 20
READ_BYTES = 8 << 20
GAP = 64 << 10
#: At most so many pages with equal payloads (some 150 bytes each) are broadcast.
BROADCAST_ROWS = 200_000
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id {id}, url string, digest string, record_type string, refers_to {id}, archive string, offset long, length long"


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def write_record(url: str, record_id: str, digest: str, size: int, payload: bytes | None, refers_to: str | None) -> bytes:
    """One record as a gzip member; ``payload`` None: a revisit, which keeps the HTTP head only."""
    block = http_head(size) + (payload or b"")
    fields = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Target-URI", header_url(url)),
        ("WARC-Date", DATE),
        ("WARC-Record-ID", record_id),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if payload is None:
        fields[4:4] = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to)]
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], int, bytes]:
    """(fields, length of the full payload by its HTTP head, payload)."""
    raw = gzip.decompress(member)
    head, rest = raw.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a {VERSION} record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, size, payload


def record_id(page: object, serial: int = 0) -> str:
    """The record's name: a page's id percent-encoded, so that it holds none of the name's own marks."""
    name = "none" if page is None else f"page:{quote(str(page), safe='')}"
    return f"<urn:{name}>" if serial == 0 else f"<urn:{name}:{serial}>"


def header_url(url: str) -> str:
    """A url on one line: control characters and blanks percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def classify(pages: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """(page_id, url, payload, digest, response_of, copy): response_of is null if no other page has the payload."""
    light = pages.select(
        F.col(f"`{id_col}`").alias("page_id"),
        F.col(f"`{url_col}`").alias("url"),
        F.coalesce(F.encode(F.col(f"`{text_col}`"), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    digests = materialize(light.select("page_id", "digest", F.octet_length("payload").alias("size")), "warc-digests")
    large = digests.filter(F.col("size") >= MIN_REVISIT)
    shared = large.groupBy("digest").agg(F.min("page_id").alias("response_of"), F.count("*").alias("n")).filter("n > 1").select("digest", "response_of")
    pairs = large.groupBy("page_id", "digest").agg(F.count("*").alias("copies")).join(shared, "digest")
    pairs = materialize(pairs, "warc-shared").withColumnsRenamed({"digest": "shared_digest", "page_id": "shared_page"})
    n, repeated = pairs.agg(F.count("*"), F.coalesce(F.max("copies"), F.lit(0))).first()
    same = (F.col("digest") == F.col("shared_digest")) & F.col("page_id").eqNullSafe(F.col("shared_page"))
    if n == 0:
        return light.withColumns({"response_of": F.lit(None).cast(light.schema["page_id"].dataType), "shared": F.lit(False), "copy": F.lit(1)})
    joined = light.join(F.broadcast(pairs) if n <= BROADCAST_ROWS else pairs, same, "left")
    joined = joined.withColumn("shared", F.col("shared_digest").isNotNull())
    if repeated <= 1:
        return joined.select("page_id", "url", "payload", "digest", "response_of", "shared", F.lit(1).alias("copy"))
    # rows with equal page_id and payload: the first by url is copy 1, others have numbers of their own; no group meets in one task
    columns = ["page_id", "url", "payload", "digest", "response_of", "shared"]
    many = F.coalesce(F.col("copies"), F.lit(1)) > 1
    rows = materialize(joined.filter(many).select(*columns, F.monotonically_increasing_id().alias("row")), "warc-repeated")
    first = rows.groupBy("page_id", "digest").agg(F.min(F.struct("url", "row")).alias("least")).select(F.col("least.row").alias("row"), F.lit(True).alias("first"))
    numbered = rows.join(first, "row", "left").select(*columns, F.when(F.col("first"), F.lit(1).cast("long")).otherwise(F.col("row") + 2).alias("copy"))
    return joined.filter(~many).select(*columns, F.lit(1).cast("long").alias("copy")).unionByName(numbered)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> tuple[DataFrame, str]:
    """(index table, folder of the archives)."""
    spark = pages.sparkSession
    ensure_importable(spark)
    base = fresh_path(spark, "warc")
    rows = classify(pages, id_col, url_col, text_col)
    id_type = ddl(rows.schema["page_id"].dataType)
    is_first = F.col("page_id").eqNullSafe(F.col("response_of")) & (F.col("copy") == 1)
    rows = rows.withColumn("record_type", F.when(F.col("shared") & ~is_first, "revisit").otherwise("response")).select("page_id", "url", "payload", "digest", "response_of", "copy", "record_type")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_store(base)
        out, name, at = None, "", 0
        try:
            for b in batches:
                cols = {c: b.column(c).to_pylist() for c in ("page_id", "url", "digest", "response_of", "copy", "record_type")}
                archives, offsets, lengths = [], [], []
                for i, payload in enumerate(b.column("payload")):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        files.create_dir(root, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    data = payload.as_py()
                    page, revisit = cols["page_id"][i], cols["record_type"][i] == "revisit"
                    member = write_record(cols["url"][i] or record_id(page)[1:-1], record_id(page, cols["copy"][i] - 1), cols["digest"][i], len(data), None if revisit else data, record_id(cols["response_of"][i]) if revisit else None)
                    out.write(member)
                    archives.append(name)
                    offsets.append(at)
                    lengths.append(len(member))
                    at += len(member)
                refers = pa.array([r if t == "revisit" else None for r, t in zip(cols["response_of"], cols["record_type"])], b.column("page_id").type)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("digest"), b.column("record_type"), refers, pa.array(archives, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["page_id", "url", "digest", "record_type", "refers_to", "archive", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return materialize(rows.mapInArrow(apply, INDEX.format(id=id_type)), "warc-index"), base


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ_BYTES) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) ranges -> reads (offset, length, ranges in it); near ones share a read."""
    reads: list[tuple[int, int, list[tuple[int, int]]]] = []
    for at, n in ranges:
        if reads and at - (reads[-1][0] + reads[-1][1]) <= gap and at + n - reads[-1][0] <= most:
            start, _, held = reads[-1]
            reads[-1] = (start, at + n - start, [*held, (at, n)])
        else:
            reads.append((at, n, [(at, n)]))
    return reads


def read_records(index: DataFrame, base: str, with_payload: bool = False) -> DataFrame:
    """The index's selected records, read back: page_id, url, payload_bytes, payload_digest, record_type, refers_to_id [, payload]."""
    spark = index.sparkSession
    region = F.floor(F.col("offset") / REGION_BYTES)
    placed = index.select("page_id", "archive", "offset", "length", region.alias("region")).repartition(n_partitions(spark), "archive", "region").sortWithinPartitions("archive", "offset")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to_record"]

    def rows_of(archive: str, records: list[tuple[int, int, object]]) -> Iterator[tuple]:
        files, root = open_store(base)
        with files.open_input_file(f"{root}/{archive}") as f:
            for start, size, held in coalesce_ranges([x[:2] for x in records]):
                data = f.read_at(size, start)
                for (at, n), (_, _, page) in zip(held, records[: len(held)]):
                    fields, full, payload = parse_record(data[at - start : at - start + n])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if fields["WARC-Type"] == "response" and (len(payload) != full or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{archive} at {at}: the payload doesn't match its digest")
                    yield page, fields["WARC-Target-URI"], full, digest, fields["WARC-Type"], fields.get("WARC-Refers-To"), payload if with_payload else None
                records = records[len(held) :]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, object]] = []
        archive, page_type, total = None, None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            got = list(zip(*rows_of(archive, held)))
            types = [page_type, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, types)][: 6 + with_payload], names=names + ["payload"] * with_payload)

        for b in batches:
            page_type = b.column("page_id").type
            for page, name, at, n in zip(*(b.column(c).to_pylist() for c in ("page_id", "archive", "offset", "length"))):
                if held and (name != archive or total + n > READ_BYTES):
                    yield from flush()
                    held, total = [], 0
                archive, total = name, total + n
                held.append((at, n, page))
        if held:
            yield from flush()

    id_type = ddl(index.schema["page_id"].dataType)
    schema = f"page_id {id_type}, url string, payload_bytes long, payload_digest string, record_type string, refers_to_record string" + (", payload binary" if with_payload else "")
    return placed.select("page_id", "archive", "offset", "length").mapInArrow(apply, schema)


def archive_round_trip(pages: DataFrame, **columns) -> DataFrame:
    index, base = write_archives(pages, **columns)
    id_type = index.schema["page_id"].dataType
    page = F.when(F.col("refers_to_record").startswith("<urn:page:"), F.url_decode(F.regexp_extract("refers_to_record", r"^<urn:page:([^:>]*)>$", 1))).cast(id_type)
    return read_records(index, base).select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", page).alias("refers_to"))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first,
        row_number() OVER (PARTITION BY page_id, payload_digest) AS copy FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 100 OR (page_id IS NOT DISTINCT FROM first AND copy = 1) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 100 OR (page_id IS NOT DISTINCT FROM first AND copy = 1) THEN NULL ELSE first END AS refers_to
FROM r
"""
