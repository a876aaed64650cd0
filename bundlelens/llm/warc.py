"""WARC archives, index first.

Writing gives each partition one archive of per-record gzip members in the shared folder and, before anything is read,
an index row per record: file, offset, length, URL and digest. Reading takes index rows, sorts those of a file by
offset, coalesces neighbouring byte ranges and fetches each coalesced range once.

Records with equal payloads are written once: that with the largest page_id is the response, the others are revisits
that refer to it (profile identical-payload-digest) and carry no payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm.shared import filesystem, fresh_path, stash

#: Largest table of repeated digests that is broadcast; a larger one is joined by shuffling.
BROADCAST_BYTES = 32 << 20
#: Ranges less than GAP bytes apart are fetched as one, up to RANGE bytes; a reading task gets TASK bytes of a file.
GAP, RANGE, TASK = 64 << 10, 4 << 20, 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same for every run, so that a task run again writes the same archive."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def header_value(text: str | None) -> str:
    """One line, as headers need it; what isn't printable ASCII is percent-encoded."""
    return "".join(c if 33 <= ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "")


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """(the record, payload digest)."""
    digest = digest_of(payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", header_value(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))),
        ("X-Page-ID", "" if page_id is None else str(page_id)), ("Content-Type", "text/html"),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    block = b"" if revisit else payload
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", digest


def read_record(source: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = source.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    length = int(headers["Content-Length"])
    if version != "WARC/1.1" or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("a malformed WARC record")
    return headers, rest[:length]


def _verdicts(pages: DataFrame) -> DataFrame:
    """(sha, last): of each payload that several rows have, the largest page_id. Only digests are shuffled."""
    return pages.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("sha", "last")


def write_archives(df: DataFrame, folder: str) -> DataFrame:
    """Write every row of (page_id, url, html) as a record into archives in `folder`; the index is returned, written.

    Null html is the empty payload, and empty payloads are equal to each other. A null page_id is smaller than any
    other; of rows with equal payload and equal largest page_id all are responses. Null URLs are empty. An empty table
    makes no archive and no index rows. Other columns aren't read.
    """
    import pyarrow as pa

    spark = df.sparkSession
    pages = df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    repeated = stash(_verdicts(pages), "warc-repeated")
    n = repeated.count()  # 28 bytes a row, and what a hash table adds to them
    repeated = F.broadcast(repeated) if n * 100 <= BROADCAST_BYTES else repeated
    marked = pages.join(repeated, "sha", "left").select("page_id", "url", "payload", F.col("last").alias("refers_to"), (F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))).alias("revisit"))

    def run(batches: Iterable) -> Iterator:
        fs, path = filesystem(folder)
        out, name, at = None, f"{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            rows = []
            for page_id, url, payload, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record, digest = make_record(page_id, url, payload, refers_to, revisit)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = packer.compress(record) + packer.flush()
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                out.write(packed)
                rows.append((page_id, url, digest, "revisit" if revisit else "response", refers_to if revisit else None, name, at, len(packed)))
                at += len(packed)
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if out is not None:
            out.close()

    # A task that runs again writes an archive of another name; only the index of the attempt that counts is kept.
    return stash(marked.mapInArrow(run, INDEX), "warc-index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = RANGE) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) ranges joined to (begin, end, indices of the ranges in it)."""
    found: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(ranges):
        if found and offset <= found[-1][1] + gap and max(offset + length, found[-1][1]) - found[-1][0] <= most:
            begin, end, own = found[-1]
            own.append(i)
            found[-1] = (begin, max(end, offset + length), own)
        else:
            found.append((offset, offset + length, [i]))
    return found


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, block) of the selected index rows, all read
    from the archives by coalesced byte ranges. The rows of one file are dealt to tasks by ranges of TASK bytes."""
    import pyarrow as pa

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, block binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    integer = lambda s: int(s) if s else None

    def fetched(rows: list[tuple], source) -> Iterator:
        for begin, end, own in coalesced([(r[1], r[2]) for r in rows]):
            source.seek(begin)
            data, found = source.read(end - begin), []
            for i in own:
                _, offset, length = rows[i]
                headers, block = read_record(zlib.decompress(data[offset - begin : offset - begin + length], 31))
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if headers["WARC-Type"] == "response" and digest_of(block) != digest:
                    raise ValueError(f"the payload of {headers['WARC-Record-ID']} doesn't have its digest")
                found.append((integer(headers["X-Page-ID"]), headers["WARC-Target-URI"], int(headers["X-Payload-Length"]), digest, headers["WARC-Type"], integer(headers.get("X-Refers-To-Page-ID")), block))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    def run(batches: Iterable) -> Iterator:
        fs, path = filesystem(folder)
        name, source, rows = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != name or len(rows) >= 2000:
                    if rows:
                        yield from fetched(rows, source)
                        rows = []
                    if row[0] != name:
                        name, source = row[0], fs.open_input_file(f"{path}/{row[0]}")
                rows.append(row)
        if rows:
            yield from fetched(rows, source)

    piece = F.floor(F.col("offset") / TASK)
    # as many tasks as the archives' bytes need: index rows are small, and would be dealt to few tasks by their own size
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // TASK))
    dealt = index.select("file", "offset", "length").repartition(tasks, "file", piece).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(index, folder).drop("url", "block")


#: DuckDB; base32 digits stand for five bits each of the digest's 160.
OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(4), lambda g: list_aggregate(list_transform(range(8), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 1 + 10 * g, 10))::BIGINT >> (35 - 5 * i)) & 31))::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM h
"""
