"""WARC archives of pages: writing with segments, and reading with segment reassembly.

A page's response is an HTTP message in chunked transfer coding. A message longer than a segment is cut: the first
segment is a response record with WARC-Segment-Number 1, the others are continuation records that name its record by
WARC-Segment-Origin-ID, the last with WARC-Segment-Total-Length. The reader groups segments by origin, orders them by
number, verifies the numbers and the total length, joins them and decodes the chunks. Records that are not segmented
are decoded where they are read.

Payloads of at least least_bytes that are equal are stored once, as the response of the largest page_id; the others are
revisit records that name it. Whether they are equal is decided on length and SHA-1, which are shuffled without texts;
payloads met twice or more are a table of their own, so Spark sends it to all tasks where it is small and else splits the
rows of a payload that very many pages have.

Each record is a gzip member of its own, as is usual. Files are written under the shared folder to a temporary name and
then moved; Spark's binaryFile source reads those that the tasks that finished have named.

Defined cases: null and empty html are payloads of no bytes and responses. A very long page is as many segments as it
takes, joined in one pass. Rows that repeat a page_id are records of
their own; where such rows hold the largest page_id of equal payloads, each is a response. A page without page_id is
always a response. An empty table gives an empty result. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita.llm import session

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
FILE_BYTES = 16 << 20
DATE = "1970-01-01T00:00:00Z"
RECORDS = "origin string, number int, total long, is_first boolean, page_id long, record_type string, refers_to long, digest string, length long, block binary"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(part := payload[i : i + size]), part) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        if body[line + 2 + n : line + 4 + n] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[line + 2 : line + 2 + n])
        at = line + 4 + n


def _one_line(value: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in value or "")


def record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Date": DATE, **fields, "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, unique: str, segment: int) -> Iterator[bytes]:
    """The records of one page."""
    name = f"urn:page:{'' if page_id is None else page_id}:{unique}"
    fields: dict[str, object] = {"WARC-Record-ID": f"<{name}>", "WARC-Target-URI": _one_line(url), "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()}
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record("revisit", fields | {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": profile, "Content-Type": "application/http;msgtype=response"}, block)
        return
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields["Content-Type"] = "application/http;msgtype=response"
    if len(message) <= segment:
        yield record("response", fields, message)
        return
    parts = [message[i : i + segment] for i in range(0, len(message), segment)]
    yield record("response", fields | {"WARC-Segment-Number": 1}, parts[0])
    for k, part in enumerate(parts[1:], 2):
        own: dict[str, object] = {"WARC-Record-ID": f"<{name}:{k}>", "WARC-Target-URI": _one_line(url), "WARC-Segment-Number": k, "WARC-Segment-Origin-ID": f"<{name}>"}
        if k == len(parts):
            own["WARC-Segment-Total-Length"] = len(message)
        yield record("continuation", own, part)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in small letters) and block of each record of an archive."""
    at = 0
    while at < len(content):
        if not content.startswith(b"WARC/", at):
            raise ValueError(f"no record begins at byte {at}")
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        yield fields, content[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def unzipped(content: bytes) -> bytes:
    """All members one after another, in time that grows with the size: gzip.decompress copies the rest for each member."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as file:
        return file.read()


def _writer(folder: str, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        # A task that runs again writes other files, and only the names that the finished one returns count.
        stem = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        files = stream = None
        written: list[str] = []
        n_rows, size, temporary, final = 0, 0, "", ""
        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    files, path = pafs.FileSystem.from_uri(folder)
                    final, temporary = f"{path}/{stem}-{len(written):04d}.warc.gz", f"{path}/_{stem}-{len(written):04d}.{context.taskAttemptId()}"
                    files.create_dir(path, recursive=True)
                    stream, size = files.open_output_stream(temporary), 0
                payload = (row["html"] or "").encode()
                for part in records_of(row["page_id"], row["url"], payload, row["digest"], row["refers_to"], f"{stem}-{n_rows}", segment):
                    stream.write(gzip.compress(part, 1, mtime=0))
                    size += len(part)
                n_rows += 1
                if size >= FILE_BYTES:
                    stream.close()
                    files.move(temporary, final)
                    written.append(final)
                    stream = None
        if stream is not None:
            stream.close()
            files.move(temporary, final)
            written.append(final)
        yield pa.RecordBatch.from_pydict({"file": pa.array([w.rsplit("/", 1)[1] for w in written], pa.string())})

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC files under folder; gives the files' names."""
    tables = session.Tables(pages.sparkSession, "warc-equal")
    pages = session.columns(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.withColumn("digest", F.sha1(payload)).withColumn("bytes", F.octet_length(payload).cast("long"))
    equal = pages.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "keeper")
    equal = tables.keep(equal, "equal")
    revisits = pages.select("page_id", "digest", "bytes").filter("page_id is not null").join(equal, [F.col("digest") == F.col("d"), F.col("bytes") == F.col("b")])
    revisits = revisits.filter("page_id <> keeper").groupBy("page_id", "digest").agg(F.max("keeper").alias("refers_to"))
    revisits = revisits.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to")
    known = pages.join(revisits.hint("shuffle_hash"), [F.col("page_id") == F.col("r_page"), F.col("digest") == F.col("r_digest")], "left")
    return known.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_writer(folder, segment_bytes), "file string").checkpoint()


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("is_first", pa.bool_()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("length", pa.int64()), ("block", pa.binary())])
    rows: list[dict] = []
    size = 0
    for batch in batches:
        for content in batch.column("content"):
            for fields, block in parse(unzipped(content.as_py())):
                name = fields["warc-record-id"].strip("<>")
                page = name.split(":")[2]
                digest = fields.get("warc-payload-digest")
                first = fields["warc-type"] != "continuation"
                row = {
                    "origin": fields.get("warc-segment-origin-id", f"<{name}>").strip("<>"), "number": int(fields["warc-segment-number"]) if "warc-segment-number" in fields else None,
                    "total": int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None, "is_first": first, "page_id": int(page) if page else None,
                    "record_type": fields["warc-type"] if first else None, "refers_to": int(fields["warc-refers-to"].strip("<>").split(":")[2]) if "warc-refers-to" in fields else None,
                    "digest": base64.b32decode(digest.partition(":")[2]).hex() if digest else None, "length": None, "block": block,
                }
                rows.append(row)
                size += len(block)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, kinds)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The payload of each whole message; of a revisit, only what its HTTP head says of it."""
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            head, _, body = b"".join(row["blocks"]).partition(b"\r\n\r\n")
            out = {"page_id": row["page_id"], "record_type": row["record_type"], "refers_to": row["refers_to"]}
            if row["record_type"] == "revisit":
                (n,) = (int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                rows.append(out | {"payload_bytes": n, "payload_digest": row["digest"], "payload": None})
                continue
            payload = dechunked(body)
            found = hashlib.sha1(payload).hexdigest()
            if found != row["digest"]:
                raise ValueError("a payload differs from its digest")
            rows.append(out | {"payload_bytes": len(payload), "payload_digest": found, "payload": payload})
        yield pa.RecordBatch.from_pylist(rows, kinds)


def read_archives(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    """One row for each page archived in the named files (file) under folder: digests, record type and, but for revisits, the payload.

    Other files there, which lost tasks have left, are not read; a named file that is missing is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).withColumn("file", F.substring_index("path", "/", -1))
    found = files.select("file")
    if not names.join(found, "file", "left_anti").isEmpty():
        raise ValueError("an archive that was written is missing")
    # One name for each attempt that was lost: none, as a rule.
    stale = [r.file for r in found.join(names, "file", "left_anti").collect()]
    records = files.filter(~F.col("file").isin(stale)).select("content").mapInArrow(_reader, RECORDS)
    whole = records.filter("number is null").select("page_id", "record_type", "refers_to", "digest", F.array("block").alias("blocks"))
    pieces = records.filter("number is not null").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("pieces"), F.max("total").alias("total"), F.max(F.when(F.col("is_first"), F.col("page_id"))).alias("page_id"),
        F.max("record_type").alias("record_type"), F.max("digest").alias("digest"),
    )
    # A missing or repeated segment, or a wrong total, is an error and not a shorter page.
    size = F.aggregate("pieces", F.lit(0).cast("long"), lambda so_far, p: so_far + F.octet_length(p["block"]))
    sound = (F.transform("pieces", lambda p: p["number"]) == F.sequence(F.lit(1), F.size("pieces"))) & (size == F.col("total"))
    blocks = F.when(sound, F.transform("pieces", lambda p: p["block"])).otherwise(F.raise_error(F.concat(F.lit("segments do not add up: "), "origin")))
    joined = pieces.select("page_id", "record_type", F.lit(None).cast("long").alias("refers_to"), "digest", blocks.alias("blocks"))
    return whole.union(joined).mapInArrow(_decoded, PAGES)


def archive(pages: DataFrame, least_bytes: int = 1000, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes pages as archives in a new folder under the shared one and reads them back."""
    spark = pages.sparkSession
    session.prepare(spark)
    folder = f"{session.shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    names = write_archives(pages, folder, least_bytes, segment_bytes)
    if names.isEmpty():
        return spark.createDataFrame([], PAGES)
    return read_archives(spark, folder, names)
