"""Legacy archive converter (operator 4): ARC files to WARC records and back to rows.

``write_arc`` writes pages as ARC files: a version block that names the header
fields (version 1: five fields, version 2: ten), then for each page a header
line with the declared length and that many bytes. ``convert`` reads such files
with the fields their version block declares, takes payloads by the declared
lengths, and writes WARC records with synthesised record ids, dates, types and
digests; of equal payloads of at least ``MIN_REVISIT`` bytes the one with the
smallest page id is the response and the others are revisits of it.
``read_warc`` parses the WARC files back into rows.

Files are written by Spark's text writer with the format's own record
separator, gzip-compressed as a whole, and hold at most about ``ARCHIVE_BYTES``
before compression (or one record), so reading one is bounded. Payloads never
move by digest: only (digest, place) rows do; the decisions are sent back to
each archive by its number. Equal payloads may be a third of all pages: the
digest groups are combined map-side and their join is splittable.

Defined results: null html is the empty payload; a null page id stays null and
sorts after others; pages that share a page id and a payload are told apart by
their place (the first is the response); very long payloads are written whole; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.common import new_path, small_batches

ARCHIVE_BYTES = 8 << 20
MIN_REVISIT = 100
DEFAULT_DATE = "19970101000000"
FIELDS = {  # fixed values: the header fields of the two versions of the format
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _safe(url: str | None) -> str:
    """A header field: blanks and control characters percent-encoded, '-' if there is nothing."""
    out = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    return out or "-"


def arc_record(url: str | None, page_id, body: bytes, version: int, date: str, name: str, place: int) -> bytes:
    """One ARC record without its closing newline."""
    who = b"" if page_id is None else f"X-Page-Id: {page_id}\r\n".encode()
    doc = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + who + f"Content-Length: {len(body)}\r\n\r\n".encode() + body
    head = f"{_safe(url)} 0.0.0.0 {date} text/html"
    if version == 2:
        head += f" 200 {hashlib.md5(doc).hexdigest()} - {place} {name}"
    return f"{head} {len(doc)}\n".encode() + doc


def version_block(version: int, name: str, date: str) -> bytes:
    about = f"{version} 0 InternetArchive\n{FIELDS[version]}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    if version == 2:
        head += f" 200 - - 0 {name}"
    return f"{head} {len(about)}\n".encode() + about


def _write(rows: DataFrame, path: str, separator: str) -> None:
    """Rows (archive, place, record) as one gzip file per archive, records in order."""
    (rows.withColumn("record", F.col("record").cast("string")).sortWithinPartitions("archive", "place")
     .select("archive", "record").write.partitionBy("archive")
     .option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path))


ROW = pa.schema([("archive", pa.int64()), ("place", pa.int64()), ("record", pa.binary())])


def _rolled(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], ROW.field(i).type) for i in range(3)], schema=ROW)


def write_arc(pages: DataFrame, path: str, date: str = DEFAULT_DATE, id_col: str = "page_id",
              url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write pages as ARC files of alternating versions."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"), F.spark_partition_id().alias("part"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, size, place = -1, archive_bytes, 0
        for b in batches:
            out, held = [], 0
            for page_id, url, html, part in zip(*(c.to_pylist() for c in b.columns)):
                body = (html or "").encode()
                if size >= archive_bytes:
                    archive = archive + 1 if archive >= 0 else part << 20
                    version, name, size, place = 1 + archive % 2, f"pages-{archive}.arc", 0, 0
                    out.append((archive, 0, version_block(version, name, date)))
                place += 1
                record = arc_record(url, page_id, body, version, date, name, size)
                out.append((archive, place, record))
                size += len(record) + 1
                held += len(record)
                if held > 4 << 20:
                    yield _rolled(out)
                    out, held = [], 0
            yield _rolled(out)

    _write(rows.mapInArrow(write, "archive long, place long, record binary"), path, "\n")


def _open(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


def read_arc(content: bytes) -> Iterator[tuple[int, dict, bytes]]:
    """(place, header fields, network document) of each record after the version block."""
    stream = _open(content)
    head = stream.readline()
    about = stream.read(int(head.rsplit(b" ", 1)[1])).decode().split("\n")
    version, names = int(about[0].split(" ")[0]), about[1].split(" ")
    if len(names) != len(FIELDS[version].split(" ")):
        raise ValueError(f"version {version} block declares {len(names)} fields")
    place = 0
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        fields = dict(zip(names, line.rstrip(b"\r\n").decode("utf-8", "replace").rsplit(" ", len(names) - 1)))
        length = int(fields[names[-1]])
        doc = stream.read(length)
        if len(doc) < length:
            raise ValueError(f"archive ends inside record {place + 1}")
        place += 1
        yield place, fields, doc


def split_http(doc: bytes) -> tuple[bytes, bytes, dict]:
    """(header block, payload, header fields); a document without a status line is all payload."""
    if not doc.startswith(b"HTTP/"):
        return b"", doc, {}
    head, _, body = doc.partition(b"\r\n\r\n")
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return head + b"\r\n\r\n", body, {k.strip().lower().decode("latin-1"): v.strip().decode("latin-1") for k, _, v in pairs}


def record_id(archive: int, place: int, fields: dict, digest: str) -> str:
    """A name-based UUID: the same record gets the same id on every run."""
    key = f"{fields['URL']} {fields['Archive-date']} {archive} {place} {digest}"
    return str(uuid.UUID(bytes=hashlib.sha256(key.encode()).digest()[:16], version=5))


def warc_date(arc: str) -> str:
    """14-digit (or shorter) date of the old format as an ISO instant."""
    d = (arc + "00000101000000"[len(arc):]) if len(arc) < 14 else arc[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: dict, rid: str, digest: str, head: bytes, body: bytes, revisit: tuple | None) -> bytes:
    """One WARC record without the two closing line ends."""
    block = head if revisit else head + body
    kind = "revisit" if revisit else "response" if head else "resource"
    out = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{rid}>", f"WARC-Date: {warc_date(fields['Archive-date'])}"]
    if fields["URL"] != "-":
        out.append(f"WARC-Target-URI: {fields['URL']}")
    if fields.get("IP-address", "0.0.0.0") != "0.0.0.0":
        out.append(f"WARC-IP-Address: {fields['IP-address']}")
    out.append(f"WARC-Payload-Digest: sha256:{digest}")
    out.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}")
    if revisit:
        out += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{revisit[1]}>"]
        if revisit[0] is not None:
            out.append(f"X-Refers-To-Page: {revisit[0]}")
    out.append("Content-Type: " + ("application/http; msgtype=response" if head else fields["Content-type"]))
    out.append(f"Content-Length: {len(block)}")
    return "\r\n".join(out).encode() + b"\r\n\r\n" + block


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("archive").cast("long").alias("archive"), "content")


def _has_files(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(path + "/archive=*"))
    return found is not None and len(found) > 0


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_revisit: int = MIN_REVISIT) -> bool:
    """Convert every ARC file below ``arc_path``; False if there is none."""
    small_batches(spark)
    if not _has_files(spark, arc_path):
        return False
    archives = _archives(spark, arc_path)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for place, fields, doc in read_arc(content.as_py()):
                    _, body, http = split_http(doc)
                    if len(body) >= min_revisit:
                        digest = hashlib.sha256(body).hexdigest()
                        rows.append((http.get("x-page-id"), archive, place, digest, record_id(archive, place, fields, digest)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                    ["page", "archive", "place", "digest", "rid"])

    found = (archives.mapInArrow(digests, "page string, archive long, place long, digest string, rid string")
             .withColumn("num", F.expr("try_cast(page as long)")))
    key = F.struct(F.col("page").isNull().alias("none"), F.col("num").isNull().alias("text"), "num", "page", "archive", "place", "rid")
    first = found.groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # the decisions of one archive are bounded by its records
    revisits = (found.join(first, "digest")
                .filter("archive <> first.archive or place <> first.place")
                .groupBy("archive").agg(F.collect_list(F.struct("place", F.col("first.page").alias("page"), F.col("first.rid").alias("rid"))).alias("revisits")))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content, todo in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                refers = {r["place"]: (r["page"], r["rid"]) for r in todo.as_py() or ()}
                out, held = [], 0
                for place, fields, doc in read_arc(content.as_py()):
                    head, body, _ = split_http(doc)
                    digest = hashlib.sha256(body).hexdigest()
                    record = warc_record(fields, record_id(archive, place, fields, digest), digest, head, body, refers.get(place))
                    out.append((archive, place, record))
                    held += len(record)
                    if held > 4 << 20:
                        yield _rolled(out)
                        out, held = [], 0
                yield _rolled(out)

    _write(archives.join(revisits, "archive", "left").select("archive", "content", "revisits")
           .mapInArrow(rewrite, "archive long, place long, record binary"), warc_path, "\r\n\r\n")
    return True


def read_warc_records(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields in lower case, block) of each record, by its declared length."""
    stream = _open(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts here: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        block = stream.read(int(fields["content-length"]))
        yield fields, block


WARC_ROWS = "page string, payload_bytes long, payload_digest string, record_type string, refers_page string, record_id string, warc_date string, target_uri string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record; digests of responses are taken anew from the payload read."""
    small_batches(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                out = []
                for f, block in read_warc_records(content.as_py()):
                    head, body, http = split_http(block)
                    if f["warc-type"] == "revisit":
                        size, digest = int(http.get("content-length", 0)), f["warc-payload-digest"].partition(":")[2]
                    else:
                        size, digest = len(body), hashlib.sha256(body).hexdigest()
                        if f["warc-payload-digest"] != f"sha256:{digest}":
                            raise ValueError(f"payload of {f['warc-record-id']} does not match its digest")
                    out.append((http.get("x-page-id"), size, digest, f["warc-type"], f.get("x-refers-to-page"),
                                f["warc-record-id"], f["warc-date"], f.get("warc-target-uri")))
                types = (pa.string(), pa.int64(), *[pa.string()] * 6)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
                                                 [c.split(" ")[0] for c in WARC_ROWS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, WARC_ROWS)


def pages_through_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages to ARC, ARC to WARC, WARC back to one row per page."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, id_col=id_col, url_col=url_col, html_col=html_col)
    kind = pages.schema[id_col].dataType
    if convert(spark, arc, warc):
        rows = read_warc(spark, warc)
    else:
        rows = spark.createDataFrame([], WARC_ROWS)
    return rows.select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
                       F.when(F.col("record_type") == "revisit", F.col("refers_page").cast(kind)).alias("refers_to"),
                       "record_id", "warc_date", "target_uri")
