"""WARC archives: writing pages, and reading them back with segment reassembly.

Every page is a response record whose block is an HTTP message in chunked transfer framing, or, if
another page with a larger page_id has the same payload (of min_revisit bytes or more), a revisit
record that refers to that page's record. Blocks of more than segment_chars characters are cut into
a response and continuation records. Spark's text writer writes the records; archives hold at most
archive_records of them, so an archive has a bounded size and no reader holds more than one.

Reading groups the records that belong together by origin identifier, orders them by segment
number, checks that they are all there and have the total length, and decodes the chunks. One group
is one page. Repeated rows (equal page_id and html) make equal records; equal segments are counted
before they are gathered, and as many pages come back.

A payload that very many pages share makes one key of two joins. Both have plain tables on both
sides, so that Spark's adaptive skew join deals the key to many tasks; pages too short to be
revisits, such as empty ones, and responses take part in neither.

Nulls: a null html is an empty payload, a null url an empty target; a null page_id is a page of its
own that never is the one referred to unless no equal payload has a page_id. Very long pages are
cut into segments, so that only the task that puts a page together holds it whole. An empty table
makes an empty result. Only page_id, url and html are read; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_tasks, new_folder, saved

MIN_REVISIT = 1000
CHUNK_CHARS = 8192
SEGMENT_CHARS = 16384
ARCHIVE_RECORDS = 1000
#: Archives do not carry the time of writing, so that equal pages make equal archives.
DATE = "2024-01-01T00:00:00Z"
ID_PREFIX = "urn:page:"

CRLF = "\r\n"
HTTP_HEAD = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked", "", ""])
REVISIT_HEAD = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "", ""])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit(ID_PREFIX), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest)


def in_pieces(text: Column, size: int) -> Column:
    """The text cut into pieces of size characters, at least one."""
    last = F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def chunked(payload: Column, size: int) -> Column:
    """The payload in chunked transfer framing."""
    frames = F.transform(F.filter(in_pieces(payload, size), lambda x: F.length(x) > 0), lambda x: F.concat(F.lower(F.hex(F.octet_length(x))), F.lit(CRLF), x, F.lit(CRLF)))
    return F.concat(F.array_join(frames, ""), F.lit("0" + CRLF + CRLF))


def with_revisits(pages: DataFrame, min_revisit: int) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    long = rows.where(F.octet_length("payload") >= min_revisit)
    groups = saved(long.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first_id"), "payload-groups")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    columns = ["page_id", "url", "payload", "digest"]
    joined = long.join(groups.hint("merge"), "digest", "left").select(*columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))
    short = rows.where(F.octet_length("payload") < min_revisit)
    return joined.unionByName(short.select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers_to")))


def records(rows: DataFrame, chunk_chars: int, segment_chars: int) -> DataFrame:
    """One column, record: the header, an empty line and the block of each WARC record."""
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit(REVISIT_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), chunked(F.col("payload"), chunk_chars)))
    own = record_id(F.col("page_id"), F.col("digest"))
    cut = rows.select(own.alias("own"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"), "digest", revisit.alias("revisit"), record_id(F.col("refers_to"), F.col("digest")).alias("other"), block.alias("block"))
    cut = cut.withColumn("total", F.octet_length("block"))
    parts = cut.select("own", "url", "digest", "revisit", "other", "total", F.posexplode(in_pieces(F.col("block"), segment_chars)).alias("i", "part"), (F.floor((F.length("block") - 1) / segment_chars) + 1).alias("n"))

    def line(name: str, *value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), *[F.lit(v) if isinstance(v, str) else v for v in value], F.lit(CRLF))

    first, several, last = F.col("i") == 0, F.col("n") > 1, F.col("i") == F.col("n") - 1
    number = (F.col("i") + 1).cast("string")
    some = lambda when, *x: F.when(when, F.concat(*x)).otherwise("")
    return parts.select(
        F.concat(
            F.lit("WARC/1.1" + CRLF),
            line("WARC-Type", F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
            line("WARC-Record-ID", "<", F.col("own"), some(~first, F.lit(":"), number), ">"),
            line("WARC-Date", DATE),
            line("WARC-Target-URI", F.col("url")),
            line("WARC-Payload-Digest", "sha1:", F.col("digest")),
            some(first & F.col("revisit"), line("WARC-Refers-To", "<", F.col("other"), ">"), line("WARC-Profile", PROFILE)),
            some(first, line("Content-Type", "application/http; msgtype=response")),
            some(several, line("WARC-Segment-Number", number)),
            some(~first, line("WARC-Segment-Origin-ID", "<", F.col("own"), ">")),
            some(several & last, line("WARC-Segment-Total-Length", F.col("total").cast("string"))),
            line("Content-Length", F.octet_length("part").cast("string")),
            F.lit(CRLF),
            F.col("part"),
        ).alias("record")
    )


def write_archives(pages: DataFrame, folder: str, min_revisit=MIN_REVISIT, chunk_chars=CHUNK_CHARS, segment_chars=SEGMENT_CHARS, archive_records=ARCHIVE_RECORDS) -> None:
    """Writes gzipped archives of at most archive_records records to a new folder."""
    made = records(with_revisits(pages, min_revisit), chunk_chars, segment_chars)
    made.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", archive_records).text(folder)


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode().split(CRLF)
        if not version.startswith("WARC/1."):
            raise ValueError(f"no WARC record at {at}")
        fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        start = end + 4
        at = start + int(fields["content-length"])
        yield fields, archive[start:at]
        if archive[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record before {at} has another length")
        at += 4


def dechunked(block: bytes) -> bytes:
    """The payload of an HTTP message, out of chunked framing if it is in it."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
        if body[at - 2 : at] != b"\r\n":
            raise ValueError("a chunk has another length")


def unbracketed(value: str | None) -> str | None:
    return value and value.strip("<>")


RECORDS = "record_id string, record_type string, url string, payload_digest string, refers_to string, origin string, segment int, total long, block binary"


DIGESTS = "bytes long, digest string"


def read_records(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives, each read and unpacked once.

    Columns: record_id, record_type, url, payload_digest, refers_to, origin (of a first segment its
    own id), segment (null of a record that is a whole page), total (bytes of all segments, on the last), block; and of whole
    pages the bytes and the SHA-1 of their payload. Without payloads the block of a whole page is null: what is left is small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in f"{RECORDS}, {DIGESTS}".split(", ")]
        kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for f, block in parsed(zlib.decompress(content.as_buffer(), 31)):
                    own, segment = unbracketed(f["warc-record-id"]), f.get("warc-segment-number")
                    size = digest = None
                    if segment is None:
                        payload = dechunked(block)
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        block = block if payloads else None
                    rows.append((own, f["warc-type"], f.get("warc-target-uri"), f.get("warc-payload-digest"), unbracketed(f.get("warc-refers-to")), unbracketed(f.get("warc-segment-origin-id")) or own, segment and int(segment), int(t) if (t := f.get("warc-segment-total-length")) else None, block, size, digest))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return in_tasks(files, run, f"{RECORDS}, {DIGESTS}")


def segments_of(records: DataFrame) -> DataFrame:
    return records.where("segment is not null").drop("bytes", "digest")


def reassembled(segments: DataFrame) -> DataFrame:
    """The pages of segments, with the columns of whole records; a page that lacks a segment or has another length is an error.

    Equal segments from repeated rows are put together once for each row.
    """
    kept = ("record_id", "record_type", "url", "payload_digest", "refers_to", "total", "block")
    single = segments.groupBy("origin", "segment").agg(*[F.first(c).alias(c) for c in kept], F.count(F.lit(1)).alias("rows"))
    groups = single.groupBy("origin").agg(
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_id", "record_type", "url", "payload_digest", "refers_to")],
        F.max("total").alias("total"),
        F.max("rows").cast("int").alias("rows"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    block = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["block"]))
    groups = groups.withColumn("block", block)
    whole = (F.octet_length("block") == F.col("total")) & (F.element_at("parts", -1)["segment"] == F.size("parts"))
    checked = F.when(F.coalesce(whole, F.lit(False)), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments do not make a whole record: "), F.col("origin"))).cast("binary"))
    return groups.select("record_id", "record_type", "url", "payload_digest", "refers_to", "origin", F.lit(1).alias("segment"), "total", checked.alias("block"), F.explode(F.sequence(F.lit(1), "rows")).alias("row")).drop("row")


def with_payloads(rows: DataFrame) -> DataFrame:
    """record_id, record_type, url, payload_digest, refers_to, payload (of a revisit: empty) of whole records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = pa.array([dechunked(x) for x in batch.column("block").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("record_id", "record_type", "url", "payload_digest", "refers_to")], payloads], names=["record_id", "record_type", "url", "payload_digest", "refers_to", "payload"])

    return in_tasks(rows, run, "record_id string, record_type string, url string, payload_digest string, refers_to string, payload binary")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of all archives in a folder. Records are written once between reading and putting segments together, as both kinds are read from there."""
    records = saved(read_records(spark, folder), "warc-records")
    return with_payloads(records.where("segment is null").drop("bytes", "digest").unionByName(reassembled(segments_of(records))))


def page_of(record: Column) -> Column:
    """The page_id in a record id."""
    text = F.split_part(record, F.lit(":"), F.lit(3))
    return F.when(text != "null", text).cast("long")


def archived_pages(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes pages to archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Bytes and digest are taken from the payload read; those of a revisit from the record that it
    refers to, which must have the digest that the revisit's header names.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write_archives(pages, folder, **options)
    records = saved(read_records(spark, folder, payloads=False), "warc-records")
    several = with_payloads(reassembled(segments_of(records))).withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    columns = ["record_id", "record_type", "refers_to", "bytes", "digest", F.substring("payload_digest", 6, 40).alias("named")]
    read = saved(records.where("segment is null").select(*columns).unionByName(several.select(*columns)), "warc-pages")
    responses, revisits = read.where("record_type = 'response'"), read.where("record_type = 'revisit'")
    referred = saved(revisits.select(F.col("refers_to").alias("record_id")).distinct(), "warc-referred")
    targets = responses.join(referred.hint("merge"), "record_id", "left_semi").groupBy("record_id").agg(F.first("bytes").alias("bytes"), F.first("digest").alias("digest"))
    targets = saved(targets.withColumnRenamed("record_id", "refers_to"), "warc-targets")
    joined = responses.unionByName(revisits.drop("bytes", "digest").join(targets.hint("merge"), "refers_to", "left").select(*responses.columns))
    checked = F.when(F.col("digest") == F.col("named"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("another payload than its digest says: "), F.col("record_id"))).cast("string"))
    return joined.select(page_of(F.col("record_id")).alias("page_id"), F.col("bytes").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", page_of(F.col("refers_to")).alias("refers_to"))
