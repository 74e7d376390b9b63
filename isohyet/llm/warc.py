"""WARC archives: writing with segmentation, chunked framing and revisits; reading with reassembly.

A payload is sent as an HTTP response with chunked transfer framing. A record block longer
than ``SEGMENT`` bytes is cut into a first segment and continuation records, which name
the first one's id, their number and, the last one, the total length. Reading groups the
segments by that origin id, orders them by number, verifies the total length and takes
the framing off. A payload equal to that of a record with a larger page id is not stored
again: a revisit record names that record.

Archives are text files whose row separator is the end of a WARC record, so that Spark
writes and reads them on any file system it knows. They are compressed by gzip, file by
file; the reader takes archives compressed file by file or record by record, or plain.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm.common import materialise, scratch_path

SEGMENT = 16 << 10
CHUNK = 4096
RECORDS_PER_FILE = 4000
VERSION = b"WARC/1.1"
DATE = b"2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
END = "\r\n\r\n"
REVISIT = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[at : at + size] for at in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; sizes may carry extensions, and trailers are passed over."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = line + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is not as long as it says")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: bytes, fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """Header and block, without the record's closing line ends."""
    lines = [VERSION, b"WARC-Type: " + kind, *(k + b": " + v for k, v in fields), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def _id(name: str) -> bytes:
    h = hashlib.md5(name.encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>".encode()


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, answer: int | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page: a revisit of page ``answer``, or a response in as many segments as it needs."""
    uri = (url or "about:blank").replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A").encode()
    common = [(b"WARC-Date", DATE), (b"WARC-Target-URI", uri), (b"WARC-Payload-Digest", b"sha1:" + digest.encode())]
    if page_id is not None:
        common.append((b"WARC-Page-Id", b"%d" % page_id))
    if answer is not None:
        mark = [(b"WARC-Record-ID", _id(f"revisit {page_id} {url} {digest}")), (b"WARC-Profile", REVISIT), (b"WARC-Refers-To", _id(f"response {answer} {digest}"))]
        return [record(b"revisit", mark + common, HTTP[: HTTP.index(b"\r\n") + 2] + b"\r\n")]
    origin = _id(f"response {page_id} {digest}")
    block = HTTP + chunked(payload)
    kind = [(b"Content-Type", b"application/http; msgtype=response")]
    if len(block) <= segment:
        return [record(b"response", [(b"WARC-Record-ID", origin), *common, *kind], block)]
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    out = [record(b"response", [(b"WARC-Record-ID", origin), *common, *kind, (b"WARC-Segment-Number", b"1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        own = [(b"WARC-Record-ID", _id(f"segment {k} {page_id} {digest}")), (b"WARC-Segment-Origin-ID", origin), (b"WARC-Segment-Number", b"%d" % k), *common[:2]]
        out.append(record(b"continuation", own + ([(b"WARC-Segment-Total-Length", b"%d" % len(block))] if k == len(parts) else []), part))
    return out


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write one record, or one series of segments, for each row of ``pages`` (page_id, url, html).

    Null html is an empty payload; a null url is written as about:blank. Of equal payloads,
    rows with the largest page_id become responses and the others revisits; rows with a
    null id are responses always.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    hashed = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    repeated = hashed.filter("page_id is not null").groupBy("digest").agg(F.max("page_id").alias("answer"), F.min("page_id").alias("least")).filter("least < answer").select("digest", "answer")
    repeated = materialise(repeated, "warc-repeated")  # Spark then knows its size and picks the join
    planned = hashed.join(repeated, "digest", "left").withColumn("answer", F.when(F.col("page_id") < F.col("answer"), F.col("answer")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for page_id, url, html, answer in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html or b""
                out += records_of(page_id, url, payload, sha1_base32(payload), answer, segment)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = planned.select("page_id", "url", F.col("html").cast("binary").alias("html"), "answer").mapInArrow(work, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    if archive[:2] == b"\x1f\x8b":
        archive = gzip.decompress(archive)
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines)}
        start, size = end + 4, int(fields["content-length"])
        if archive[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is not as long as it says")
        yield fields, archive[start : start + size]
        at = start + size + 4


_FIELDS = ("warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-page-id", "warc-refers-to", "warc-segment-origin-id", "warc-segment-number", "warc-segment-total-length")


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def read_records(spark: SparkSession, path: str, measure: bool = False) -> DataFrame:
    """Every record of the archives below ``path``: its fields and its block.

    With ``measure``, whole responses carry size and digest of their payload in the block's place.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.replace("-", "_") for f in _FIELDS]
        for batch in batches:
            for archive in batch.column(0):
                fields, blocks, sizes, digests = [], [], [], []
                for f, block in parse(archive.as_py()):
                    whole = measure and f["warc-type"] == "response" and "warc-segment-number" not in f
                    payload = payload_of(block) if whole else None
                    fields.append(f)
                    blocks.append(None if whole else block)
                    sizes.append(len(payload) if whole else None)
                    digests.append(sha1_base32(payload) if whole else None)
                columns = [pa.array([f.get(n) for f in fields], pa.string()) for n in _FIELDS]
                rest = [pa.array(blocks, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *rest], [*names, "block", "payload_bytes", "payload_digest"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    schema = ", ".join(f.replace("-", "_") + " string" for f in _FIELDS) + ", block binary, payload_bytes long, payload_digest string"
    return files.filter("length > 0").select("content").mapInArrow(work, schema)


def reassembled(records: DataFrame) -> DataFrame:
    """Whole blocks: unsegmented records as they are, and each first segment with its continuations.

    A missing segment, or a total length that does not fit, fails the job. Equal copies of
    a record keep their number: repeated continuations count once, repeated first segments
    each give a row.
    """
    plain = records.filter("warc_segment_number is null and warc_type <> 'continuation'")
    segments = records.filter("warc_segment_number is not null").select(
        F.coalesce("warc_segment_origin_id", "warc_record_id").alias("origin"), F.col("warc_segment_number").cast("int").alias("number"),
        F.col("warc_segment_total_length").cast("long").alias("total"), "block",
    )
    single = segments.groupBy("origin", "number").agg(F.first("block").alias("block"), F.max("total").alias("total"))
    joined = single.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"))
    whole = joined.select("origin", "total", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p.block)).alias("joined"), F.element_at("parts", -1).number.alias("last"), F.size("parts").alias("n"))
    fine = (F.length("joined") == F.col("total")) & (F.col("last") == F.col("n"))
    checked = whole.select("origin", F.when(F.coalesce(fine, F.lit(False)), F.col("joined")).otherwise(F.raise_error(F.concat(F.lit("segments of "), "origin", F.lit(" are incomplete"))).cast("binary")).alias("joined"))
    firsts = records.filter("warc_segment_number = '1'").withColumn("origin", F.col("warc_record_id")).drop("block")
    return plain.unionByName(firsts.join(checked, "origin").withColumn("block", F.col("joined")).drop("origin", "joined"))


def _payload() -> Column:
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if b is None else payload_of(b) for b in batch.to_pylist()], pa.binary())

    work.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(work, "binary")(F.col("block"))


def _measures() -> Column:
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            payloads = [payload_of(b) for b in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([len(p) for p in payloads], pa.int64()), pa.array([sha1_base32(p) for p in payloads], pa.string())], ["bytes", "digest"])

    work.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(work, "bytes long, digest string")(F.col("block"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, record_id, refers_to_id, declared_digest, payload (null for revisits)."""
    whole = reassembled(read_records(spark, path))
    payload = F.when(F.col("warc_type") == "response", _payload())
    return whole.select(
        F.col("warc_page_id").cast("long").alias("page_id"), F.col("warc_target_uri").alias("url"), F.col("warc_type").alias("record_type"),
        F.col("warc_record_id").alias("record_id"), F.col("warc_refers_to").alias("refers_to_id"), F.regexp_replace("warc_payload_digest", "^sha1:", "").alias("declared_digest"), payload.alias("payload"),
    )


def archive_round_trip(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: one row per row of ``pages``, read back from archives.

    A revisit's size and digest are those of the response it names. A response whose
    payload does not have the digest in its header fails the job. Rows with a null id are
    responses; repeated rows each give a row; empty tables give none; further columns are
    not read; payloads of any length are kept whole.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, segment)
    records = materialise(read_records(spark, path, measure=True), "warc-records")
    segmented = reassembled(records.filter("warc_segment_number is not null")).withColumn("measured", _measures())
    measured = segmented.withColumn("payload_bytes", F.col("measured.bytes")).withColumn("payload_digest", F.col("measured.digest")).drop("measured")
    columns = [F.col("warc_page_id").cast("long").alias("page_id"), F.col("warc_type").alias("record_type"), F.col("warc_record_id").alias("record_id"), F.col("warc_refers_to").alias("refers_to_id"), F.regexp_replace("warc_payload_digest", "^sha1:", "").alias("declared_digest"), "payload_bytes", "payload_digest"]
    told = materialise(records.filter("warc_segment_number is null").select(columns).unionByName(measured.select(columns)), "warc-read")
    wrong = F.raise_error(F.concat(F.lit("digest of "), "record_id", F.lit(" does not fit"))).cast("string")
    told = told.withColumn("payload_digest", F.when(F.col("record_type") == "revisit", F.lit(None).cast("string")).when(F.col("payload_digest") == F.col("declared_digest"), F.col("payload_digest")).otherwise(wrong))
    named = told.filter("record_type = 'response'").groupBy("record_id").agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("r_bytes"), F.first("payload_digest").alias("r_digest"))
    revisits = told.filter("record_type = 'revisit'").join(named.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = told.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(columns)
    return responses.unionByName(revisits.select("page_id", F.col("r_bytes").alias("payload_bytes"), F.col("r_digest").alias("payload_digest"), "record_type", "refers_to"))
