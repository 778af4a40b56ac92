"""WARC archives of individually compressed records with a shared Zstandard dictionary.

A page becomes a ``response`` record, or a ``revisit`` of the page of least id with an equal payload. The dictionary
is built from a bounded sample of records, of least hash; each archive begins with a skippable frame
that holds it, and each record is a frame of its own, so a reader can take any record by its offset after reading
the first frame. Archives are rows ``(archive, part, data)`` of a Parquet folder, since Spark's writers reach
every store: the parts of an archive, joined in order, are a ``.warc.zst`` file.

Digests fold before they are shuffled; pages meet the responses they revisit in one join, which Spark
may split where a payload is very common.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import least_hashed, shared_path, stored

#: Fixed values of the format: a skippable frame of this number holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 65_536, 65_536
PART_BYTES, CHUNK = 4 << 20, 8192
DATE = "1970-01-01T00:00:00Z"
ARCHIVES = "archive STRING, part INT, data BINARY"
RECORDS = ("page_id BIGINT, payload_bytes BIGINT, payload_digest STRING, record_type STRING, refers_to BIGINT, "
           "url STRING, payload BINARY, archive STRING, offset BIGINT")
KINDS = {"BIGINT": pa.int64(), "STRING": pa.string(), "BINARY": pa.binary()}
ARROW_RECORDS = pa.schema([(name, KINDS[kind]) for name, kind in (field.split() for field in RECORDS.split(", "))])
LINE = b"\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def header_value(text: str | None) -> str:
    """One header line's worth of a URL: control characters and blanks are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in text or "")


def record(page_id: int | None, url: str | None, payload: bytes, first: dict | None) -> bytes:
    """A response with its payload, or a revisit of ``first`` = ``{page_id, url}`` with the headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first else http + payload
    fields = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
              ("WARC-Target-URI", header_value(url)), ("WARC-Payload-Digest", "sha1:" + payload_digest(payload))]
    if first:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", record_id(first["page_id"])), ("WARC-Refers-To-Target-URI", header_value(first["url"]))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + head.encode() + LINE + block + LINE + LINE


def headers(lines: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in lines.decode().split("\r\n")[1:])


def read_record(data: bytes) -> dict:
    """Fields of a record; the digest of a response is verified against its payload."""
    head, rest = data.split(LINE + LINE, 1)
    fields = headers(head)
    block = rest[:int(fields["Content-Length"])]
    http, payload = block.split(LINE + LINE, 1)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and payload_digest(payload) != digest:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")

    def page(value: str | None) -> int | None:
        name = (value or "<urn:page:none>")[len("<urn:page:"):-1]
        return None if name == "none" else int(name)

    return {"page_id": page(fields["WARC-Record-ID"]), "payload_bytes": int(headers(http)["Content-Length"]), "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To")),
            "url": fields["WARC-Target-URI"], "payload": None if revisit else payload}


# the dictionary -------------------------------------------------------------------------------------

def build_dictionary(pages: DataFrame, records: int = SAMPLE_RECORDS, most_bytes: int = SAMPLE_BYTES) -> bytes:
    """A dictionary from the ``records`` records of least hash among those whose payload has at most ``most_bytes``.

    Samples too few or too small for training become the dictionary as they are; without any it is empty.
    """
    some = least_hashed(pages.filter(F.octet_length("html") <= most_bytes), records, "page_id", "html")
    samples = [record(r["page_id"], r["url"], r["html"].encode(), None) for r in some.select("page_id", "url", "html").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def skippable_frame(content: bytes) -> bytes:
    return DICTIONARY_FRAME.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


# archives -------------------------------------------------------------------------------------------

def _write_archives(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"pages-{TaskContext.get().partitionId():06d}"
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True)
        part, data, size, started = 0, [skippable_frame(dictionary)] if dictionary else [], 0, False

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([part], pa.int32()), pa.array([b"".join(data)], pa.binary())], ["archive", "part", "data"])

        for batch in batches:
            for page_id, url, html, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2),
                                                 batch.column(3).to_pylist()):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                data.append(compressor.compress(record(page_id, url, payload, first)))
                started, size = True, size + len(data[-1])
                if size >= PART_BYTES:
                    yield flush()
                    part, data, size, started = part + 1, [], 0, False
        if started:
            yield flush()

    return run


def write_archives(pages: DataFrame, out: str, least_bytes: int = 0) -> None:
    """Archive every row of ``pages(page_id, url, html)``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one of least ``page_id`` is a response, a null id
    coming last; of equal ids the least URL decides, and equal rows after that are told apart by nothing, so each
    but one of them revisits. A null html is the empty payload.
    """
    dictionary = build_dictionary(pages)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    rank = F.struct(F.col("page_id").isNull().alias("last"), "page_id", F.col("url").isNull().alias("none"), "url")
    narrow = stored(rows.filter(F.octet_length("html") >= least_bytes).select("digest", "page_id", "url"), "digests")
    same = narrow.groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"))
    firsts = same.groupBy("digest").agg(F.min(rank).alias("first"), F.sum("n").alias("n"), F.max("n").alias("equal"))
    firsts = stored(firsts.filter("n > 1").select("digest", "first", "equal"), "payloads")
    met = rows.join(firsts, "digest", "left")
    is_first = rank.eqNullSafe(F.col("first"))
    if not firsts.filter("equal > 1").isEmpty():
        met, is_first = _one_response(met, is_first), F.col("chosen")
    plain = F.col("first").isNull() | is_first
    target = F.when(~plain, F.struct(F.col("first.page_id").alias("page_id"), F.col("first.url").alias("url")))
    met.select("page_id", "url", "html", target.alias("first")).mapInArrow(
        _write_archives(dictionary), ARCHIVES).write.parquet(out)


def _one_response(met: DataFrame, is_first) -> DataFrame:
    """Choose one of the equal rows that hold a payload's least rank.

    Only rows that repeat id, URL and payload come here; a partition numbers its own, then one row per digest
    and partition says which partition's first is the response.
    """
    marked = stored(met.withColumn("least", is_first).withColumn("place", F.monotonically_increasing_id()), "pages")
    chosen = marked.filter("least").groupBy("digest").agg(F.min("place").alias("chosen_place"))
    chosen = stored(chosen, "chosen").withColumnRenamed("digest", "of")
    joined = marked.join(chosen, marked["digest"] == chosen["of"], "left")
    return joined.withColumn("chosen", F.col("place").eqNullSafe(F.col("chosen_place")))


def _read_archives(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        decompressor = zstandard.ZstdDecompressor(dict_data=shared)
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, rows, size, view = leading_frame(data)[1], [], 0, memoryview(data)
                while at < len(data):
                    frame, pieces, end = decompressor.decompressobj(), [], at
                    while not frame.eof:
                        pieces.append(frame.decompress(view[end:end + CHUNK]))
                        end = min(end + CHUNK, len(data))
                    raw = b"".join(pieces)
                    rows.append(read_record(raw) | {"archive": archive, "offset": at})
                    at, size = end - len(frame.unused_data), size + len(raw)
                    if size > PART_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW_RECORDS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW_RECORDS)

    return run


def leading_frame(data: bytes) -> tuple[bytes, int]:
    """The dictionary at the begin of an archive, if there is one, and the place of the first record."""
    if data[:4] != DICTIONARY_FRAME.to_bytes(4, "little"):
        return b"", 0
    end = 8 + int.from_bytes(data[4:8], "little")
    return bytes(data[8:end]), end


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record: page, payload size and digest, type, the response it refers to, and its place.

    ``offset`` counts from the begin of the archive's part. The archives of a folder are written together and
    share the dictionary in their first frames, of at most ``DICTIONARY_BYTES``, which is read from one of them.
    """
    parts = spark.read.schema(ARCHIVES).parquet(path)
    head = parts.filter("part = 0").select(F.substring("data", 1, 8 + DICTIONARY_BYTES)).first()
    dictionary = leading_frame(bytes(head[0]))[0] if head else b""
    return parts.select("archive", "data").mapInArrow(_read_archives(dictionary), RECORDS)


def archive(pages: DataFrame, out: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write to ``out``, or a new folder below the shared one, and read back."""
    out = out or shared_path(pages.sparkSession, "warc")
    write_archives(pages, out, least_bytes)
    return read_archives(pages.sparkSession, out)
