"""WARC archives compressed record by record with a shared Zstandard dictionary.

An archive file is a sequence of Zstandard frames: a skippable frame that holds the
dictionary, then one frame per record, so that a reader can start at any record.
Archives are of bounded size, so that one can be read as a whole. They are written by Spark's text sink, one row a file, whose line separator is set to an empty
skippable frame: decoders pass over it, and any store that Spark can write to will do.

Of the pages with equal payloads, the one with the largest id is archived as a
response; the others become revisit records that name it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm.support import text_bytes
from surveyloom.sources.scratch import scratch_path

DICTIONARY_FRAME = 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
DICTIONARY_MAGIC = 0xEC30A437
ARCHIVE_DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAMPLE_RECORDS = 1000
SAMPLE_RECORD_BYTES = 32 << 10
DICTIONARY_BYTES = 64 << 10
ARCHIVE_BYTES = 32 << 20
LEVEL = 6

PAGE_SCHEMA = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint, payload binary"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _header_value(value: str) -> str:
    """Control characters percent-encoded, so that a value stays on its line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url, payload: bytes, revisit: bool, refers_to) -> bytes:
    digest = payload_digest(payload)
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", ARCHIVE_DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _header_value(url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest))]
        fields.append(("X-Refers-To-Page-ID", str(refers_to)))
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: Iterator[bytes]) -> dict[str, str]:
    pairs = (line.decode().split(":", 1) for line in iter(lambda: next(lines).rstrip(b"\r\n"), b""))
    return {name.strip().lower(): value.strip() for name, value in pairs}


def read_records(stream) -> Iterator[dict]:
    """Records of an open, decompressed archive, with payloads checked against their digests."""
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {version[:20]!r}")
        fields = _fields(iter(stream.readline, None))
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("record does not end where its length says")
        head, _, body = block.partition(b"\r\n\r\n")
        http = _fields(iter([*head.split(b"\r\n")[1:], b""]))
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        revisit = fields["warc-type"] == "revisit"
        if not revisit and payload_digest(body) != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
        number = lambda name: int(fields[name]) if name in fields else None
        yield {
            "page_id": number("x-page-id"),
            "url": fields.get("warc-target-uri"),
            "payload_bytes": int(http["content-length"]),
            "payload_digest": digest,
            "record_type": fields["warc-type"],
            "refers_to": number("x-refers-to-page-id"),
            "payload": None if revisit else body,
        }


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def _as_dictionary(data: bytes):
    import zstandard as zstd

    trained = len(data) >= 4 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC
    return zstd.ZstdCompressionDict(data, zstd.DICT_TYPE_FULLDICT if trained else zstd.DICT_TYPE_RAWCONTENT)


def open_archive(content: bytes):
    """A buffered reader over all records of one archive file."""
    import zstandard as zstd

    magic, size = struct.unpack("<II", content[:8])
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    reader = zstd.ZstdDecompressor(dict_data=_as_dictionary(content[8 : 8 + size]))
    frames = reader.stream_reader(io.BytesIO(memoryview(content)[8 + size :]), read_across_frames=True)
    return io.BufferedReader(frames, 1 << 20)


def with_decisions(pages: DataFrame) -> DataFrame:
    """Pages with payload, and for copies the id of the page that stands for them.

    Digests are counted on narrow rows. What comes of it is joined to the payloads
    by page and digest, not by digest alone, so a payload that many pages share
    does not gather those pages in one task.
    """
    rows = pages.select("page_id", "url", text_bytes(F.col("html")).alias("payload")).withColumn(
        "digest", F.sha1("payload")
    )
    narrow = rows.select("page_id", "digest")
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    copies = (
        narrow.join(groups, "digest").where("not(page_id <=> top)")
        .select(F.col("page_id").alias("copy_id"), F.col("digest").alias("copy_digest"), "top").distinct()
    )
    same = F.col("page_id").eqNullSafe(F.col("copy_id")) & (F.col("digest") == F.col("copy_digest"))
    return rows.join(copies, same, "left").select(
        "page_id", "url", "payload", F.col("copy_digest").isNotNull().alias("revisit"), "top"
    )


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from at most SAMPLE_RECORDS records of at most SAMPLE_RECORD_BYTES each.

    The sample takes the pages with the smallest hashes of id and address; only
    what the compressor remembers depends on it, not what is archived.
    """
    import zstandard as zstd

    order = F.xxhash64("page_id", "url").alias("h")
    smallest = pages.select(order).orderBy("h").limit(SAMPLE_RECORDS).agg(F.max("h")).first()[0]
    if smallest is None:
        return b""
    size = F.octet_length(text_bytes(F.col("html")))
    sample = (
        pages.select("page_id", "url", text_bytes(F.col("html")).alias("payload"), order)
        .where((F.col("h") <= smallest) & (size <= SAMPLE_RECORD_BYTES))
        .orderBy("h", "page_id", "url").limit(SAMPLE_RECORDS).collect()
    )
    records = [record(r["page_id"], r["url"], bytes(r["payload"]), False, None) for r in sample]
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstd.ZstdError:  # too few records to train on: they are the dictionary
        return (b"".join(records) or b"WARC/1.1\r\n")[-DICTIONARY_BYTES:]


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write pages (page_id, url, html) as archive files under `path`.

    Every row that a task passes on is a whole archive, its dictionary in front, of
    ARCHIVE_BYTES or one record more, and becomes a file of its own.

    * Null html: empty payload. Null url: no target field. Null page_id: no id field;
      it counts as smaller than any id.
    * Rows that repeat an id and payload share a fate: all responses, or all revisits.
    * Empty table: a folder without archives. Other columns are ignored.
    """
    spark = pages.sparkSession
    dictionary = spark.sparkContext.broadcast(train_dictionary(pages))

    def run(batches):
        import zstandard as zstd

        writer = zstd.ZstdCompressor(level=LEVEL, dict_data=_as_dictionary(dictionary.value))
        lead = dictionary_frame(dictionary.value)
        frames, held = [lead], 0

        def archive():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(frames)], pa.binary())], names=["archive"])

        for batch in batches:
            for page_id, url, payload, revisit, top in zip(*batch.columns):
                frames.append(
                    writer.compress(record(page_id.as_py(), url.as_py(), payload.as_py(), revisit.as_py(), top.as_py()))
                )
                held += len(frames[-1])
                if held > archive_bytes:
                    yield archive()
                    frames, held = [lead], 0
        if held:
            yield archive()

    archives = with_decisions(pages).mapInArrow(run, "archive binary").select(F.col("archive").cast("string"))
    archives.write.option("maxRecordsPerFile", 1).text(path, lineSep=EMPTY_FRAME.decode())


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under `path`; revisits have no payload of their own."""

    def run(batches):
        names = [field.split()[0] for field in PAGE_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def as_batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names
            )

        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                if not len(content.as_buffer()):
                    continue
                for row in read_records(open_archive(content.as_py())):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, PAGE_SCHEMA)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages in the shared folder and read the archives back."""
    path = scratch_path(pages.sparkSession, "archives")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
