"""WARC archives compressed record by record with a shared Zstandard dictionary.

An archive (``.warc.zst``) starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed;
after it every record is a Zstandard frame of its own, so that a reader can seek to any record.  The dictionary is
trained on a bounded sample of the records to be written.  Records with equal payloads of at least ``min_revisit`` bytes
are written once, by the page with the largest id; the others are *revisit* records without payload.  Which pages those
are is found on ids and digests alone; payloads go from the scan to the archive without a shuffle, unless there are more
revisits than ``BROADCAST_REVISITS``, when the pages of at least ``min_revisit`` bytes are joined by their id.

An archive has at most ``ARCHIVE_RECORDS`` records and what one task scans; each has the dictionary at its start.  A
record's id is made of the page's id and the payload's digest.

Archives are written by Spark's own committer to the file system of the path, so that no executor writes to its local
disk, retried tasks leave no half-written archive, and any store Spark can reach will do: each task hands over its
frames in order to the text writer, which starts a new file after so many of them; the "line separator" between them is an empty skippable frame of eight ASCII
bytes, which every Zstandard reader skips.

Edge cases: a null payload is empty; a null url has no target line; rows that repeat the largest id of a group of equal
payloads are all responses; rows without an id are written as responses and read back with a null id; an empty table
gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoplane.checkpoints import cut

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
#: An empty skippable frame: magic 0x184D2A50 and a length of zero.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
#: Records the dictionary is trained on, the longest of them, and the dictionary's size, in records and bytes.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 64 * 1024, 64 * 1024
#: Records of an archive at most, and revisits (about 60 bytes each) that are broadcast at most.
ARCHIVE_RECORDS, BROADCAST_REVISITS = 20_000, 200_000
DATE = "2024-01-01T00:00:00Z"


def _record_id(page_id: int | None, digest: str) -> str:
    """The first 63 bits of the digest, a bit that is set where there is no page id, and the page id."""
    return f"<{uuid.UUID(int=(int(digest[:16], 16) >> 1) << 65 | (page_id is None) << 64 | (page_id or 0) % 2**64).urn}>"


def _page_id(record_id: str) -> int | None:
    found = uuid.UUID(record_id.strip("<>").removeprefix("urn:uuid:")).int
    low = found % 2**64
    return None if found >> 64 & 1 else low - (2**64 if low >= 2**63 else 0)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, size: int, digest: str) -> bytes:
    """One WARC/1.1 record; ``size`` and ``digest`` (hex SHA-1) are of the full payload, which a revisit leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Refers-To-Date: {DATE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the records themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def dictionary_frame(data: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(data)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """``(offset, length, record)`` of each compressed record of an archive."""
    view, at, decompressor = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic = struct.unpack_from("<I", view, at)[0]
        if magic in SKIPPABLE:
            (size,) = struct.unpack_from("<I", view, at + 4)
            if magic == DICTIONARY_MAGIC:
                decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(decompressor.decompress(view[at + 8 : at + 8 + size])))
            at += 8 + size
            continue
        stream, out, start = decompressor.decompressobj(), [], at
        while not stream.eof:
            piece = view[at : at + 65536]
            if not piece:
                raise ValueError("archive ends inside a record")
            out.append(stream.decompress(piece))
            at += len(piece)
        at -= len(stream.unused_data)
        yield start, at - start, b"".join(out)


def parse(data: bytes) -> tuple[int | None, str | None, str, int | None, int, str, bytes]:
    """``(page_id, url, type, refers_to, payload size, hex digest, payload)`` of a record; checks length and digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record length does not fit")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload digest does not fit")
    refers = fields.get("WARC-Refers-To")
    return _page_id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, _page_id(refers) if refers else None, size, digest, payload


def write(pages: DataFrame, path: str, min_revisit: int = 1000, level: int = 6) -> list[str]:
    """Write a record for every row of ``pages`` (``page_id, url, html``) below ``path``; returns the archives' names."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).select(
        "*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size")
    )
    named = (F.col("size") >= min_revisit) & F.col("page_id").isNotNull()
    narrow = rows.where(named).select("page_id", "digest", "size")
    equal = narrow.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = cut(narrow.join(equal, ["digest", "size"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct())
    if revisits.count() <= BROADCAST_REVISITS:
        met = rows.join(F.broadcast(revisits), ["page_id", "digest"], "left")
    else:
        met = rows.where(named).join(revisits, ["page_id", "digest"], "left").unionByName(rows.where(~named).withColumn("refers_to", F.lit(None).cast("long")))
    typed = met.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "refers_to", "size", "digest")
    total = rows.where(F.col("size") <= SAMPLE_BYTES).count()
    share = min(1.0, SAMPLE_RECORDS / max(1, total)) * 1_000_003
    sample = rows.where((F.col("size") <= SAMPLE_BYTES) & (F.pmod(F.xxhash64("page_id", F.lit("warc")), F.lit(1_000_003)) < share))
    trained = build_dictionary([record(r.page_id, r.url, bytes(r.payload), None, r.size, r.digest) for r in sample.orderBy("page_id", "digest").limit(2 * SAMPLE_RECORDS).collect()])

    most = ARCHIVE_RECORDS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(trained), write_checksum=True, write_content_size=True)
        head = dictionary_frame(trained) if trained else b""
        written = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    page_id, url, body, refers_to, size, digest = r
                    if written % most == 0 and head:
                        out.append(head)
                    written += 1
                    out.append(compressor.compress(record(page_id, url, body or b"", refers_to, size, digest)))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    packed = typed.mapInArrow(pack, "frame binary").select(F.col("frame").cast("string").alias("value"))
    packed.write.option("lineSep", SEPARATOR).option("compression", "none").option("maxRecordsPerFile", most + bool(trained)).text(path)
    return _rename(spark, path)


def _rename(spark: SparkSession, path: str) -> list[str]:
    """Give the archives their customary suffix, through the path's own file system."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = []
    for k, status in enumerate(sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName())):
        old = status.getPath()
        if old.getName().startswith("part-"):
            if status.getLen() == 0:
                fs.delete(old, False)
                continue
            names.append(f"{old.getName().removesuffix('.txt')}.warc.zst")
            fs.rename(old, jvm.org.apache.hadoop.fs.Path(folder, names[-1]))
    return names


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives below ``path``: ids, types, sizes and digests, where they lie, and on demand payloads."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    if with_payload:
        schema, kinds = schema + ", payload binary", [*kinds, pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                archive = batch.column(0)[k].as_py().rsplit("/", 1)[-1]
                rows = []
                for offset, length, data in frames(batch.column(1)[k].as_py()):
                    page_id, url, kind, refers, size, digest, payload = parse(data)
                    rows.append((page_id, url, kind, refers, size, digest, archive, offset, length, payload)[: len(kinds)])
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select("path", "content").mapInArrow(unpack, schema)
