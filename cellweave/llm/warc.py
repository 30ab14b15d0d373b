"""Operator 3: WARC archives in seekable Zstandard bundles.

Pages become WARC/1.1 records.  Of records with equal payloads of at least ``min_revisit`` bytes,
that with the largest page id is a response and the others are revisits that refer to it; smaller
payloads are always responses.  Records are grouped into frames of about ``frame_bytes``, each an
independent Zstandard frame; a bundle (one file per task, cut at ``bundle_bytes``) ends with a
footer seek table, the public seekable format: a skippable frame that lists the sizes of all
frames.  An index maps each record id to its bundle, frame and offset within the frame, so that
``read_records`` fetches records by id: it seeks their frames and parses nothing else in them;
``read_bundles`` scans whole bundles by their seek tables.

Plan: digests are computed in the JVM; (digest, largest id) of repeated payloads is one partial
aggregation, joined back on the digest, where Spark splits a hot digest; short payloads, which refer
to nothing, are spread by row instead; only responses send their html to Python.  Bundles are written
to the shared folder under a name of the attempt and renamed when complete, so a repeated task
replaces nothing half-written, and the index is written in the same job.  Reading deals frames (or
bundles) out to as many tasks as their bytes ask for.

Defined cases: null html is an empty payload; a null page id is kept as null and counts as the
smallest; of rows that tie in payload and id one is the response; null urls become an empty
target; very long payloads are frames of their own; further columns of the input, whatever their
names, aren't read; an empty table gives no bundles and no rows.  Rows are told apart by their place in the
input, so an input that isn't a stored table must be written first (``stored=False`` does).
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, input_rows, materialize, new_folder

#: Fixed values of the public seekable format: magic numbers and the empty descriptor.
SKIPPABLE, SEEKABLE, DESCRIPTOR = 0x184D2A5E, 0x8F92EAB1, 0
INDEX = "record_id string, page_id long, bundle string, frame int, frame_offset long, offset_in_frame long, record_bytes long"
RECORDS = "record_id string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Footer for frames of these (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), DESCRIPTOR, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame, from the end of a bundle."""
    size = file.size()
    file.seek(size - 9)
    n, descriptor, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    each = 12 if descriptor & 0x80 else 8
    file.seek(size - 9 - n * each)
    table, out, at = file.read(n * each), [], 0
    for i in range(n):
        packed, full = struct.unpack_from("<II", table, i * each)
        out.append((at, packed, full))
        at += packed
    return out


def warc_record(record_id: str, kind: str, page_id, url: str, digest: str, size: int, refers, payload: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {''.join((url or '').splitlines())}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers is not None:
            head.append(f"X-Refers-To-Page: {refers}")
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, payload) of each record in a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start = end + 4
        n = int(headers["Content-Length"])
        yield at, headers, data[start : start + n]
        at = start + n + 4


class Bundle:
    """One archive file in the making."""

    def __init__(self, folder: str, frame_bytes: int):
        self.files, base = fs.FileSystem.from_uri(folder)
        self.files.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.path = f"{base}/{self.name}"
        self.out = self.files.open_output_stream(self.path + ".part")
        self.frame_bytes, self.frame, self.sizes, self.at, self.index = frame_bytes, io.BytesIO(), [], 0, []
        self.press = zstandard.ZstdCompressor(level=3)

    def add(self, record_id: str, page_id, record: bytes) -> None:
        if self.frame.tell() and self.frame.tell() + len(record) > self.frame_bytes:
            self.flush()
        self.index.append((record_id, page_id, self.name, len(self.sizes), self.at, self.frame.tell(), len(record)))
        self.frame.write(record)

    def flush(self) -> None:
        data = self.frame.getvalue()
        if data:
            packed = self.press.compress(data)
            self.out.write(packed)
            self.sizes.append((len(packed), len(data)))
            self.at += len(packed)
            self.frame = io.BytesIO()

    def close(self) -> list[tuple]:
        self.flush()
        self.out.write(seek_table(self.sizes))
        self.out.close()
        self.files.move(self.path + ".part", self.path)
        return self.index


def to_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def plan_records(pages: DataFrame, min_revisit: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", stored: bool = True) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to, row."""
    pages = pages if stored else materialize(input_rows(pages, id_col, url_col, html_col), "pages")
    rows = input_rows(pages, id_col, url_col, html_col).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.monotonically_increasing_id().alias("row"))
    # the largest (id, row) of each payload that occurs more than once
    first = rows.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.max(F.struct("page_id", "row")).alias("chief"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", F.col("chief.page_id").alias("chief_page"), F.col("chief.row").alias("chief_row"))
    key = F.when(F.col("payload_bytes") >= min_revisit, F.col("payload_digest")).otherwise(F.col("row").cast("string"))
    joined = rows.withColumn("key", key).join(first.withColumnRenamed("payload_digest", "key"), "key", "left")
    again = F.col("chief_row").isNotNull() & (F.col("row") != F.col("chief_row")) & (F.col("payload_bytes") >= min_revisit)
    return joined.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_digest", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("chief_page")).alias("refers_to"), "row")


def write_archive(pages: DataFrame, folder: str, min_revisit: int = 1000, frame_bytes: int = 1 << 18, bundle_bytes: int = 64 << 20, **options) -> DataFrame:
    """Write bundles and index below ``folder``; returns the index."""
    bound_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, digest, size, kind, refers, row = (c[i].as_py() for c in batch.columns)
                bundle = bundle or Bundle(f"{folder}/bundles", frame_bytes)
                record_id = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}:{row}:{digest}')}"
                bundle.add(record_id, page, warc_record(record_id, kind, page, url, digest, size, refers, payload or b""))
                if bundle.at >= bundle_bytes:
                    yield to_batch(bundle.close(), INDEX)
                    bundle = None
        if bundle:
            yield to_batch(bundle.close(), INDEX)

    plan_records(pages, min_revisit, **options).mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return read_index(pages.sparkSession, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """record_id -> bundle, frame, offsets.  Only bundles of tasks that succeeded are in it."""
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def row_of(headers: dict[str, str], payload: bytes) -> tuple:
    number = lambda k: int(headers[k]) if k in headers else None
    return headers["WARC-Record-ID"].strip("<>"), number("X-Page-ID"), headers["WARC-Target-URI"], headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:"), number("X-Payload-Length"), number("X-Refers-To-Page"), payload


def scanned(folder: str, bundles: Iterator[str], batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """All records of bundles, frame by frame."""
    files, base = fs.FileSystem.from_uri(f"{folder}/bundles")
    rows, held, unpack = [], 0, zstandard.ZstdDecompressor()
    for name in bundles:
        with files.open_input_file(f"{base}/{name}") as f:
            for at, packed, full in read_seek_table(f):
                f.seek(at)
                for _, headers, payload in parse_records(unpack.decompress(f.read(packed), max_output_size=full)):
                    rows.append(row_of(headers, payload))
                    held += len(payload)
                    if held >= batch_bytes:
                        yield to_batch(rows, RECORDS)
                        rows, held = [], 0
    if rows:
        yield to_batch(rows, RECORDS)


def sought(folder: str, places: Iterator[tuple[str, int, int, int, int]], batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """Records at (bundle, frame, frame's offset, offset in it, length); a frame is read once where its
    records follow one another."""
    files, base = fs.FileSystem.from_uri(f"{folder}/bundles")
    rows, held, unpack, file, open_name, open_frame, data = [], 0, zstandard.ZstdDecompressor(), None, None, None, b""
    for name, frame, frame_at, at, size in places:
        if name != open_name:
            if file:
                file.close()
            file, open_name, open_frame = files.open_input_file(f"{base}/{name}"), name, None
            table = read_seek_table(file)
        if frame != open_frame:
            file.seek(frame_at)
            data, open_frame = unpack.decompress(file.read(table[frame][1]), max_output_size=table[frame][2]), frame
        _, headers, payload = next(parse_records(data[at : at + size]))
        rows.append(row_of(headers, payload))
        held += len(payload)
        if held >= batch_bytes:
            yield to_batch(rows, RECORDS)
            rows, held = [], 0
    if file:
        file.close()
    if rows:
        yield to_batch(rows, RECORDS)


def tasks_for(index: DataFrame, task_bytes: int) -> int:
    return max(1, -(-(index.agg(F.sum("record_bytes")).first()[0] or 0) // task_bytes))


def read_bundles(spark: SparkSession, folder: str, task_bytes: int = 32 << 20, batch_bytes: int = 4 << 20) -> DataFrame:
    """All records of an archive; payload is empty for revisits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scanned(folder, (name for b in batches for name in b.column(0).to_pylist()), batch_bytes)

    index = read_index(spark, folder)
    return index.select("bundle").distinct().repartition(tasks_for(index, task_bytes), "bundle").mapInArrow(read, RECORDS)


def read_records(spark: SparkSession, folder: str, record_ids: DataFrame | None = None, task_bytes: int = 16 << 20, batch_bytes: int = 4 << 20) -> DataFrame:
    """Records by id (all, if none are named), through the offsets of the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sought(folder, (place for b in batches for place in zip(*(c.to_pylist() for c in b.columns), strict=True)), batch_bytes)

    index = read_index(spark, folder)
    if record_ids is not None:
        index = index.join(record_ids.select("record_id").distinct(), "record_id", "left_semi")
    where = index.select("bundle", "frame", "frame_offset", "offset_in_frame", "record_bytes")
    return where.repartition(tasks_for(index, task_bytes), "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset_in_frame").mapInArrow(read, RECORDS)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder, then fetch every record by its offsets."""
    folder = new_folder(pages.sparkSession, "warc")
    write_archive(pages, folder, **options)
    return read_records(pages.sparkSession, folder)


__all__ = ["archive_round_trip", "plan_records", "read_bundles", "read_index", "read_records", "write_archive"]
