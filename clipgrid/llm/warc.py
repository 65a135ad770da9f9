"""WARC archives: writing, normalising and reading back.

*Writing.* One record per page goes through Spark's text writer, which compresses every file as one gzip stream and commits
it whole, on any store that Spark can write. The records of a file end at ``RECORDS``. Of pages with equal payloads the
one with the smallest id is stored, the others become revisit records that refer to it; only digests and ids are
shuffled to find that out, as long as the list of revisits is small enough for Spark to broadcast.

*Normalising.* Such a file can only be read from its beginning. The normaliser inflates each stream once, in pieces,
rewrites every record as a gzip member of its own and writes a sidecar of JSON lines with the offset and length of each
member. Files appear under their final name when they are complete, so a task that is run again replaces them by the same.

*Reading.* A reader takes the sidecars, seeks to each member and inflates only that.

A null payload is empty, a null or unfit URL becomes ``urn:page:<id>``. A row with a null page_id is stored if no row with
an id has the same payload. Rows that share both smallest id and payload are all stored. Empty tables give an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipgrid.llm.common import small_slices
from clipgrid.session import cut_lineage, shared_folder

RECORDS, LEAST_BYTES, DATE, PIECE = 1000, 0, "2020-01-01T00:00:00Z", 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNFIT = re.compile(r"[\x00-\x20\x7f<>]")
INDEX = "archive string, offset long, length long, record_type string, record_id string, page_id long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisits: bool, date: str = DATE) -> bytes:
    """One record without the two line ends that follow it."""
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits else http + payload
    uri = url if url and not _UNFIT.search(url) else f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}"]
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisits:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += [f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, sha1 and first (the page that is stored) of the pages that are not stored."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    digests = pages.select("page_id", F.sha1(payload).alias("sha1"), F.length(payload).alias("_bytes"))
    digests = cut_lineage(digests.where(F.col("_bytes") >= least_bytes).drop("_bytes"))
    first = digests.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # Pre-aggregated by id, so that a payload of very many pages is one row per page and no more.
    found = digests.join(first, "sha1").where("first IS NOT NULL AND NOT page_id <=> first")
    return found.select("page_id", "sha1", "first").distinct()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, records: int = RECORDS) -> None:
    """Every page as a record of monolithic gzip archives in ``folder``. Needs page_id, url and html."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    known = cut_lineage(revisits(pages, least_bytes))
    known = known.select(F.col("page_id").alias("_page"), F.col("sha1").alias("_sha1"), "first")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.withColumn("sha1", F.sha1(payload))
    rows = rows.join(known, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha1") == F.col("_sha1")), "left")
    rows = rows.select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "html"):
            cells = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            out = [record(p, u, (h or "").encode(), f, f is not None) for p, u, h, f in cells]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    writer = lines.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records)
    writer.text(folder)


class Records:
    """Splits the pieces of an inflated stream into whole records."""

    def __init__(self) -> None:
        self.held = bytearray()

    def feed(self, piece: bytes) -> Iterator[bytes]:
        self.held += piece
        at = 0
        while True:
            end = self.held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            length = re.search(rb"\r\nContent-Length:[ \t]*(\d+)", bytes(self.held[at : end + 2]), re.IGNORECASE)
            if not self.held.startswith(b"WARC/", at) or not length:
                raise ValueError("not a WARC record")
            close = end + 4 + int(length[1])
            if len(self.held) < close + 4:
                break
            yield bytes(self.held[at : close + 4])
            at = close + 4
        del self.held[:at]


def inflated(stream: memoryview) -> Iterator[bytes]:
    """A gzip stream of any number of members, in pieces of bounded size."""
    engine = zlib.decompressobj(31)
    for at in range(0, len(stream), PIECE):
        piece = stream[at : at + PIECE]
        while len(piece):
            yield engine.decompress(piece, 4 * PIECE)
            while engine.unconsumed_tail and not engine.eof:
                yield engine.decompress(engine.unconsumed_tail, 4 * PIECE)
            piece = b""
            if engine.eof:
                piece, engine = engine.unused_data, zlib.decompressobj(31)
    yield engine.flush()


def headers(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        found[key.strip().lower()] = value.strip()
    return found


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder that is given as Spark names it."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def normalise(spark: SparkSession, archives: str, folder: str) -> DataFrame:
    """Rewrites the archives of a folder into ``folder``, a member per record, each with its sidecar; gives their names."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(archives).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        files.create_dir(root)
        for batch in batches:
            for row in range(batch.num_rows):
                name = posixpath.basename(batch.column(0)[row].as_py()).removesuffix(".gz").removesuffix(".txt") + ".warc.gz"
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                index, at, records = [], 0, Records()
                with files.open_output_stream(part, compression=None) as out:
                    for piece in inflated(memoryview(batch.column(1)[row].as_buffer())):
                        for whole in records.feed(piece):
                            deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                            member = deflate.compress(whole) + deflate.flush()
                            out.write(member)
                            head = headers(whole[: whole.index(b"\r\n\r\n")])
                            page = head.get("x-page")
                            index.append({"archive": name, "offset": at, "length": len(member), "record_type": head["warc-type"], "record_id": head["warc-record-id"], "page_id": int(page) if page else None})
                            at += len(member)
                if records.held:
                    raise ValueError(f"{name} ends inside a record")
                with files.open_output_stream(f"{part}.index", compression=None) as out:
                    out.write("".join(json.dumps(x) + "\n" for x in index).encode())
                files.move(part, f"{root}/{name}")
                files.move(f"{part}.index", f"{root}/{name}.index.json")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64())], ["archive", "records"])

    return cut_lineage(found.mapInArrow(run, "archive string, records long"))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecars of a folder of normalised archives."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.index.json").json(folder)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` names, read from their offsets; RECORD has the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        name, source = None, None
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != name:
                    if source:
                        source.close()
                    name, source = archive, files.open_input_file(f"{root}/{archive}")
                whole = zlib.decompress(source.read_at(length, offset), 31)
                rows.append(parse(whole))
                held += len(whole)
                if held > 8 * PIECE:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)
        if source:
            source.close()

    return index.select("archive", "offset", "length").mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "payload")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def parse(whole: bytes) -> tuple:
    """The columns RECORD of one record; a stored payload must have the digest that its record states."""
    cut = whole.index(b"\r\n\r\n")
    head = headers(whole[:cut])
    block = whole[cut + 4 : -4]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
    if kind == "response" and digest32(payload) != digest:
        raise ValueError(f"digest of {head['warc-record-id']} does not match")
    number = lambda key: int(head[key]) if key in head else None
    return number("x-page"), number("x-payload-length"), digest, kind, number("x-refers-to-page"), head["warc-target-uri"], payload


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes, normalises and reads back all pages, in a folder below the checkpoint folder."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_archives(pages, f"{folder}/raw")
    normalise(spark, f"{folder}/raw", f"{folder}/archives")
    found = read_records(read_index(spark, f"{folder}/archives"), f"{folder}/archives")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
