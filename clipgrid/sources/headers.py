"""Sizes, frame counts and rates from the first bytes of media files. Pixels are never decoded.

Images: PNG, JPEG, GIF and BMP. Videos: MP4 and its relatives (boxes), AVI (main header); of Matroska only the signature is looked
at. Files are read in small ranges by the tasks, so a video of any length costs a few reads. A file that is cut off, damaged or of
another kind has null facts and is not readable; fragmented MP4 files have no frame count.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from struct import unpack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = "kind string, width long, height long, num_frames long, fps double, readable boolean"
#: Reads bytes: (offset, size), fewer at the end of the file.
Reader = Callable[[int, int], bytes]
#: JPEG markers that begin a frame, and those that stand alone.
_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
_ALONE = {0x01, *range(0xD0, 0xD8)}
_HOLDERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl")
#: Bytes of a file that are fetched at once.
CHUNK = 1 << 16


class _Cut(Exception):
    """The file ends too early."""


def _exactly(read: Reader, offset: int, size: int) -> bytes:
    data = read(offset, size)
    if len(data) < size:
        raise _Cut
    return data


def _png(read: Reader) -> tuple[int, int]:
    size, kind, width, height = unpack(">I4sII", _exactly(read, 8, 16))
    if kind != b"IHDR" or size != 13:
        raise _Cut
    return width, height


def _gif(read: Reader) -> tuple[int, int]:
    return unpack("<HH", _exactly(read, 6, 4))


def _bmp(read: Reader) -> tuple[int, int]:
    if unpack("<I", _exactly(read, 14, 4))[0] == 12:
        return unpack("<HH", _exactly(read, 18, 4))
    width, height = unpack("<ii", _exactly(read, 18, 8))
    return width, abs(height)  # rows from the top down have a negative height


def _jpeg(read: Reader) -> tuple[int, int]:
    at = 2
    while True:
        lead, marker = _exactly(read, at, 2)
        if lead != 0xFF:
            raise _Cut
        if marker == 0xFF:  # fill bytes
            at += 1
        elif marker in _ALONE:
            at += 2
        elif marker in _FRAMES:
            height, width = unpack(">HH", _exactly(read, at + 5, 4))
            return width, height
        elif marker in (0xD9, 0xDA):  # the end, or pixels without a frame
            raise _Cut
        else:
            at += 2 + unpack(">H", _exactly(read, at + 2, 2))[0]


_IMAGES = ((b"\x89PNG\r\n\x1a\n", "png", _png), (b"GIF87a", "gif", _gif), (b"GIF89a", "gif", _gif), (b"BM", "bmp", _bmp), (b"\xff\xd8", "jpeg", _jpeg))


def boxes(read: Reader, begin: int, end: int | None) -> Iterator[tuple[bytes, int, int]]:
    """Name, begin and end of the content of each box in a range; without an end, of the file."""
    while end is None or begin + 8 <= end:
        head = read(begin, 16)
        if len(head) < 8:
            if head or end is not None:
                raise _Cut
            return
        size, name, lead = unpack(">I", head[:4])[0], head[4:8], 8
        if size == 1:
            if len(head) < 16:
                raise _Cut
            size, lead = unpack(">Q", head[8:])[0], 16
        elif size == 0:  # up to the end
            size = (end if end is not None else 1 << 62) - begin
        if size < lead or (end is not None and begin + size > end):
            raise _Cut
        yield name, begin + lead, begin + size
        begin += size


def _track(read: Reader, begin: int, end: int) -> dict:
    """What the boxes of a track tell."""
    found: dict = {}
    for name, a, b in boxes(read, begin, end):
        if name in _HOLDERS:
            found |= _track(read, a, b)
        elif name == b"hdlr":
            found["handler"] = _exactly(read, a + 8, 4)
        elif name == b"mdhd":
            wide = _exactly(read, a, 1)[0] == 1
            found["scale"], found["duration"] = unpack(">IQ", _exactly(read, a + 20, 12)) if wide else unpack(">II", _exactly(read, a + 12, 8))
        elif name == b"stsd" and unpack(">I", _exactly(read, a + 4, 4))[0]:
            found["size"] = unpack(">HH", _exactly(read, a + 8 + 32, 4))
        elif name == b"stts":
            count = unpack(">I", _exactly(read, a + 4, 4))[0]
            if 8 + 8 * count > b - a:
                raise _Cut
            found["frames"] = 0
            for at in range(0, count, CHUNK // 8):
                some = min(CHUNK // 8, count - at)
                found["frames"] += sum(unpack(f">{2 * some}I", _exactly(read, a + 8 + 8 * at, 8 * some))[::2])
    return found


def _mp4(read: Reader) -> tuple[int | None, int | None, int | None, float | None]:
    for name, a, b in boxes(read, 0, None):
        if name != b"moov":
            continue
        for inner, x, y in boxes(read, a, b):
            if inner != b"trak":
                continue
            t = _track(read, x, y)
            if t.get("handler") == b"vide" and "size" in t:
                frames = t.get("frames") or None
                fps = frames * t["scale"] / t["duration"] if frames and t.get("duration") else None
                return *t["size"], frames, fps
    raise _Cut


def _avi(read: Reader) -> tuple[int, int, int, float | None]:
    if _exactly(read, 12, 4) != b"LIST" or _exactly(read, 20, 8) != b"hdrlavih":
        raise _Cut
    main = unpack("<10I", _exactly(read, 32, 40))
    return main[8], main[9], main[4], 1e6 / main[0] if main[0] else None


def facts(read: Reader) -> tuple[str | None, int | None, int | None, int | None, float | None, bool]:
    """kind, width, height, frames, rate, and whether the header is whole."""
    kind = None
    try:
        head = read(0, 16)
        for sign, name, size in _IMAGES:
            if head.startswith(sign):
                kind = name
                width, height = size(read)
                return kind, width, height, 1, None, width > 0 and height > 0
        if head[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free", b"skip"):
            kind = "mp4"
            width, height, frames, fps = _mp4(read)
            return kind, width, height, frames, fps, True
        if head[:4] == b"RIFF" and head[8:12] == b"AVI ":
            kind = "avi"
            return kind, *_avi(read), True
        if head[:4] == b"\x1a\x45\xdf\xa3":
            return "mkv", None, None, None, None, True
    except _Cut:
        pass
    return kind, None, None, None, None, False


def in_memory(data: bytes) -> Reader:
    return lambda offset, size: data[offset : offset + size]


def file_reader(path: str) -> tuple[Reader, Callable[[], None]]:
    """Ranged reads of a file on any store that pyarrow knows, and what closes it; the last chunk is kept."""
    from pyarrow import fs

    path = re.sub("^file:/+", "/", path)
    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    opened = store.open_input_file(name)
    held = [0, b""]

    def read(offset: int, size: int) -> bytes:
        if not held[0] <= offset <= offset + size <= held[0] + len(held[1]):
            if offset >= opened.size():
                return b""
            opened.seek(offset)
            held[:] = [offset, opened.read(max(size, CHUNK))]
        return held[1][offset - held[0] : offset - held[0] + size]

    return read, opened.close


def _with_facts(rows: DataFrame, column: str, of: Callable[[object], tuple]) -> DataFrame:
    names = [c.split()[0] for c in FACTS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
    rest = [c for c in rows.columns if c not in (*names, column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = zip(*(of(x) for x in batch.column(0).to_pylist()), strict=True)
                cells = [*batch.columns[1:], *(pa.array(c, t) for c, t in zip(found, types, strict=True))]
                yield pa.RecordBatch.from_arrays(cells, [*rest, *names])

    kinds = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest), FACTS])
    return rows.select(F.col(column).alias("_of"), *rest).mapInArrow(run, kinds)


def header_facts(rows: DataFrame, content: str = "content") -> DataFrame:
    """The other columns of ``rows`` and the facts of the bytes in ``content``; null bytes have none."""
    return _with_facts(rows, content, lambda data: facts(in_memory(data or b"")))


def _of_file(path: str | None) -> tuple:
    if path is None:
        return facts(in_memory(b""))
    try:
        read, close = file_reader(path)
    except OSError:
        return facts(in_memory(b""))
    try:
        return facts(read)
    finally:
        close()


def media_facts(files: DataFrame, path: str = "path") -> DataFrame:
    """path, kind, width, height, num_frames, fps and readable of the files of a listing; a missing file is not readable.

    Listings have few partitions and reads wait, so the paths are dealt out first.
    """
    named = files.select(F.col(path).alias("path"))
    return _with_facts(named.repartition("path").withColumn("_path", F.col("path")), "_path", _of_file)


def media_tables(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``media`` (video_path, readable) and ``sizes`` (path, width, height) for the functions of ``sources.media``."""
    sizes = found.filter("width IS NOT NULL").select("path", "width", "height")
    return found.select(F.col("path").alias("video_path"), "readable"), sizes


def video_metadata(found: DataFrame) -> DataFrame:
    """Frame count, size and rate of video files, as ``clip_metadata`` gives them for folders of images."""
    return found.filter("kind IN ('mp4', 'avi')").select(
        F.col("path").alias("video_path"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("num_frames", "width", "height")),
        "fps",
    )
