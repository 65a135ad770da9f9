"""Headers made by hand: whole, cut off and damaged."""

from __future__ import annotations

import base64
from struct import pack

import pytest
from helpers import rows

from clipgrid.sources import headers as H
from clipgrid.sources import media as M
from clipgrid.sources.listing import walk_files


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + pack(">I4sIIBBBBB", 13, b"IHDR", w, h, 8, 2, 0, 0, 0) + b"crc!"


def gif(w, h):
    return b"GIF89a" + pack("<HHBBB", w, h, 0, 0, 0)


def bmp(w, h, old=False):
    body = pack("<IHH", 12, w, h) if old else pack("<Iii", 40, w, h)
    return b"BM" + pack("<IHHI", 100, 0, 0, 54) + body + bytes(30)


def jpeg(w, h, before=b"", marker=0xC2):
    exif = b"\xff\xe1" + pack(">H", 60_000) + b"\xff\xc0\x00\x11" * 14_999 + b"ab"
    table = b"\xff\xc4" + pack(">H", 6) + b"\x00\x01\x02\x03"
    return b"\xff\xd8" + exif + b"\xff\x01" + table + b"\xff\xff" + before + bytes([0xFF, marker]) + pack(">HBHHB", 11, 8, h, w, 1) + b"\x01\x11\x00\xff\xda"


def box(name, *content, wide=False):
    data = b"".join(content)
    return pack(">I4sQ", 1, name, len(data) + 16) + data if wide else pack(">I4s", len(data) + 8, name) + data


def track(handler, w, h, scale, duration, samples, version=0):
    times = pack(">BBHQQIQ", 1, 0, 0, 0, 0, scale, duration) if version else pack(">BBHIIII", 0, 0, 0, 0, 0, scale, duration)
    entry = box(b"avc1", bytes(24), pack(">HH", w, h), bytes(50))
    stbl = box(b"stbl", box(b"stsd", pack(">II", 0, 1), entry), box(b"stts", pack(">II", 0, len(samples)), *(pack(">II", n, d) for n, d in samples)))
    return box(b"trak", box(b"tkhd", bytes(84)), box(b"mdia", box(b"mdhd", times, bytes(4)), box(b"hdlr", bytes(8), handler, bytes(13)), box(b"minf", stbl)))


def mp4(w=640, h=360, samples=((90, 100), (10, 100)), version=0, last=True, wide=False, fill=200_000):
    sound = track(b"soun", 0, 0, 48_000, 10, [(7, 1)])
    moov = box(b"moov", box(b"mvhd", bytes(100)), sound, track(b"vide", w, h, 3000, sum(n * d for n, d in samples), samples, version))
    media = box(b"mdat", bytes(fill), wide=wide)
    return box(b"ftyp", b"isom", bytes(4)) + (media + moov if last else moov + media)


def avi(w, h, frames):
    main = pack("<14I", 40_000, 0, 0, 0, frames, 0, 1, 0, w, h, 0, 0, 0, 0)
    return b"RIFF" + pack("<I", 999) + b"AVI LIST" + pack("<I", 68) + b"hdrlavih" + pack("<I", 56) + main


WHOLE = {
    "a.png": (png(70_000, 3), ("png", 70_000, 3, 1, None, True)),
    "a.gif": (gif(640, 41), ("gif", 640, 41, 1, None, True)),
    "a.bmp": (bmp(300, -200), ("bmp", 300, 200, 1, None, True)),
    "b.bmp": (bmp(30, 20, old=True), ("bmp", 30, 20, 1, None, True)),
    "a.jpg": (jpeg(1234, 567), ("jpeg", 1234, 567, 1, None, True)),
    "b.jpg": (jpeg(8, 9, marker=0xC0), ("jpeg", 8, 9, 1, None, True)),
    "a.mp4": (mp4(), ("mp4", 640, 360, 100, 30.0, True)),
    "b.mp4": (mp4(version=1, last=False, wide=True), ("mp4", 640, 360, 100, 30.0, True)),
    "c.mp4": (mp4(samples=((20_000, 125),) * 9000, fill=10, version=1), ("mp4", 640, 360, 180_000_000, 24.0, True)),
    "d.mp4": (mp4(samples=()), ("mp4", 640, 360, None, None, True)),
    "a.avi": (avi(320, 240, 77), ("avi", 320, 240, 77, 25.0, True)),
    "a.mkv": (b"\x1a\x45\xdf\xa3" + bytes(40), ("mkv", None, None, None, None, True)),
}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_headers(name):
    data, want = WHOLE[name]
    assert H.facts(H.in_memory(data)) == want


@pytest.mark.parametrize("name", ["a.png", "a.gif", "a.bmp", "b.jpg", "d.mp4", "a.avi"])
def test_cut_and_damaged_headers_never_raise(name):
    data, want = WHOLE[name]
    facts = [H.facts(H.in_memory(data[:n])) for n in {*range(0, min(len(data), 400)), *range(max(0, len(data) - 900), len(data))}]
    assert all(f == want or f[1:] == (None, None, None, None, False) for f in facts) and facts[0][-1] is False
    for i in range(0, len(data), 1 + len(data) // 400):
        H.facts(H.in_memory(data[:i] + b"\xff\x00\xff" + data[i + 3 :]))


def test_tables_are_made_from_files(spark, tmp_path):
    for name, (data, _) in WHOLE.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "cut.mp4").write_bytes(mp4()[:5000])
    (tmp_path / "text.jpg").write_text("no image")
    (tmp_path / "empty.mov").write_bytes(b"")
    files = walk_files(spark, [str(tmp_path)])
    gone = spark.createDataFrame([(str(tmp_path / "gone.mp4"),), (None,)], "path string")
    found = H.media_facts(files.select("path").unionByName(gone))
    facts = {r.path and r.path.rsplit("/", 1)[1]: tuple(r)[1:] for r in found.collect()}
    assert {n: facts[n] for n in WHOLE} == {n: want for n, (_, want) in WHOLE.items()}
    assert not any(facts[n][-1] for n in ("cut.mp4", "text.jpg", "empty.mov", "gone.mp4", None))
    media, sizes = H.media_tables(found)
    clips = files.withColumnRenamed("path", "video_path")
    good = {r.video_path.rsplit("/", 1)[1] for r in M.filter_readable(clips, media).collect()}
    assert good == {"a.mp4", "b.mp4", "c.mp4", "d.mp4", "a.avi", "a.mkv"}
    images = spark.createDataFrame([(str(tmp_path / "a.jpg"),), (str(tmp_path / "text.jpg"),)], "key_frame_path string")
    assert [r[1:] for r in rows(M.with_image_size(images, sizes))] == [(1234, 567), (1920, 1080)]
    videos = {r.video_path.rsplit("/", 1)[1]: r[1:] for r in H.video_metadata(found).collect()}
    assert videos["a.mp4"] == (100, 640, 360, 30.0) and videos["cut.mp4"] == (0, 0, 0, None)


def test_files_are_read_in_ranges(tmp_path, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 64)
    (tmp_path / "a.mp4").write_bytes(mp4(fill=5_000_000))
    read, close = H.file_reader(f"file://{tmp_path}/a.mp4")
    asked = []
    assert H.facts(lambda a, n: asked.append(n) or read(a, n)) == WHOLE["a.mp4"][1]
    close()
    assert sum(asked) < 5000


def test_bytes_of_a_column(spark):
    df = spark.createDataFrame([(1, png(5, 6)), (2, None), (3, base64.b64decode("R0lGODlhAQABAAAAACw="))], "id int, content binary")
    assert rows(H.header_facts(df)) == [(1, "png", 5, 6, 1, None, True), (2, None, None, None, None, None, False), (3, "gif", 1, 1, 1, None, True)]
