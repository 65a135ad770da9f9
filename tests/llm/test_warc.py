from __future__ import annotations

import gzip
import json
import random
from pathlib import Path

import pytest

from clipgrid.llm import warc

PAGES = "page_id long, url string, html string"


def read(spark, rows, schema=PAGES):
    return warc.archive_round_trip(spark.createDataFrame(rows, schema).repartition(3)).collect()


def test_every_page_comes_back_once(spark):
    rng = random.Random(5)
    bodies = ["", "a", "é" * 300, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nx", "\r\n\r\n" * 9, *("".join(rng.choices("abc<>\n", k=500)) for _ in range(20))]
    rows = [(i, f"http://h/{i}", rng.choice(bodies)) for i in range(200)] + [(500, None, None), (501, "bad url", "long" * 60000)]
    first = {}
    for i, _, body in rows:
        first.setdefault(body or "", i)
    found = {r.page_id: r for r in read(spark, rows)}
    assert len(found) == len(rows)
    for i, _, body in rows:
        data, r = (body or "").encode(), found[i]
        assert r.payload_bytes == len(data) and r.payload_digest == warc.digest32(data)
        here = first[body or ""]
        assert (r.record_type, r.refers_to) == (("response", None) if here == i else ("revisit", here))
    assert warc.digest32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_files_members_and_index(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(30)]
    raw, done = f"file://{tmp_path}/raw", f"file://{tmp_path}/done"
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), raw, records=12)
    archives = warc.normalise(spark, raw, done)
    assert sorted(r.records for r in archives.collect()) == [6, 12, 12]
    assert not [p for p in Path(tmp_path / "done").iterdir() if p.name.startswith(".") and p.suffix != ".crc"]
    for archive in (r.archive for r in archives.collect()):
        data = (tmp_path / "done" / archive).read_bytes()
        index = [json.loads(x) for x in (tmp_path / "done" / f"{archive}.index.json").read_text().splitlines()]
        assert [x["offset"] for x in index] == [sum(y["length"] for y in index[:i]) for i in range(len(index))]
        members = [gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]) for x in index]
        assert b"".join(members) == gzip.decompress(data) and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
        source = next((tmp_path / "raw").glob(f"{archive.removesuffix('.warc.gz')}*"))
        assert gzip.decompress(source.read_bytes()) == gzip.decompress(data)
    payloads = {r.page_id: (r.payload.decode(), r.uri) for r in warc.read_records(warc.read_index(spark, done), done).collect()}
    assert payloads == {i: (h, u) for i, u, h in rows}


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_streams_in_any_pieces(piece, monkeypatch):
    records = [warc.record(i, "http://h", bytes([65 + i]) * (40 * i), None, False) + b"\r\n\r\n" for i in range(5)]
    monkeypatch.setattr(warc, "PIECE", piece)
    whole = gzip.compress(b"".join(records[:2])) + gzip.compress(b"".join(records[2:]))
    held, found = warc.Records(), []
    for part in warc.inflated(memoryview(whole)):
        found += held.feed(part)
    assert found == records and not held.held


def test_damaged_records_fail():
    good = warc.record(1, "http://h", b"payload", None, False) + b"\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(good.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))
    with pytest.raises(ValueError, match="WARC"):
        list(warc.Records().feed(b"HTTP/1.1 200 OK\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))


def test_smaller_payloads_are_all_stored(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "aaaa"), (2, "u", "aaaa"), (3, "u", "b"), (4, "u", "b")], PAGES)
    assert [(r.page_id, r["first"]) for r in warc.revisits(df, least_bytes=2).collect()] == [(2, 1)]


def test_odd_rows(spark):
    rows = [(None, "u", "x"), (4, "u", "x"), (None, None, None), (None, "v", None), (9, "u", "same"), (9, "u", "same"), (10, "u", "same")]
    found = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in read(spark, rows))
    assert found == sorted(
        [("None", 1, "revisit", 4), ("4", 1, "response", None), ("None", 0, "response", None), ("None", 0, "response", None)]
        + [("9", 4, "response", None), ("9", 4, "response", None), ("10", 4, "revisit", 9)]
    )
    assert read(spark, []) == []
    assert len(read(spark, [(1, "u", "x", 5)], f"{PAGES}, first long")) == 1
