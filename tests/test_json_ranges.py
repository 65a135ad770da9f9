"""JSON arrays and maps that are cut into byte ranges."""

from __future__ import annotations

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clipgrid.sources import annotations as N
from clipgrid.sources import json_ranges as J

TRICKY = ['a "quoted" ] word', "back\\slash\\", '\\"', "}{][,:", "", "é日😀", 'ends in \\\\"', "line\nbreak,", "\\}"]
SCHEMA = "n long, s string, x array<string>, m map<string,string>"


def records(count):
    return [{"n": i, "s": TRICKY[i % 9], "x": TRICKY[: i % 4], "m": {TRICKY[i % 7]: TRICKY[(i + 2) % 9]}} for i in range(count)]


@pytest.fixture
def ranges(spark):
    """Reads with ranges of so many bytes."""

    def of(size):
        session = spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        session.conf.set("spark.sql.shuffle.partitions", "3")
        return session

    return of


def elements(session, path):
    return sorted((r.number, json.loads(r.text)) for r in J.json_elements(session, str(path)).collect())


@pytest.mark.parametrize("size", [3, 23, 181, 1 << 20])
def test_an_array_in_ranges_equals_the_parser(ranges, tmp_path, size):
    want = records(2 if size < 10 else 9)
    text = json.dumps(want, ensure_ascii=False, indent=2 if size % 2 else None)
    (tmp_path / "a.json").write_text(text + "\n")
    assert elements(ranges(size), tmp_path) == list(enumerate(want))


def test_ranges_are_tasks(ranges, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(records(300)))
    size = (tmp_path / "a.json").stat().st_size
    assert J._pieces(ranges(4096), str(tmp_path)).rdd.getNumPartitions() == -(-size // 4096)


def test_an_element_over_many_ranges_and_odd_files(ranges, tmp_path):
    long = [{"s": "}" * 900 + '"' + "x" * 400}, {"s": "short"}, [], {}, 5, None, "text, with ] and }", {"a": {"b": [{"c": "}"}]}}]
    (tmp_path / "a.json").write_text(json.dumps(long))
    (tmp_path / "b.json").write_text("[ ]")
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.json").write_text('[\n{"s": 1}\n]')
    found = [(r.file.rsplit("/", 1)[1], r.number, json.loads(r.text)) for r in J.json_elements(ranges(50), str(tmp_path)).collect()]
    want = [("a.json", i, x) for i, x in enumerate(long)] + [("d.json", 0, {"s": 1})]
    assert sorted(found, key=lambda r: r[:2]) == want


@pytest.mark.parametrize("size", [70, 1 << 20])
def test_rows_and_positions_equal_the_one_task_reader(spark, ranges, tmp_path, size):
    (tmp_path / "a.json").write_text(json.dumps(records(20)))
    plain = spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path)).collect()
    own = N.read_annotations(ranges(size), str(tmp_path), SCHEMA).collect()
    own.sort(key=lambda r: (r.ann_file, r.ann_block, r.ann_pos))
    assert [tuple(r)[:4] for r in own] == [tuple(r) for r in plain]
    assert [r.ann_pos for r in own] == list(range(20))


@pytest.mark.parametrize("size", [67, 1 << 20])
def test_a_map_in_ranges(ranges, tmp_path, size):
    entries = {f'v{i}"{i}.mp4': {"caption": TRICKY[i % 9] + "!", "other": "}"} for i in range(20)}
    (tmp_path / "m.json").write_text(json.dumps(entries))
    rows = N.map_captions(N.read_annotation_map(ranges(size), str(tmp_path))).collect()
    assert {r.video_file: r.text_query for r in rows} == {k: v["caption"] for k, v in entries.items()}


values = st.recursive(st.none() | st.integers() | st.text('"\\}{],[ab'), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text('"\\}{a', max_size=3), x, max_size=3), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(values, max_size=6), st.lists(st.integers(0, 200), max_size=6))
def test_states_compose_at_every_cut(elements, cuts):
    """Any cuts behind a closing brace give the state that one pass has there."""
    data = json.dumps(elements).encode()
    braces = [i + 1 for i, c in enumerate(data) if c == ord("}")]
    bounds = sorted({0, len(data), *(braces[c % len(braces)] for c in cuts if braces)})
    state, parts, number, texts = (False, 0, 0), [], 0, []
    for a, b in zip(bounds, bounds[1:], strict=False):
        assert number == state[2]
        found, inside, depth = J.cut(data[a:b], *state[:2])
        for end, x, y in found:
            parts.append(data[a:b][x:y])
            if end:
                texts.append(b"".join(parts))
                parts, number = [], number + 1
        own, middle = J._Range(), next((i for i in braces if a < i < b), a)
        for x, y in ((a, middle), (middle, b)):  # in two batches, which begin behind a brace too
            own.add(np.frombuffer(data[x:y], np.uint8))
        state = own.after(*state)
        assert state[:2] == (inside, depth)
    assert [json.loads(t) for t in texts if t.strip()] == elements
