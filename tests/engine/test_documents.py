"""A keyed JSON document in splits against the same read as a whole."""

from __future__ import annotations

import json
import random

import pytest

from velograph.sources.documents import _entries, _steps, read_in_splits

VALUE = "struct<make: string, tags: array<struct<name: string>>, n: double>"


def document(n, seed):
    draw = random.Random(seed)
    odd = ["{", "}", '"', "\\", "\\\\", '\\"', ",", ":", "[", "]", "é", "漢", "🙂", "a", " ", "\n", "}{", '","']
    text = lambda: "".join(draw.choice(odd) for _ in range(draw.randrange(9)))
    return {str(i): {"make": draw.choice([None, text()]), "tags": [{"name": text()} for _ in range(draw.randrange(3))], "n": draw.choice([None, draw.random()])} for i in range(n)}


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("escape", [True, False])
def test_entries_at_every_split_size(tmp_path, indent, escape):
    held = document(12, 3)
    data = json.dumps(held, indent=indent, ensure_ascii=escape).encode()
    path = tmp_path / "labels.json"
    path.write_bytes(data)
    for size in [*range(1, 40), 97, 500, len(data), 5 * len(data)]:
        state, found = (False, False, 0), []
        for at in range(0, len(data), size):
            found += _entries(str(path), at, size, state)
            for _, _, state in _steps(data[at : at + size], state):
                pass
        assert state == (False, False, 0)
        assert {k: v for e in found for k, v in json.loads("{" + e + "}").items()} == held and len(found) == 12


@pytest.mark.parametrize("split", [37, 1_000, 1 << 20])
def test_rows_equal_the_whole(spark, tmp_path, split):
    held = document(150, 5)
    path = tmp_path / "labels.json"
    path.write_text(json.dumps(held))
    rows = {r.track_id: (r.make, [t.name for t in r.tags], r.n) for r in read_in_splits(spark, f"file:{path}", VALUE, split=split).collect()}
    assert rows == {int(k): (v["make"], [t["name"] for t in v["tags"]], v["n"]) for k, v in held.items()}


def test_what_is_no_object(spark, tmp_path):
    for name, text in (("list", "[1]"), ("open", '{"1": {"n": 1}'), ("empty", ""), ("string", '{"1": "')):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match="does not hold one JSON object"):
            read_in_splits(spark, str(tmp_path / name), VALUE, split=4)
    (tmp_path / "none").write_text(" {} ")
    assert read_in_splits(spark, str(tmp_path / "none"), VALUE, split=1).collect() == []
    (tmp_path / "bad").write_text('{"1": {"n": "x"}}')
    with pytest.raises(Exception):
        read_in_splits(spark, str(tmp_path / "bad"), VALUE).collect()
