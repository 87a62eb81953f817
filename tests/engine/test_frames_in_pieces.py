"""What a run's frames give goes on piece by piece, however many rows come at once."""

from __future__ import annotations

import pandas as pd

from velograph.streaming import frames as module
from velograph.streaming.frames import INPUT, FrameProcessor, Settings


class Held(dict):
    """A state variable in memory, of one value or a map."""

    one = None
    containsKey, removeKey, updateValue, getValue = dict.__contains__, dict.pop, dict.__setitem__, dict.__getitem__

    def exists(self):
        return bool(self) or self.one is not None

    def iterator(self):
        return iter(list(self.items()))

    def get(self):
        return self.one

    def update(self, value):
        self.one = value

    def clear(self):
        dict.clear(self)
        self.one = None


class Handle:
    def getMapState(self, *_):
        return Held()

    def getValueState(self, *_):
        return Held()


def given(n, tracks=7):
    x = [float(i % 500) for i in range(n)]
    own = {"run_id": "r", "frame_index": [(n - i) // 20 for i in range(n)], "pos": range(n), "t": [float((n - i) // 20) for i in range(n)], "x1": x, "y1": 0.0, "x2": [a + 150 for a in x], "y2": 80.0, "confidence": 0.9}
    own |= {"track_id": [i % tracks for i in range(n)], "inside_roi": True, "edge": False, "flagged": False, "sharpness": 0.5, "edge_margin": 0.0, "crop_area": 1.0, "vector": None, "ends": [i == n - 1 for i in range(n)]}
    return pd.DataFrame(own, columns=list(INPUT))


def tables(n):
    processor = FrameProcessor(Settings(after=1e9), None)
    processor.init(Handle())
    rows = given(n)
    return list(processor.handleInputRows(("r",), iter([rows[: n // 2], rows[n // 2 :]]), None))


def test_pieces_are_bounded_and_give_the_same_rows(monkeypatch):
    whole = pd.concat(tables(400))
    monkeypatch.setattr(module, "ROWS_AT_ONCE", 30)
    pieces = tables(400)
    assert len(pieces) > 10 and max(len(p[p["kind"] == "row"]) for p in pieces) <= 30
    pd.testing.assert_frame_equal(pd.concat(pieces, ignore_index=True), whole.reset_index(drop=True))
    kept = whole[whole["kind"] == "row"]
    assert len(kept) == 399 and kept["frame_index"].is_monotonic_increasing and (whole["kind"] == "track").sum() == 7
