"""The frames of a run as one stateful operator: associate, retire, filter edges, cross lines, count, measure, choose crops.

A run (a camera's recording) is the key; its frames are walked in order, and what has to outlast them is typed state: a map
of tracks, a map of what the tracker holds, a map of paths and looks, and the run's counts.  Event-time timers close tracks
that have not been seen for a while.  Retired ids go back to the tracker, which no window over finished tables can do.

Everything that a frame alone decides (region, edges, padded crops) comes as columns, made by Catalyst before this operator.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import astuple, dataclass, fields
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from velograph.operators.tracker import PAIRS_AT_ONCE, Live, iou_matrix, shared_matrix
from velograph.streaming.counting import _side
from velograph.streaming.memory import Limits, Lost, Memory

#: What the operator reads; columns that are missing are null.
INPUT = {
    "run_id": "string", "frame_index": "long", "pos": "long", "t": "double", "x1": "double", "y1": "double", "x2": "double", "y2": "double", "confidence": "double",
    "track_id": "long", "inside_roi": "boolean", "edge": "boolean", "flagged": "boolean", "sharpness": "double", "edge_margin": "double", "crop_area": "double", "vector": "array<double>", "ends": "boolean",
}
OUTPUT = {
    "kind": "string", "run_id": "string", "frame_index": "long", "pos": "long", "t": "double", "track_id": "long", "inside_roi": "boolean", "counted": "boolean", "crossed_line": "boolean", "direction": "string",
    "frames_seen": "long", "first_frame": "long", "last_frame": "long", "min_width": "double", "max_width": "double", "min_height": "double", "max_height": "double", "counted_frame": "long", "crop_frame": "long", "crop_updates": "long",
    "outcome": "string", "old_track_id": "long", "mode": "string", "gap_seconds": "double", "distance": "double", "lateral": "double", "implied_speed": "double", "similarity": "double", "reason": "string",
    "name": "string", "n": "long",
}
COLUMNS = {
    "row": ["run_id", "frame_index", "pos", "t", "track_id", "inside_roi", "counted", "crossed_line", "direction"],
    "dropped": ["run_id", "frame_index", "t", "track_id"],
    "rescue": ["run_id", "frame_index", "pos", "t", "outcome", "old_track_id", "mode", "gap_seconds", "distance", "lateral", "implied_speed", "similarity", "reason"],
    "track": ["run_id", "track_id", "frames_seen", "first_frame", "last_frame", "min_width", "max_width", "min_height", "max_height", "counted", "counted_frame", "direction", "crop_frame", "crop_updates"],
    "count": ["run_id", "name", "n"],
}


class Settings(NamedTuple):
    after: float | None = 0.35
    world_gap: float = 2.0
    reach: float = 150.0
    speed: float = 40.0
    project: Callable | None = None
    line: tuple[tuple[float, float], tuple[float, float]] | None = None
    direction: str = "BOTH"
    edge_iou: float = 0.5
    crop_width: float = 112.0
    crop_height: float = 56.0
    spacing: float = 0.5
    target: float = 0.75
    clean: float = 0.1
    partial: float = 0.5
    tracker: dict | None = None
    limits: Limits | None = None
    embed_every: int = 5


@dataclass
class Track:
    """State of a track; ``last_t`` and the place are those of its last row that was not retired, edges included."""

    last_t: float | None = None
    x: float = 0.0
    y: float = 0.0
    retired: bool = False
    retained: bool = False
    embedded: int = 0
    side: int = 0
    counted: bool = False
    counted_frame: int | None = None
    direction: str | None = None
    frames_seen: int = 0
    first_frame: int | None = None
    last_frame: int | None = None
    min_width: float | None = None
    max_width: float = 0.0
    min_height: float | None = None
    max_height: float = 0.0
    crop_frame: int | None = None
    crop_t: float | None = None
    crop_width: float = 0.0
    crop_tier: int = 0
    crop_sharpness: float = 0.0
    crop_margin: float = 0.0
    crop_area: float = 0.0
    crop_updates: int = 0
    seen_ms: int = 0


_KIND = {"retired": "boolean", "retained": "boolean", "counted": "boolean", "direction": "string", **dict.fromkeys(("embedded", "side", "counted_frame", "frames_seen", "first_frame", "last_frame", "crop_frame", "crop_tier", "crop_updates", "seen_ms"), "long")}
TRACK = ", ".join(f"{f.name} {_KIND.get(f.name, 'double')}" for f in fields(Track))
LIVE = "frame long, box array<double>, v array<double>"
MEMORY = "t array<double>, x array<double>, y array<double>, looks array<double>"
COUNTS = ("rows", "suppressed", "ids_dropped", "gap_accepted", "tracks_retained", "edge_skipped", "edge_tracks_skipped", "accepted", "counted", "crops", "rescued", "rescues_refused")


class Rescues:
    """What one fresh detection was compared with: rows of the kind ``rescue``, of which there may be very many, as columns and
    as what all of them have in common."""

    def __init__(self, columns: dict[str, np.ndarray], common: dict):
        self.columns, self.common = columns, common

    def __len__(self) -> int:
        return len(self.columns["outcome"])

    def rows(self) -> Iterator[dict]:
        for n in range(len(self)):
            row = {c: v[n] if v.dtype == object else v[n].item() for c, v in self.columns.items()}
            yield {"kind": "rescue", **self.common, **{c: None if c in ("lateral", "similarity") and v != v else v for c, v in row.items()}}


def joined(rescues: list[Rescues]) -> dict[str, np.ndarray]:
    sizes = [len(r) for r in rescues]
    common = {c: np.repeat([r.common[c] for r in rescues], sizes) for c in rescues[0].common}
    return common | {c: np.concatenate([r.columns[c] for r in rescues]) for c in rescues[0].columns}


class Frames:
    """The loop over frames of one run, on whatever holds its state."""

    def __init__(self, settings: Settings, track: Callable[[int], Track], live: Live | None = None, memory: Memory | None = None):
        self.s, self.track, self.live, self.memory = settings, track, live, memory
        self.counts = dict.fromkeys(COUNTS, 0)

    def frame(self, rows: pd.DataFrame, at_ms: int) -> Iterator[dict]:
        for made in self.pieces(rows, at_ms):
            yield from made.rows() if isinstance(made, Rescues) else [made]

    def pieces(self, rows: pd.DataFrame, at_ms: int) -> Iterator[dict | Rescues]:
        """What a frame gives, comparisons with lost tracks as columns."""
        flagged = rows[rows["flagged"]][["x1", "y1", "x2", "y2"]].to_numpy(float)
        rows = rows[~rows["flagged"]]
        if not len(rows):
            return
        box = rows[["x1", "y1", "x2", "y2"]].to_numpy(float)
        if self.live:
            ids = yield from self._associate(rows, box)
        else:
            ids = rows["track_id"].fillna(-1).to_numpy(np.int64)
        self.counts["rows"] += len(rows)
        stays, dropped = self._retire(rows, box, ids, at_ms)
        for track_id in sorted(dropped):
            yield {"kind": "dropped", "frame_index": int(rows["frame_index"].iloc[0]), "t": float(rows["t"].max()), "track_id": track_id}
        if dropped and self.live:
            self.live.retire(dropped)
            for track_id in dropped:
                self.memory and self.memory.forget(track_id)
        touches = rows["edge"].to_numpy(bool)
        if len(flagged):
            touches |= (iou_matrix(box, flagged) >= self.s.edge_iou).any(axis=1)
        self.counts["edge_skipped"] += int((stays & touches).sum())
        self.counts["edge_tracks_skipped"] += int((stays & touches & (ids >= 0)).sum())
        kept = np.flatnonzero(stays & ~touches & (ids >= 0))
        feet = np.stack([(box[:, 0] + box[:, 2]) / 2, box[:, 3]], axis=1)
        sides = _side(feet[:, 0], feet[:, 1], self.s.line)
        covered = self._covered(box[kept])
        records = rows.to_dict("records")
        for n, i in enumerate(kept):
            r, track = records[i], self.track(int(ids[i]))
            crossed, event = self._count(track, r, int(sides[i]))
            width, height = box[i, 2] - box[i, 0], box[i, 3] - box[i, 1]
            self._measure(track, int(r["frame_index"]), width, height)
            self._crop(track, r, width, height, float(covered[n]))
            self.counts["accepted"] += 1
            yield {"kind": "row", "frame_index": int(r["frame_index"]), "pos": int(r["pos"]), "t": float(r["t"]), "track_id": int(ids[i]), "inside_roi": bool(r["inside_roi"]), "counted": track.counted, "crossed_line": event, "direction": crossed if event else None}

    def _covered(self, box: np.ndarray) -> np.ndarray:
        """The area that each box shares with all others."""
        out = np.zeros(len(box))
        step = max(1, PAIRS_AT_ONCE // max(1, len(box)))
        for low in range(0, len(box), step):
            own = box[low : low + step]
            shared = shared_matrix(own, box)
            shared[np.arange(len(own)), np.arange(low, low + len(own))] = 0
            out[low : low + step] = shared.sum(axis=1)
        return out

    def _associate(self, rows: pd.DataFrame, box: np.ndarray) -> Generator[Rescues, None, np.ndarray]:
        """Ids from the tracker; a fresh one that goes on with a lost track takes its id over."""
        t, frame, vectors = float(rows["t"].max()), int(rows["frame_index"].iloc[0]), rows["vector"].tolist()
        ids = self.live.step(frame, box, rows["confidence"].fillna(0.0).to_numpy(float))
        if not self.memory:
            return ids
        begun, pos = self.live.begun(frame), rows["pos"].tolist()
        fresh = [i for i, k in enumerate(ids.tolist()) if k >= 0 and k in begun]
        busy = {k for k in ids.tolist() if k >= 0 and k not in begun}
        for i, k in enumerate(ids.tolist()):
            if k in busy:
                self._saw(k, t, box[i], vectors[i])
        lost, taken = None, []
        for i in fresh:
            if lost is None or lost.gone != self.memory.gone:
                lost = Lost(self.memory, busy)
            found, best, refused = self.memory.compare(box[i], t, lost, vectors[i])
            shown = refused if best is None else np.append(refused, best)
            if len(shown):
                yield self._events({c: v[shown] for c, v in found.items()}, best is not None, frame, int(pos[i]), t)
            self.counts["rescued"] += best is not None
            self.counts["rescues_refused"] += len(refused)
            if best is not None:
                old = int(found["track_id"][best])
                taken.append((int(ids[i]), old))
                ids[i] = old
            self._saw(int(ids[i]), t, box[i], vectors[i])
            busy.add(int(ids[i]))
            lost.take(int(ids[i]))
        self.live.take_over_all(taken, frame)
        return ids

    def _events(self, found: dict[str, np.ndarray], accepted: bool, frame: int, pos: int, t: float) -> Rescues:
        """Refused tracks and, if one was ``accepted``, that one as the last."""
        outcome = np.full(len(found["gap"]), "rejected", object)
        outcome[len(outcome) - accepted :] = "accepted"
        names = {"old_track_id": "track_id", "gap_seconds": "gap", "distance": "distance", "lateral": "lateral", "implied_speed": "speed", "similarity": "similarity", "reason": "reason"}
        return Rescues({"outcome": outcome, **{c: found[own] for c, own in names.items()}}, {"frame_index": frame, "pos": pos, "t": t, "mode": "world" if self.s.project else "pixel"})

    def _saw(self, track_id: int, t: float, box: np.ndarray, vector) -> None:
        """Keep the place, and every ``embed_every``-th time the look."""
        self.memory.seen(track_id, t, ((box[0] + box[2]) / 2, box[3]))
        track = self.track(track_id)
        if track.embedded % self.s.embed_every == 0:
            self.memory.looked(track_id, vector)
        track.embedded += 1

    def _retire(self, rows: pd.DataFrame, box: np.ndarray, ids: np.ndarray, at_ms: int) -> tuple[np.ndarray, set[int]]:
        """Which rows stay, and the ids that came back when they should not have; these are retired for good."""
        s, stays, dropped = self.s, np.ones(len(rows), bool), set()
        for i, (track_id, t) in enumerate(zip(ids.tolist(), rows["t"].tolist(), strict=True)):
            if track_id < 0:
                continue
            track = self.track(track_id)
            track.seen_ms = max(track.seen_ms, at_ms)
            foot = ((box[i, 0] + box[i, 2]) / 2, box[i, 3])
            x, y = s.project(*foot) if s.project else foot
            if s.after is not None and not track.retired and track.last_t is not None and (gap := t - track.last_t) > s.after:
                far = np.hypot(x - track.x, y - track.y)
                if gap <= s.world_gap and far <= min(s.reach, s.speed * gap):
                    self.counts["gap_accepted"] += 1
                    self.counts["tracks_retained"] += not track.retained
                    track.retained = True
                else:
                    track.retired = True
                    self.counts["ids_dropped"] += 1
            if track.retired:
                stays[i] = False
                dropped.add(track_id)
                self.counts["suppressed"] += 1
            else:
                track.last_t, track.x, track.y = t, float(x), float(y)
        return stays, dropped

    def _count(self, track: Track, r: dict, side: int) -> tuple[str | None, bool]:
        """The direction in which the line was crossed, and whether this counts the track."""
        way = None if not side or not track.side or side == track.side else "A_TO_B" if side > 0 else "B_TO_A"
        track.side = side or track.side
        if track.counted or not r["inside_roi"]:
            return way, False
        if self.s.line is None:
            track.counted = True
            self.counts["counted"] += 1
            return None, False
        if way is None or self.s.direction not in ("BOTH", way):
            return way, False
        track.counted, track.counted_frame, track.direction = True, int(r["frame_index"]), way
        self.counts["counted"] += 1
        return way, True

    def _measure(self, track: Track, frame: int, width: float, height: float) -> None:
        track.first_frame = frame if track.first_frame is None else track.first_frame
        track.last_frame, track.frames_seen = frame, track.frames_seen + 1
        track.min_width = float(width if track.min_width is None else min(track.min_width, width))
        track.min_height = float(height if track.min_height is None else min(track.min_height, height))
        track.max_width, track.max_height = float(max(track.max_width, width)), float(max(track.max_height, height))

    def _crop(self, track: Track, r: dict, width: float, height: float, covered: float) -> None:
        """Hold this row's crop if it beats the one held under the widths seen so far."""
        s = self.s
        if width < s.crop_width or height < s.crop_height or not r["crop_area"] > 0 or (track.crop_t is not None and r["t"] - track.crop_t < s.spacing):
            return
        over = min(1.0, covered / (width * height)) if width * height > 0 else 0.0
        tier = 2 if over <= s.clean else 1 if over <= s.partial else 0
        wanted = track.min_width + (track.max_width - track.min_width) * s.target
        worth = lambda tier, w, sharp, margin, area, frame: (tier, -abs(w - wanted) / max(wanted, 1.0), sharp, margin, area, -frame)
        new = (tier, float(width), *(float(r[c]) if pd.notna(r[c]) else 0.0 for c in ("sharpness", "edge_margin", "crop_area")), int(r["frame_index"]))
        if track.crop_frame is not None and worth(track.crop_tier, track.crop_width, track.crop_sharpness, track.crop_margin, track.crop_area, track.crop_frame) >= worth(*new):
            return
        track.crop_tier, track.crop_width, track.crop_sharpness, track.crop_margin, track.crop_area, track.crop_frame = new
        track.crop_t, track.crop_updates = float(r["t"]), track.crop_updates + 1
        self.counts["crops"] += 1


def summary(track_id: int, track: Track) -> dict:
    return {"kind": "track", "track_id": track_id, **{c: getattr(track, c) for c in COLUMNS["track"][2:]}}


#: Rows of a run that are made before they are given on.
ROWS_AT_ONCE = 10_000


class FrameProcessor(StatefulProcessor):
    """``Frames`` with its state in Spark's store; one map entry a track, read when the track turns up."""

    def __init__(self, settings: Settings, ttl_ms: int | None):
        self.settings, self.ttl_ms = settings, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getMapState("tracks", "track_id long", TRACK)
        self.live = handle.getMapState("live", "track_id long", LIVE)
        self.memory = handle.getMapState("memory", "track_id long", MEMORY)
        self.fresh = handle.getValueState("fresh", "n long")
        self.counts = handle.getValueState("counts", ", ".join(f"{c} long" for c in COUNTS))

    def _loaded(self, cache: dict[int, Track]) -> Frames:
        def track(track_id: int) -> Track:
            if track_id not in cache:
                cache[track_id] = Track(*self.tracks.getValue((track_id,))) if self.tracks.containsKey((track_id,)) else Track()
            return cache[track_id]

        live = memory = None
        if self.settings.tracker is not None:
            live = Live(**self.settings.tracker)
            live.fresh = self.fresh.get()[0] if self.fresh.exists() else 0
            live.tracks = [{"id": k[0], "frame": v[0], "box": np.array(v[1]), "v": np.array(v[2])} for k, v in sorted((tuple(k), tuple(v)) for k, v in self.live.iterator())] if self.live.exists() else []
            if self.settings.limits is not None:
                memory = Memory(self.settings.limits, self.settings.project)
                for k, (t, x, y, looks) in self.memory.iterator() if self.memory.exists() else ():
                    if t:
                        memory.points[k[0]] = list(zip(t, x, y, strict=True))
                    if looks:
                        width = int(looks[0])
                        memory.looks[k[0]] = list(np.array(looks[1:]).reshape(-1, width))
        frames = Frames(self.settings, track, live, memory)
        if self.counts.exists():
            frames.counts = dict(zip(COUNTS, self.counts.get(), strict=True))
        return frames

    def _stored(self, frames: Frames, cache: dict[int, Track]) -> None:
        for track_id, track in cache.items():
            self.tracks.updateValue((track_id,), astuple(track))
        self.counts.update(tuple(int(frames.counts[c]) for c in COUNTS))
        if frames.live:
            self.fresh.update((frames.live.fresh,))
            self.live.clear()
            for t in frames.live.tracks:
                self.live.updateValue((int(t["id"]),), (int(t["frame"]), [float(x) for x in t["box"]], [float(x) for x in t["v"]]))
        if frames.memory:
            self.memory.clear()
            for track_id in frames.memory.points.keys() | frames.memory.looks.keys():
                points, looks = frames.memory.points.get(track_id, []), frames.memory.looks.get(track_id, [])
                flat = [float(len(looks[0])), *np.concatenate(looks).tolist()] if looks else []
                self.memory.updateValue((track_id,), (*([float(p[i]) for p in points] for i in range(3)), flat))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows), ignore_index=True)
        for c in ("flagged", "edge", "inside_roi", "ends"):
            own[c] = own[c].eq(True).fillna(False).astype(bool)
        cache: dict[int, Track] = {}
        frames, out, rescues, held = self._loaded(cache), [], [], 0
        # frames are taken from the rows one by one, and what they give goes on as it comes, so the rows are held once
        order = own.loc[~own["ends"], ["frame_index", "pos"]].dropna(subset=["frame_index"]).sort_values(["frame_index", "pos"], kind="stable").index.to_numpy()
        at = own["frame_index"].to_numpy()[order]
        for places in np.split(order, np.flatnonzero(at[1:] != at[:-1]) + 1) if len(order) else []:
            part = own.iloc[places]
            for made in frames.pieces(part, int(part["at_ms"].max()) if self.ttl_ms else 0):
                if isinstance(made, Rescues):
                    rescues.append(made)
                    held += len(made)
                else:
                    out.append(made)
                    held += 1
                if held >= ROWS_AT_ONCE:
                    yield self._table(key, out, rescues)
                    out, rescues, held = [], [], 0
        self._stored(frames, cache)
        if own["ends"].any():
            out += self._closed(None)
        elif self.ttl_ms:
            self.handle.registerTimer(max(int(own["at_ms"].max()), timerValues.getCurrentWatermarkInMs()) + self.ttl_ms)
        yield self._table(key, out, rescues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._table(key, self._closed(expiredTimerInfo.getExpiryTimeInMs() - self.ttl_ms))

    def _closed(self, until_ms: int | None) -> list[dict]:
        """Summaries of tracks last seen by then (of all, with the counts of the run, if None); their state goes."""
        out = []
        for k, v in list(self.tracks.iterator()) if self.tracks.exists() else ():
            track = Track(*v)
            if until_ms is None or track.seen_ms <= until_ms:
                out += [summary(k[0], track)] if track.frames_seen else []
                self.tracks.removeKey((k[0],))
        if until_ms is None:
            out += [{"kind": "count", "name": c, "n": n} for c, n in zip(COUNTS, self.counts.get(), strict=True)] if self.counts.exists() else []
            for state in (self.live, self.memory, self.fresh, self.counts):
                state.clear()
        return out

    def _table(self, key, rows: list[dict], rescues: list[Rescues] | tuple = ()) -> pd.DataFrame:
        kind = {"long": "Int64", "double": "Float64", "boolean": "boolean", "string": "object"}
        typed = lambda table: table.astype({c: kind[k] for c, k in OUTPUT.items()})
        tables = []
        if rescues:
            tables.append(typed(pd.DataFrame({"kind": "rescue", "run_id": key[0], **joined(rescues)}, columns=list(OUTPUT))))
        if rows or not rescues:
            tables.append(typed(pd.DataFrame([{"run_id": key[0], **r} for r in rows], columns=list(OUTPUT))))
        return tables[0] if len(tables) == 1 else pd.concat(tables, ignore_index=True)

    def close(self) -> None:
        pass


def frame_loop(rows: DataFrame, settings: Settings = Settings(), *, ttl_ms: int | None = None, time: str = "ts") -> DataFrame:
    """What a stream of observations or detections (columns of ``INPUT``) gives, by kind (``rows_of``).

    ``row``: observations that stay, in order, with what they count; ``dropped``: ids that were retired; ``rescue``: each
    comparison of a fresh detection with a lost track; ``track``: the summary of a track once it is closed; ``count``: what
    was read, suppressed, skipped and counted, once the run ends.  With ``settings.tracker`` ids come from the tracker, else
    from ``track_id``.  Rows with ``flagged`` are detections at an edge that only suppress others; a row with ``ends`` ends
    its run and closes all tracks.  With ``ttl_ms`` the column ``time`` needs a watermark, and tracks unseen for so long
    behind it are closed.  Frames of a run have to come in order over micro-batches.  Needs the RocksDB state store.
    """
    have = set(rows.columns)
    own = [F.col(c).cast(kind).alias(c) if c in have else F.lit(None).cast(kind).alias(c) for c, kind in INPUT.items()]
    at = [F.col(time), F.unix_millis(time).alias("at_ms")] if ttl_ms else []
    return rows.select(*own, *at).groupBy("run_id").transformWithStateInPandas(FrameProcessor(settings, ttl_ms), ", ".join(f"{c} {k}" for c, k in OUTPUT.items()), "Append", "EventTime" if ttl_ms else "None")


def rows_of(out: DataFrame, kind: str) -> DataFrame:
    return out.where(F.col("kind") == kind).select(*COLUMNS[kind])
