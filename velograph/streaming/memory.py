"""What a run remembers of its tracks' paths and looks, and which lost track a fresh detection may go on with."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Limits(NamedTuple):
    """When a lost track may be taken over.  Lengths are metres where there is a plane of the road, else box heights."""

    gap: float = 2.0
    fit: int = 5
    speed: float = 40.0
    distance: float = 4.0
    moving: float = 1.0
    lateral: float = 2.0
    behind: float = 1.5
    similarity: float | None = 0.60
    pixel_speed: float = 4.0
    pixel_distance: float = 3.0
    pixel_similarity: float = 0.70
    looks: int = 16


class Judged(NamedTuple):
    """One lost track beside one fresh detection; ``reason`` is None where nothing speaks against it."""

    track_id: int
    gap: float
    distance: float
    lateral: float | None
    speed: float
    similarity: float | None
    reason: str | None


def velocity(points: list[tuple[float, float, float]]) -> tuple[float, float] | None:
    """Of points (t, x, y), by least squares; None with fewer than two times."""
    t, x, y = np.array(points, np.float64).reshape(-1, 3).T
    if len(t) < 2 or t[-1] - t[0] <= 0:
        return None
    off = t - t.mean()
    size = float((off * off).sum())
    return (float((off * (x - x.mean())).sum() / size), float((off * (y - y.mean())).sum() / size)) if size > 0 else None


class Memory:
    """Recent points and appearance vectors of the tracks of one run.

    ``project`` maps the foot of a box to the plane of the road; without one, limits are by box height and an appearance is
    needed.  A track unseen for longer than ``limits.gap`` can be taken over by nothing and is forgotten, so what is held
    is bounded by the tracks of that time, ``fit`` points and ``looks`` vectors each.
    """

    def __init__(self, limits: Limits = Limits(), project=None):
        self.limits, self.project = limits, project
        self.points: dict[int, list[tuple[float, float, float]]] = {}
        self.looks: dict[int, list[np.ndarray]] = {}
        #: Velocities, each beside the points that it was made of.
        self._velocities: dict[int, tuple] = {}
        self._pruned: float | None = None
        self.gone = 0

    def _place(self, foot: tuple[float, float]) -> tuple[float, float] | None:
        at = self.project(*foot) if self.project else foot
        return at if np.isfinite(at).all() and np.isfinite(foot).all() else None

    def forget(self, track_id: int) -> None:
        for held in (self.points, self.looks, self._velocities):
            held.pop(track_id, None)
        self.gone += 1

    def prune(self, now: float) -> None:
        if now == self._pruned:  # what has been seen since is of this time
            return
        self._pruned = now
        for track_id in [k for k, p in self.points.items() if p[-1][0] < now - self.limits.gap]:
            self.forget(track_id)

    def seen(self, track_id: int, t: float, foot: tuple[float, float]) -> None:
        if not np.isfinite(foot).all():
            return
        self.prune(t)
        if (at := self._place(foot)) is not None:
            self.points[track_id] = [*self.points.get(track_id, []), (t, *at)][-max(2, self.limits.fit) :]

    def looked(self, track_id: int, vector) -> None:
        v = np.asarray([] if vector is None else vector, np.float64)
        if v.size and np.linalg.norm(v) > 0:
            self.looks[track_id] = [*self.looks.get(track_id, []), v][-self.limits.looks :]

    def similarity(self, track_id: int, vector) -> float | None:
        """The best cosine with the track's vectors; None without one on either side."""
        v = np.asarray([] if vector is None else vector, np.float64)
        if not v.size or not np.linalg.norm(v) or track_id not in self.looks:
            return None
        return max(float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))) for w in self.looks[track_id])

    def _velocity(self, track_id: int) -> tuple[float, float] | None:
        points = self.points[track_id]
        known = self._velocities.get(track_id)
        if known is None or known[0] is not points or known[1] != len(points):
            known = self._velocities[track_id] = (points, len(points), velocity(points[-self.limits.fit :]))
        return known[2]

    def _similarities(self, lost: Lost, places: np.ndarray, vector) -> tuple[np.ndarray, np.ndarray]:
        """``similarity`` of the tracks at ``places`` of ``lost``, and where there is one."""
        known, best = np.zeros(len(places), bool), np.full(len(places), np.nan)
        v = np.asarray([] if vector is None else vector, np.float64)
        if not v.size or not (size := np.linalg.norm(v)) or not len(places):
            return known, best
        looks, sizes, first, many = lost.stacked()
        known = many[places] > 0
        at, many = first[places[known]], many[places[known]]
        if not len(at):
            return known, best
        begins = np.cumsum(many) - many
        rows = np.repeat(at - begins, many) + np.arange(many.sum())
        best[known] = np.maximum.reduceat(np.einsum("ij,j->i", looks[rows], v) / (size * sizes[rows]), begins)
        for i in np.flatnonzero(known & np.isnan(best)):
            best[i] = self.similarity(int(lost.ids[places[i]]), vector)
        return known, best

    def compare(self, box, t: float, lost: Lost, vector=None) -> tuple[dict[str, np.ndarray], int | None, np.ndarray]:
        """A fresh detection beside the tracks that are left of ``lost``: what ``Judged`` has as columns (nan for None), the
        place in them of the track that it goes on with, and the places of those that were refused.

        The tests of all tracks are made at once, in the order of their reasons, each of what those before it have left.
        """
        lim, here = self.limits, np.flatnonzero(lost.free)
        at = self._place(((box[0] + box[2]) / 2, box[3])) if np.isfinite(box).all() else None
        if at is None:
            here = here[:0]
        ids, last, many = lost.ids[here], lost.last[here], len(here)
        gap, distance, speed = t - last[:, 0], np.full(many, np.inf), np.full(many, np.inf)
        lateral, similarity, reason = np.full(many, np.nan), np.full(many, np.nan), np.full(many, None, object)
        left = np.arange(many)

        def refuse(where: np.ndarray, why: str) -> None:
            nonlocal left
            reason[left[where]] = why
            left = left[~where]

        if many:
            height = float(box[3] - box[1])
            refuse(gap <= 0, "not_after_last_observation")
            refuse(gap[left] > lim.gap, "gap_exceeded")
            moved = np.hypot(at[0] - last[:, 1], at[1] - last[:, 2])
            if self.project:
                v = np.full((many, 2), np.nan)
                known = [self._velocity(k) for k in ids[left].tolist()]
                v[left] = np.array([x or (np.nan, np.nan) for x in known], np.float64).reshape(-1, 2)
                refuse(np.array([x is None for x in known], bool), "insufficient_history")
                off = np.stack([at[0] - last[:, 1] - v[:, 0] * gap, at[1] - last[:, 2] - v[:, 1] * gap], axis=1)
                distance[left], speed[left] = np.hypot(off[left, 0], off[left, 1]), moved[left] / gap[left]
                refuse(speed[left] > lim.speed, "speed_exceeded")
                refuse(distance[left] > lim.distance, "distance_exceeded")
                pace = np.hypot(v[:, 0], v[:, 1])
                moving = left[pace[left] >= lim.moving]
                along = v[moving] / pace[moving, None]
                lateral[moving] = np.abs(off[moving, 1] * along[:, 0] - off[moving, 0] * along[:, 1])
                ahead = np.full(many, np.nan)
                ahead[moving] = off[moving, 0] * along[:, 0] + off[moving, 1] * along[:, 1]
                refuse(lateral[left] > lim.lateral, "lateral_exceeded")
                refuse(ahead[left] < -lim.behind, "behind_prediction")
                least = lim.similarity
            else:
                refuse(lost.count[here][left] < 2, "insufficient_history")
                refuse(np.full(len(left), not 0 < height < np.inf), "degenerate_scale")
                distance[left], speed[left] = moved[left], moved[left] / gap[left]
                refuse(speed[left] > lim.pixel_speed * height, "speed_exceeded")
                refuse(moved[left] > height * np.minimum(lim.pixel_distance, lim.pixel_speed * gap[left]), "distance_exceeded")
                least = lim.pixel_similarity
            known, similarity[left] = self._similarities(lost, here[left], vector)
            if not self.project:
                refuse(~known, "appearance_required")
            if least is not None:
                refuse(similarity[left] < least, "appearance_mismatch")
        found = {"track_id": ids, "gap": gap, "distance": distance, "lateral": lateral, "speed": speed, "similarity": similarity, "reason": reason}
        worth = lambda i: (distance[i], -(0.0 if np.isnan(similarity[i]) else similarity[i]), ids[i])
        nearest = left[distance[left] == distance[left].min()] if len(left) else left
        return found, min(nearest.tolist() or left.tolist(), key=worth, default=None), np.flatnonzero(reason != None)  # noqa: E711

    def match(self, box, t: float, busy: set[int], vector=None) -> tuple[Judged | None, list[Judged]]:
        """The lost track that a fresh detection goes on with, and all that were refused.

        Tracks in ``busy``, which this frame has already shown, are not compared.  The nearest to its prediction wins, then
        the most similar, then the smallest id.
        """
        found, best, refused = self.compare(box, t, Lost(self, busy), vector)
        none = lambda x: None if x is None or x != x else x
        judged = lambda i: Judged(**{c: none(v[i] if c == "reason" else v[i].item()) for c, v in found.items()})
        return None if best is None else judged(best), [judged(i) for i in refused]


class Lost:
    """The tracks of a memory that a frame has not shown, by id, with their last points; ``free``: which are left."""

    def __init__(self, memory: Memory, busy: set[int]):
        own = [k for k in sorted(memory.points) if k not in busy]
        self.ids = np.array(own, np.int64)
        self.last = np.array([memory.points[k][-1] for k in own], np.float64).reshape(-1, 3)
        self.count = np.array([len(memory.points[k]) for k in own], np.int64)
        self.free = np.ones(len(own), bool)
        self.memory, self.gone = memory, memory.gone
        self._looks: tuple | None = None

    def stacked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The vectors of all as rows, their lengths, and each track's first row and number of rows."""
        if self._looks is None:
            own = [self.memory.looks.get(k, []) for k in self.ids.tolist()]
            rows = np.array([w for looks in own for w in looks], np.float64)
            many = np.array([len(looks) for looks in own], np.int64)
            self._looks = (rows, np.sqrt(np.einsum("ij,ij->i", rows, rows)) if len(rows) else np.zeros(0), np.cumsum(many) - many, many)
        return self._looks

    def take(self, track_id: int) -> None:
        at = int(np.searchsorted(self.ids, track_id))
        if at < len(self.ids) and self.ids[at] == track_id:
            self.free[at] = False
