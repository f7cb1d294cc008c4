"""A hierarchical navigable small-world graph whose searches advance together.

Levels hold nested random shares of the points. Each level is built after the
one above: points join in batches, a batch searches what stands already (and
itself), links to its nearest, and links back. A search walks down the levels;
on each, all queries of a batch expand their best unexpanded point at once.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

LINKS, BUILD_BEAM, WALK_BEAM, BATCH, TOP = 32, 64, 16, 1024, 128
_BACK, _EXTRA = 16, 32  # links that a point gets back at least, room for them


@dataclass
class Level:
    points: np.ndarray  # places in the whole point table
    links: np.ndarray  # (n, LINKS or a few more) places within the level, -1 where none


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and similarities, best first, of ``beam`` points per query (-1 and
    -inf where fewer were met). ``entries`` (queries, e) may hold -1."""
    n, nq = len(x), len(q)
    ids, sims = np.full((nq, beam), -1), np.full((nq, beam), -np.inf, np.float32)
    open_, seen = np.zeros((nq, beam), bool), np.zeros((nq, n + 1), bool)
    seen[:, n] = True  # stands for -1

    def add(rows: np.ndarray, found: np.ndarray) -> None:
        """Merge points (rows, k) into the beams of ``rows``."""
        found = np.sort(found, 1)
        fresh = ~seen[rows[:, None], found]
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]  # a point is taken once
        seen[rows[:, None], found] = True
        r, c = np.nonzero(fresh)
        if not len(r):
            return
        s = np.full(found.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("ij,ij->i", x[found[r, c]], q[rows[r]])
        all_s = np.concatenate([sims[rows], s], 1)
        best = np.argpartition(-all_s, beam - 1, 1)[:, :beam]
        sims[rows] = np.take_along_axis(all_s, best, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(fresh, found, -1)], 1), best, 1)
        open_[rows] = np.take_along_axis(np.concatenate([open_[rows], fresh], 1), best, 1)

    live = np.arange(nq)
    add(live, entries)
    wide = max(1, beam // 48)
    while len(live):
        ahead = np.where(open_[live], sims[live], -np.inf)
        pick = np.argpartition(-ahead, min(wide, beam) - 1, 1)[:, :wide]
        good = np.take_along_axis(ahead, pick, 1) > -np.inf
        some = good.any(1)
        live, pick, good = live[some], pick[some], good[some]
        if not len(live):
            break
        r, c = np.nonzero(good)
        open_[live[r], pick[r, c]] = False
        at = np.where(good, np.take_along_axis(ids[live], pick, 1), -1)
        found = np.where((at >= 0)[:, :, None], links[at], -1).reshape(len(live), -1)
        add(live, found)
    order = np.argsort(-sims, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _keep(ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LINKS of each row: half of them the nearest, then the oldest, whose links reach far."""
    order = np.argsort(-sims, 1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    age = np.where(ids < 0, np.iinfo(np.int64).max, ids)
    age[:, : LINKS // 2] = np.arange(LINKS // 2) - LINKS // 2 - 1
    order = np.argsort(age, 1, kind="stable")[:, :LINKS]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _connected(x: np.ndarray, links: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """``links`` with extra columns so that pruning makes no point hard to meet:
    a point to which few of its own neighbours link back is hung on the nearest
    of those that do not, then what ``roots`` cannot reach on the most similar that they can."""
    n = len(links)
    extra, used, seen, front = np.full((n, _EXTRA), -1), np.zeros(n, int), np.zeros(n + 1, bool), np.unique(roots)
    seen[n] = True
    for i in range(0, n, BATCH):
        to = links[i : i + BATCH]
        back = (np.where((to >= 0)[:, :, None], links[to], -1) == np.arange(i, i + len(to))[:, None, None]).any(2).sum(1)
        for u in (np.flatnonzero(back < _BACK) + i).tolist():
            at = links[u][links[u] >= 0]
            at = at[(used[at] < _EXTRA) & ~(links[at] == u).any(1)]
            at = at[np.argsort(-(x[at] @ x[u]), kind="stable")[: _BACK - back[u - i]]]
            extra[at, used[at]] = u
            used[at] += 1
    while True:
        while len(front):
            seen[front] = True
            front = np.unique(np.concatenate([links[front].ravel(), extra[front].ravel()]))
            front = front[~seen[front]]
        cut_off = np.flatnonzero(~seen[:n])
        if not len(cut_off):
            return np.concatenate([links, extra[:, : max(1, used.max(initial=0))]], 1) if used.any() else links
        # a share of them at a time, as one that is hung brings others along
        for u in cut_off[: max(1, len(cut_off) // 2)]:
            sims = x @ x[u]
            sims[~seen[:n] | (used >= _EXTRA)] = -np.inf
            at = int(sims.argmax())
            extra[at, used[at]] = u
            used[at] += 1
        front = cut_off[: max(1, len(cut_off) // 2)]


class Graph:
    def __init__(self, x: np.ndarray, levels: list[Level]):
        self.x, self.levels = x, levels

    @classmethod
    def build(cls, x: np.ndarray, seed: int) -> Graph:
        """Graph of the unit vectors ``x``."""
        rng = np.random.default_rng(seed)
        height = np.floor(-np.log(1 - rng.random(len(x))) / np.log(LINKS)).astype(int)
        order = rng.permutation(len(x))
        graph = cls(x, [])
        for level in range(height.max(initial=0), -1, -1):
            points = order[height[order] >= level]
            if len(points) > TOP or level == 0:
                graph.levels.append(graph._level(points))
        return graph

    def _level(self, points: np.ndarray) -> Level:
        x, n = self.x[points], len(points)
        links, sims = np.full((n, LINKS), -1), np.full((n, LINKS), -np.inf, np.float32)
        done = 0
        while done < n:
            size = min(BATCH, max(done, TOP), n - done)
            new = np.arange(done, done + size)
            own = x[new] @ x[new].T
            np.fill_diagonal(own, -np.inf)
            k = min(LINKS, size)
            best = np.argpartition(-own, k - 1, 1)[:, :k]
            cand, s = np.where(np.isinf(np.take_along_axis(own, best, 1)), -1, best + done), np.take_along_axis(own, best, 1)
            if done:
                met, ms = _beam(x[:done], links[:done], x[new], self._entries(x[new], points, done), BUILD_BEAM)
                cand, s = np.concatenate([cand, met], 1), np.concatenate([s, ms], 1)
            top = np.argsort(-s, 1, kind="stable")[:, :LINKS]
            cand, s = np.take_along_axis(cand, top, 1), np.take_along_axis(s, top, 1)
            links[new, : cand.shape[1]], sims[new, : cand.shape[1]] = cand, s
            # links back: the best 2 * LINKS new ones of each point stand for its place
            r, c = np.nonzero(cand >= 0)
            to, of, w = cand[r, c], new[r], s[r, c]
            rank = np.lexsort((-w, to))
            to, of, w = to[rank], of[rank], w[rank]
            first = np.concatenate(([True], to[1:] != to[:-1])) if len(to) else np.zeros(0, bool)
            nth = np.arange(len(to)) - np.maximum.accumulate(np.where(first, np.arange(len(to)), 0)) if len(to) else np.zeros(0, int)
            to, of, w, nth, who = to[nth < 2 * LINKS], of[nth < 2 * LINKS], w[nth < 2 * LINKS], nth[nth < 2 * LINKS], np.cumsum(first)[nth < 2 * LINKS] - 1
            touched = to[nth == 0]
            back, bs = np.full((len(touched), 2 * LINKS), -1), np.full((len(touched), 2 * LINKS), -np.inf, np.float32)
            back[who, nth], bs[who, nth] = of, w
            twice = (back[:, :, None] == links[touched][:, None, :]).any(2)
            back[twice], bs[twice] = -1, -np.inf
            links[touched], sims[touched] = _keep(np.concatenate([links[touched], back], 1), np.concatenate([sims[touched], bs], 1))
            done += size
        return Level(points, _connected(x, links, np.linspace(0, n - 1, min(4, n)).astype(int)))

    def _entries(self, q: np.ndarray, points: np.ndarray, done: int) -> np.ndarray:
        """Where to start on a level of ``points`` of which ``done`` stand."""
        above = self._descend(q)
        start = np.broadcast_to(np.linspace(0, done - 1, min(4, done)).astype(int), (len(q), min(4, done)))
        if above is None:
            return start
        place = np.full(len(self.x) + 1, -1)
        place[points[:done]] = np.arange(done)
        return np.concatenate([place[above], start], 1)

    def _descend(self, q: np.ndarray) -> np.ndarray | None:
        """Points (places in the whole table) met on the levels built so far."""
        met = None
        for level in self.levels:
            met = self._walk(level, q, met, WALK_BEAM)[0]
        return met

    def _walk(self, level: Level, q: np.ndarray, met: np.ndarray | None, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(level.points)
        start = np.broadcast_to(np.linspace(0, n - 1, min(4, n)).astype(int), (len(q), min(4, n)))
        if met is not None:
            place = np.full(len(self.x) + 1, -1)
            place[level.points] = np.arange(n)
            start = np.concatenate([place[met], start], 1)
        ids, sims = _beam(self.x[level.points], level.links, q, start, min(beam, n))
        return np.where(ids >= 0, np.append(level.points, -1)[ids], -1), sims

    def search(self, q: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Points and similarities of a beam per query; ``own`` names points to start from as well."""
        met = None
        for level in self.levels[:-1]:
            met = self._walk(level, q, met, WALK_BEAM)[0]
        if own is not None:
            met = own[:, None] if met is None else np.concatenate([met, own[:, None]], 1)
        return self._walk(self.levels[-1], q, met, beam)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, **{f"p{i}": level.points for i, level in enumerate(self.levels)}, **{f"l{i}": level.links.astype(np.int32) for i, level in enumerate(self.levels)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        z = np.load(io.BytesIO(data))
        return cls(z["x"], [Level(z[f"p{i}"], z[f"l{i}"]) for i in range(sum(k[0] == "p" for k in z.files))])
