"""Fill-spill-merge one cell at a time, in plain loops: what tests hold the kernel of arrays against."""

from __future__ import annotations

import numpy as np

OCEAN = 0


def cdf(t: np.ndarray, w: tuple[float, float, float]) -> np.ndarray:
    """Share of a cell below normalised height t, for projection widths w."""
    a, b, c = w
    s = np.minimum(t, 1 - t)
    p = lambda x, n: np.maximum(x, 0.0) ** n
    if b <= 0:
        f = s
    elif c <= 0:
        f = (p(s, 2) - p(s - a, 2) - p(s - b, 2) + p(s - a - b, 2)) / (2 * a * b)
    else:
        f = (p(s, 3) - p(s - a, 3) - p(s - b, 3) - p(s - c, 3) + p(s - a - b, 3) + p(s - a - c, 3) + p(s - b - c, 3)) / (6 * a * b * c)
    return np.where(t <= 0, 0.0, np.where(t >= 1, 1.0, np.clip(np.where(t <= 0.5, f, 1 - f), 0.0, 1.0)))


class Hierarchy:
    """Depressions of a scene: a forest under the ocean, found by visiting cells from sinks and low to high."""

    def __init__(self, floor: np.ndarray, region: np.ndarray, links: list[list[int]], sink: np.ndarray) -> None:
        n = len(floor)
        self.floor, self.region, self.links = floor, region, links
        active = np.flatnonzero(region >= 0)
        self.order = active[np.lexsort((active, floor[active], ~sink[active]))]
        self.rank = np.full(n, n, np.int64)
        self.rank[self.order] = np.arange(len(self.order))
        self.parent, self.spill, self.lowest, self.of_region = [-1], [-1], [np.inf], [-1]
        self.owner, self.dest = np.full(n, OCEAN), np.full(n, OCEAN)
        top = [OCEAN]  # of each depression, the outermost it is in so far; shortened on the way

        def outer(m: int) -> int:
            while top[m] != m:
                top[m] = top[top[m]]
                m = top[m]
            return m

        def fresh(cell: int, lowest: float) -> int:
            self.parent.append(-1)
            self.spill.append(-1)
            self.lowest.append(lowest)
            self.of_region.append(int(region[cell]))
            top.append(len(top))
            return len(top) - 1

        for cell in self.order.tolist():
            if sink[cell]:
                continue
            lower = [m for m in links[cell] if self.rank[m] < self.rank[cell] and region[m] == region[cell]]
            if not lower:
                self.owner[cell] = self.dest[cell] = fresh(cell, float(floor[cell]))
                continue
            first = min(lower, key=self.rank.__getitem__)
            self.dest[cell] = self.dest[first]
            met = sorted({outer(int(self.owner[m])) for m in lower})
            if len(met) > 1:
                into = OCEAN if OCEAN in met else fresh(cell, min(self.lowest[m] for m in met))
                for m in met:
                    if m != into:
                        self.parent[m], self.spill[m], top[m] = into, cell, into
                met = [into]
            self.owner[cell] = met[0]

    def targets(self, min_depth: float) -> list[int]:
        """Where a depression's room goes: itself, or past shallow ones to the first deep enough or the ocean."""
        out = list(range(len(self.parent)))
        for m in range(len(out) - 1, 0, -1):  # parents have higher numbers, but for the ocean
            if self.spill[m] >= 0 and self.floor[self.spill[m]] - self.lowest[m] < min_depth:
                out[m] = out[self.parent[m]]
        return out

    def portions(self, e: np.ndarray, shape: tuple[float, float, float], v: np.ndarray, min_depth: float) -> list[tuple[int, int, float, float, float]]:
        """(depression, cell, from, to, volume): a cell's volume cut at the spill levels of the depressions it reaches through."""
        to = self.targets(min_depth)
        out = []
        for cell in self.order.tolist():
            m = int(self.owner[cell])
            while m != OCEAN and self.spill[m] >= 0 and self.floor[cell] >= self.floor[self.spill[m]]:
                m = self.parent[m]
            if e[cell] <= 0:
                if to[m] != OCEAN:
                    out.append((to[m], cell, 0.0, 1.0, float(v[cell])))
                continue
            low = 0.0
            while m != OCEAN and low < 1.0:
                high = 1.0 if self.spill[m] < 0 else min(1.0, float(self.floor[self.spill[m]] - self.floor[cell]) / (2 * e[cell]))
                if high > low and to[m] != OCEAN:
                    share = float(cdf(np.array(high), shape) - cdf(np.array(low), shape))
                    out.append((to[m], cell, low, high, share * float(v[cell])))
                low, m = max(low, high), self.parent[m] if self.spill[m] >= 0 else OCEAN
        return out


def settle(h: np.ndarray, region: np.ndarray, links: list[list[int]], sink: np.ndarray, src: np.ndarray, v: np.ndarray, e: np.ndarray | None = None, shape: tuple[float, float, float] = (1.0, 0.0, 0.0), min_depth: float = 0.0, routing: bool = True) -> tuple[np.ndarray, dict[int, float], dict[int, float], np.ndarray]:
    """(retained by cell, drained by region, lost by region, destination leaf by cell)."""
    e = np.zeros(len(h)) if e is None else e
    floor = h - e
    # A sink among sinks only can't change anything: what is poured on it is gone.
    tree = Hierarchy(floor, region, links, sink)
    parts = tree.portions(e, shape, v, min_depth)
    n = len(tree.parent)
    cap, vol, full = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    for m, _, _, _, x in parts:
        cap[m] += x
    tol = 1e-12 * max(float(v.max(initial=0.0)), 1e-300)
    drained = dict.fromkeys(map(int, np.unique(region[region >= 0])), 0.0)
    lost = dict(drained)
    poured = np.zeros(n)
    for cell in tree.order.tolist():
        if src[cell] > 0:
            if tree.dest[cell] == OCEAN:
                drained[int(region[cell])] += float(src[cell])
            else:
                poured[tree.dest[cell]] += src[cell]

    spills: dict[int, list[int]] = {}

    def inside(leaf: int, m: int) -> bool:
        while leaf > OCEAN and leaf != m:
            leaf = tree.parent[leaf] if tree.spill[leaf] >= 0 else -1
        return leaf == m

    def ways(m: int) -> list[int]:
        """Leaves on the far side of a depression's saddle, the lowest neighbour first."""
        if m not in spills:
            s = tree.spill[m]
            lower = [x for x in tree.links[s] if tree.rank[x] < tree.rank[s] and region[x] == region[s]]
            found = [int(tree.dest[x]) for x in sorted(lower, key=lambda x: floor[x])]
            spills[m] = [leaf for leaf in found if leaf == OCEAN or not inside(leaf, m)]
        return spills[m]

    for leaf in np.flatnonzero(poured).tolist():
        m, left, where = leaf, float(poured[leaf]), tree.of_region[leaf]
        while left > 0:
            put = min(max(cap[m] - vol[m], 0.0), left)
            vol[m] += put
            left -= put
            if left <= tol:
                break
            full[m] = True
            if tree.spill[m] < 0:
                lost[where] += left
                break
            if not routing:
                drained[where] += left
                break
            p, on = tree.parent[m], None
            for way in ways(m):
                if way == OCEAN:
                    on = OCEAN
                    break
                t = way
                while tree.parent[t] != p:
                    t = tree.parent[t]
                if not full[t]:
                    on = way
                    break
                if p == OCEAN:
                    on = OCEAN
                    break
            on = p if on is None else on
            if on == OCEAN:
                drained[where] += left
                break
            m = on
    return _written(tree, parts, e, shape, v, vol, cap, tol), drained, lost, tree.dest


def _written(tree: Hierarchy, parts: list[tuple[int, int, float, float, float]], e: np.ndarray, shape: tuple[float, float, float], v: np.ndarray, vol: np.ndarray, cap: np.ndarray, tol: float) -> np.ndarray:
    """Volumes of depressions back to cells: full ones whole, partly filled ones up to one flat level."""
    retained = np.zeros(len(v))
    by: dict[int, list[int]] = {}
    for i, part in enumerate(parts):
        by.setdefault(part[0], []).append(i)
    for m, rows in by.items():
        if vol[m] <= 0:
            continue
        cell = np.array([parts[i][1] for i in rows])
        volume = np.array([parts[i][4] for i in rows])
        if vol[m] >= cap[m] - tol:
            np.add.at(retained, cell, volume)
            continue
        level = tree.floor[cell]
        if (e[cell] <= 0).all():
            order = np.argsort(level, kind="stable")
            upto = np.cumsum(volume[order])
            at = level[order][np.searchsorted(upto, vol[m] - tol)]
            below, layer = level < at, level == at
            np.add.at(retained, cell[below], volume[below])
            np.add.at(retained, cell[layer], volume[layer] * (vol[m] - volume[below].sum()) / volume[layer].sum())
            continue
        low, high = np.array([parts[i][2] for i in rows]), np.array([parts[i][3] for i in rows])

        def held(at: float, cell: np.ndarray = cell, low: np.ndarray = low, high: np.ndarray = high, level: np.ndarray = level) -> np.ndarray:
            t = np.where(e[cell] > 0, (at - level) / np.maximum(2 * e[cell], 1e-300), (at >= level).astype(float))
            return v[cell] * (cdf(np.clip(t, low, high), shape) - cdf(low, shape))

        a, b = float(level.min()), float((level + 2 * e[cell]).max())
        for _ in range(60):
            mid = 0.5 * (a + b)
            a, b = (mid, b) if held(mid).sum() < vol[m] else (a, mid)
        got = held(b)
        np.add.at(retained, cell, got * vol[m] / max(got.sum(), 1e-300))
    return retained


def neighbours(n: int, src: np.ndarray, dst: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        out[a].append(b)
    return out
