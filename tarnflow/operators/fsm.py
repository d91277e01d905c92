"""Fill-spill-merge: what stays where after liquid is poured on a height field, and what runs off.

Two ways, by size. ``fill_spill`` runs whole scenes, many scenarios in parallel and many in a kernel call (arrays over all
cells; only saddles are visited one by one). ``pointers``, ``basins``, ``saddles`` and ``flooded`` are stages for one large graph as
tables: steepest descent by a minimum over lower links, basins by pointer doubling, the lowest saddle of each pair of
basins by an aggregate, and full flooding by a minimax over the basin graph, which is far smaller than the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.session import round_of

OCEAN = 0
RESULT = "scenario_id long, node_id long, retained double, owner long, drained double, lost double"


def cdf(t: np.ndarray, w: np.ndarray | tuple[float, float, float]) -> np.ndarray:
    """Share of a cell below normalised height t, for projection widths w in descending order (three, or three a row)."""
    a, b, c = np.moveaxis(np.asarray(w, float), -1, 0)
    s = np.minimum(t, 1 - t)
    p = lambda x, n: np.maximum(x, 0.0) ** n
    line = plane = solid = s
    with np.errstate(divide="ignore", invalid="ignore"):
        if (b > 0).any():
            plane = (p(s, 2) - p(s - a, 2) - p(s - b, 2) + p(s - a - b, 2)) / (2 * a * b)
        if (c > 0).any():
            solid = (p(s, 3) - p(s - a, 3) - p(s - b, 3) - p(s - c, 3) + p(s - a - b, 3) + p(s - a - c, 3) + p(s - b - c, 3)) / (6 * a * b * c)
    f = np.where(b <= 0, line, np.where(c <= 0, plane, solid))
    return np.where(t <= 0, 0.0, np.where(t >= 1, 1.0, np.clip(np.where(t <= 0.5, f, 1 - f), 0.0, 1.0)))


class Links:
    """Directed links of n cells, both ways each, in the order of their source: ``src``, ``dst``."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray) -> None:
        order = np.lexsort((dst, src))
        self.n, self.src, self.dst = n, np.asarray(src, np.int64)[order], np.asarray(dst, np.int64)[order]
        self.first = np.searchsorted(self.src, np.arange(n + 1))

    @classmethod
    def of(cls, lists: list[list[int]]) -> Links:
        return cls(len(lists), np.repeat(np.arange(len(lists)), list(map(len, lists))), np.array([m for near in lists for m in near], np.int64))

    def __getitem__(self, cell: int) -> np.ndarray:
        return self.dst[self.first[cell] : self.first[cell + 1]]


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n things, the smallest that each is joined to by pairs (a, b): roots hook to smaller roots until no pair is apart."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


class Hierarchy:
    """Depressions of a scene: a forest under the ocean, found by visiting cells from sinks and low to high.

    A cell flows to its first neighbour in that order; following these pointers (by doubling) gives its leaf. Only where
    lower neighbours lie in different leaves can depressions merge, so only those cells and the leaves' lowest are visited
    one by one. A depression lasts until the visit at which its parent takes it in, which gives every other cell's owner."""

    def __init__(self, floor: np.ndarray, region: np.ndarray, links: Links, sink: np.ndarray) -> None:
        n = len(floor)
        self.floor, self.region, self.links = floor, region, links
        active = np.flatnonzero(region >= 0)
        self.order = active[np.lexsort((active, floor[active], ~sink[active]))]
        self.rank = np.full(n, n, np.int64)
        self.rank[self.order] = np.arange(len(self.order))
        rank = self.rank
        lower = (rank[links.dst] < rank[links.src]) & (region[links.dst] == region[links.src]) & (rank[links.src] < n)
        lower &= ~sink[links.src]
        self._src, self._dst = links.src[lower], links.dst[lower]

        begin = np.flatnonzero(np.diff(self._src, prepend=-1))
        cells = self._src[begin]
        next_ = np.arange(n)
        if len(cells):
            next_[cells] = self.order[np.minimum.reduceat(rank[self._dst], begin)]
        while True:
            on = next_[next_]
            if (on == next_).all():
                break
            next_ = on
        bottom = next_  # the lowest cell of each cell's leaf, or the sink it ends in
        ends = np.where(sink[bottom], -1, bottom)

        # Cells whose lower neighbours lie in several leaves, with these leaves.
        met_cells, met_ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(cells):
            of = ends[self._dst]
            mixed = np.repeat(np.minimum.reduceat(of, begin) != np.maximum.reduceat(of, begin), np.diff(np.append(begin, len(of))))
            pairs = np.unique(rank[self._src[mixed]] * (n + 1) + of[mixed] + 1)
            met_cells, met_ends = self.order[pairs // (n + 1)] if len(pairs) else met_cells, pairs % (n + 1) - 1
        lows = active[(bottom[active] == active) & ~sink[active]]
        self._merge(floor, region, lows, met_cells, met_ends)

        leaf = np.full(n, OCEAN, np.int64)
        leaf[lows] = self._leaf_of[lows]
        self.dest = np.where(region >= 0, np.where(ends >= 0, leaf[bottom], OCEAN), OCEAN)
        self.owner = self._outermost(self.dest)

    def _merge(self, floor: np.ndarray, region: np.ndarray, lows: np.ndarray, cells: np.ndarray, ends: np.ndarray) -> None:
        parent, spill, lowest, of_region, top = [-1], [-1], [0.0], [-1], [OCEAN]
        self._leaf_of = np.zeros(len(floor), np.int64)
        leaf_of = self._leaf_of

        def outer(m: int) -> int:
            while top[m] != m:
                top[m] = top[top[m]]
                m = top[m]
            return m

        def fresh(cell: int, low: float) -> int:
            parent.append(-1)
            spill.append(-1)
            lowest.append(low)
            of_region.append(int(region[cell]))
            top.append(len(top))
            return len(top) - 1

        first = np.flatnonzero(np.diff(cells, prepend=-1))
        last = np.append(first[1:], len(cells))
        visits = np.concatenate((lows, cells[first]))
        for v in np.argsort(self.rank[visits], kind="stable").tolist():
            cell = int(visits[v])
            if v < len(lows):
                leaf_of[cell] = fresh(cell, float(floor[cell]))
                continue
            held = ends[first[v - len(lows)] : last[v - len(lows)]].tolist()
            met = sorted({OCEAN if low < 0 else outer(int(leaf_of[low])) for low in held})
            if len(met) > 1:
                into = OCEAN if met[0] == OCEAN else fresh(cell, min(lowest[m] for m in met))
                for m in met:
                    if m != into:
                        parent[m], spill[m], top[m] = into, cell, into
        self.parent, self.spill = np.array(parent), np.array(spill)
        self.lowest, self.of_region = np.array(lowest), np.array(of_region)
        #: The height of a depression's saddle and the visit that ends it.
        ends_ = self.spill >= 0
        self.level = np.where(ends_, floor[self.spill] if len(floor) else np.inf, np.inf)
        self.until = np.where(ends_, self.rank[self.spill] if len(floor) else 0, len(floor) + 1)

    def _outermost(self, leaf: np.ndarray) -> np.ndarray:
        """The depression that each cell's leaf is in when the cell is visited: up the forest in steps of powers of two."""
        ups = [np.where(self.parent < 0, np.arange(len(self.parent)), self.parent)]
        while not (ups[-1] == ups[-1][ups[-1]]).all():
            ups.append(ups[-1][ups[-1]])
        at = leaf
        for up in reversed(ups):
            # Ends come later the further up: what ended above has ended below.
            at = np.where(self.until[up[at]] <= self.rank, up[at], at)
        return np.where(self.until[at] <= self.rank, self.parent[at], at)

    def targets(self, min_depth: float) -> np.ndarray:
        """Where a depression's room goes: itself, or past shallow ones to the first deep enough or the ocean."""
        out = np.arange(len(self.parent))
        shallow = np.flatnonzero((self.spill >= 0) & (self.level - self.lowest < min_depth))
        for m in shallow[::-1].tolist():  # parents have higher numbers, but for the ocean
            out[m] = out[self.parent[m]]
        return out

    def portions(self, e: np.ndarray, shape: np.ndarray, v: np.ndarray, min_depth: float) -> tuple[np.ndarray, ...]:
        """(depression, cell, from, to, volume): a cell's volume cut at the spill levels of the depressions it reaches through."""
        to = self.targets(min_depth)
        cell = self.order
        m = self.owner[cell]
        while True:
            over = (m != OCEAN) & (self.spill[m] >= 0) & (self.floor[cell] >= self.level[m])
            if not over.any():
                break
            m = np.where(over, self.parent[m], m)
        flat = (e[cell] <= 0) & (to[m] != OCEAN)
        k = int(flat.sum())
        out = [(to[m[flat]], cell[flat], np.zeros(k), np.ones(k), v[cell[flat]].astype(float))]
        on = (e[cell] > 0) & (m != OCEAN)
        cell, m = cell[on], m[on]
        low = np.zeros(len(cell))
        while len(cell):
            high = np.where(self.spill[m] < 0, 1.0, np.minimum(1.0, (self.level[m] - self.floor[cell]) / (2 * e[cell])))
            use = (high > low) & (to[m] != OCEAN)
            c, w = cell[use], shape[cell[use]]
            out.append((to[m[use]], c, low[use], high[use], (cdf(high[use], w) - cdf(low[use], w)) * v[c]))
            low = np.maximum(low, high)
            m = np.where(self.spill[m] >= 0, self.parent[m], OCEAN)
            on = (m != OCEAN) & (low < 1.0)
            cell, m, low = cell[on], m[on], low[on]
        d, c, a, b, x = (np.concatenate(p) for p in zip(*out, strict=True))
        order = np.lexsort((a, self.rank[c], d))
        return d[order], c[order], a[order], b[order], x[order]


def settle(h: np.ndarray, region: np.ndarray, links: Links | list[list[int]], sink: np.ndarray, src: np.ndarray, v: np.ndarray, e: np.ndarray | None = None, shape: tuple[float, float, float] | np.ndarray = (1.0, 0.0, 0.0), min_depth: float = 0.0, routing: bool = True) -> tuple[np.ndarray, dict[int, float], dict[int, float], np.ndarray]:
    """(retained by cell, drained by region, lost by region, destination leaf by cell). ``shape`` may differ by cell.

    Scenes without links between them can share a call, with regions of their own: what each keeps doesn't change."""
    links = links if isinstance(links, Links) else Links.of(links)
    e = np.zeros(len(h)) if e is None else e
    shape = np.broadcast_to(np.asarray(shape, float), (len(h), 3))
    floor = h - e
    tree = Hierarchy(floor, region, links, sink)
    parts = tree.portions(e, shape, v, min_depth)
    n = len(tree.parent)
    cap = np.bincount(parts[0], parts[4], n)
    names, at = np.unique(region[tree.order], return_inverse=True)
    largest = np.full(len(names) + 1, 1e-300)
    np.maximum.at(largest, at, v[tree.order])
    tol = 1e-12 * largest[np.searchsorted(names, tree.of_region)]
    source = np.where(src[tree.order] > 0, src[tree.order], 0.0)
    gone = tree.dest[tree.order] == OCEAN
    drained = dict(zip(names.tolist(), np.bincount(at, np.where(gone, source, 0.0), len(names)).tolist(), strict=True))
    lost = dict.fromkeys(names.tolist(), 0.0)
    poured = np.bincount(tree.dest[tree.order], np.where(gone, 0.0, source), n)
    vol = _routed(tree, links, floor, poured, cap, tol, drained, lost, routing)
    return _written(tree, parts, e, shape, v, vol, cap, tol), drained, lost, tree.dest


def _routed(tree: Hierarchy, links: Links, floor: np.ndarray, poured: np.ndarray, cap: np.ndarray, tol: np.ndarray, drained: dict[int, float], lost: dict[int, float], routing: bool) -> np.ndarray:
    """Volumes of depressions after what was poured into each leaf has filled it and gone on over its saddles."""
    parent, spill = tree.parent.tolist(), tree.spill.tolist()
    room, vol, full, least = cap.tolist(), [0.0] * len(parent), [False] * len(parent), tol.tolist()
    spills: dict[int, list[int]] = {}

    def inside(leaf: int, m: int) -> bool:
        while leaf > OCEAN and leaf != m:
            leaf = parent[leaf] if spill[leaf] >= 0 else -1
        return leaf == m

    def ways(m: int) -> list[int]:
        """Leaves on the far side of a depression's saddle, the lowest neighbour first."""
        if m not in spills:
            s = spill[m]
            near = links[s]
            near = near[(tree.rank[near] < tree.rank[s]) & (tree.region[near] == tree.region[s])]
            found = tree.dest[near[np.argsort(floor[near], kind="stable")]].tolist()
            spills[m] = [leaf for leaf in dict.fromkeys(found) if leaf == OCEAN or not inside(leaf, m)]
        return spills[m]

    def onward(m: int) -> int:
        """Where a full depression's surplus goes: the ocean, a leaf whose side of the saddle has room, or the parent."""
        p = parent[m]
        for way in ways(m):
            t = way
            while t != OCEAN and parent[t] != p:
                t = parent[t]
            if t == OCEAN:
                return OCEAN
            if not full[t]:
                return way
            if p == OCEAN:
                return OCEAN
        return p

    for leaf in np.flatnonzero(poured).tolist():
        m, left, where = leaf, float(poured[leaf]), int(tree.of_region[leaf])
        while left > 0:
            put = min(max(room[m] - vol[m], 0.0), left)
            vol[m] += put
            left -= put
            if left <= least[leaf]:
                break
            full[m] = True
            if spill[m] < 0:
                lost[where] += left
                break
            on = onward(m) if routing else OCEAN
            if on == OCEAN:
                drained[where] += left
                break
            m = on
    return np.array(vol)


def _written(tree: Hierarchy, parts: tuple[np.ndarray, ...], e: np.ndarray, shape: np.ndarray, v: np.ndarray, vol: np.ndarray, cap: np.ndarray, tol: np.ndarray) -> np.ndarray:
    """Volumes of depressions back to cells: full ones whole, partly filled ones up to one flat level, all of them at once."""
    m, cell, low, high, volume = parts
    n = len(vol)
    whole = (vol > 0) & (vol >= cap - tol)
    retained = np.bincount(cell, np.where(whole[m], volume, 0.0), len(v)).astype(float)  # whole numbers if there is no part
    part = ((vol > 0) & ~whole)[m]
    if not part.any():
        return retained
    m, cell, low, high, volume = (x[part] for x in (m, cell, low, high, volume))
    level = tree.floor[cell]
    tall = np.bincount(m, e[cell] > 0, n) > 0

    flat = ~tall[m]
    if flat.any():
        order = np.lexsort((level[flat], m[flat]))
        f_m, f_cell, f_level, f_volume = (x[flat][order] for x in (m, cell, level, volume))
        fresh = np.flatnonzero((np.diff(f_m, prepend=-1) != 0) | (np.diff(f_level, prepend=np.nan) != 0))
        size = np.diff(np.append(fresh, len(f_m)))
        layer = np.add.reduceat(f_volume, fresh)
        group = f_m[fresh]
        before = np.cumsum(layer) - layer
        before -= np.repeat(before[np.flatnonzero(np.diff(group, prepend=-1))], np.diff(np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))))
        share = np.clip((vol[group] - before) / np.maximum(layer, 1e-300), 0.0, 1.0)
        share[share > 1 - 1e-12] = 1.0
        retained += np.bincount(f_cell, f_volume * np.repeat(share, size), len(v))

    if not flat.all():
        m, cell, low, high, level = (x[~flat] for x in (m, cell, low, high, level))
        names, g = np.unique(m, return_inverse=True)
        w, room, base, span = shape[cell], v[cell], cdf(low, shape[cell]), 2 * e[cell]

        def held(at: np.ndarray) -> np.ndarray:
            t = np.where(span > 0, (at[g] - level) / np.maximum(span, 1e-300), (at[g] >= level).astype(float))
            return room * (cdf(np.clip(t, low, high), w) - base)

        a, b = np.full(len(names), np.inf), np.full(len(names), -np.inf)
        np.minimum.at(a, g, level)
        np.maximum.at(b, g, level + span)
        for _ in range(60):
            mid = 0.5 * (a + b)
            short = np.bincount(g, held(mid), len(names)) < vol[names]
            a, b = np.where(short, mid, a), np.where(short, b, mid)
        got = held(b)
        total = np.bincount(g, got, len(names))
        retained += np.bincount(cell, got * (vol[names] / np.maximum(total, 1e-300))[g], len(v))
    return retained


#: Cells that are settled in one call, unless a scene alone has more.
CELLS = 1 << 17


def _scenes(table: pa.Table, min_depth: float, routing: bool, shape: tuple[float, float, float]) -> pa.RecordBatch:
    """Settles whole scenes, as one call with regions of their own. Rows: nodes, then links, of each scene in order."""
    col = {c: np.asarray(table[c]) for c in table.column_names if c != "to"}
    scene = np.cumsum(np.diff(col["scenario_id"], prepend=col["scenario_id"][:1]) != 0)
    is_link = col["link"]
    near = table["to"].combine_chunks()
    near = near.combine_chunks() if isinstance(near, pa.ChunkedArray) else near
    times = np.asarray(near.value_lengths().fill_null(0))
    a = np.concatenate((col["a"][is_link], np.repeat(col["a"], times)))
    b = np.concatenate((col["b"][is_link], np.asarray(near.flatten())))
    at = np.concatenate((scene[is_link], np.repeat(scene, times)))
    names = np.unique(col["a"][~is_link])
    key = scene[~is_link] * len(names) + np.searchsorted(names, col["a"][~is_link])  # ascending: sorted by scene and node
    ends, known = [], np.ones(len(at), bool)
    for side in (a, b):
        place = np.minimum(np.searchsorted(names, side), len(names) - 1)
        asked = at * len(names) + place
        ends.append(np.minimum(np.searchsorted(key, asked), len(key) - 1))
        known &= (names[place] == side) & (key[ends[-1]] == asked)
    own = scene[~is_link]
    region = col["region"][~is_link]
    pairs, group = np.unique(np.stack((own, region)), axis=1, return_inverse=True)
    group = np.where(region >= 0, group.ravel(), -1)
    h, v, e, src = (col[c][~is_link].astype(float) for c in ("h", "v", "e", "src"))
    kept, drained, lost, leaf = settle(h, group, Links(len(key), ends[0][known], ends[1][known]), col["sink"][~is_link].astype(bool), src, v, e, shape, min_depth, routing)
    # Leaves count in each scene from 1, in the order of visits; 0 is the ocean.
    dry = leaf == OCEAN
    seen, number = np.unique(own * (leaf.max(initial=0) + 1) + leaf, return_inverse=True)
    of = seen // (leaf.max(initial=0) + 1)
    owner = np.where(dry, OCEAN, number - np.searchsorted(of, own) + 1 - (seen % (leaf.max(initial=0) + 1) == OCEAN)[np.searchsorted(of, own)])
    gone, spilt = np.zeros(len(key)), np.zeros(len(key))
    first = np.unique(group, return_index=True)
    for k, at in zip(first[0].tolist(), first[1].tolist(), strict=True):
        gone[at], spilt[at] = drained.get(k, 0.0), lost.get(k, 0.0)
    arrays = [col["scenario_id"][~is_link], col["a"][~is_link], kept, owner, gone, spilt]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=[c.split()[0] for c in RESULT.split(", ")])


def _alike(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, first) of each scene in the rows: where it stands, and the first scene that equals it in all but its number."""
    ids = np.asarray(table["scenario_id"])
    begin = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    end = np.append(begin[1:], len(ids))
    plain = [np.asarray(table[c]) for c in table.column_names if c not in ("to", "scenario_id")]
    near = table["to"].combine_chunks()
    near = near.combine_chunks() if isinstance(near, pa.ChunkedArray) else near
    times, flat = np.asarray(near.value_lengths().fill_null(0)), np.asarray(near.flatten())
    at = np.concatenate(([0], np.cumsum(times)))
    known: dict[tuple[bytes, ...], int] = {}
    first = np.empty(len(begin), np.int64)
    for n, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        content = (*(c[a:b].tobytes() for c in plain), times[a:b].tobytes(), flat[at[a] : at[b]].tobytes())
        first[n] = known.setdefault(content, n)
    return begin, end, first


def _settled(table: pa.Table, min_depth: float, routing: bool, shape: tuple[float, float, float]) -> pa.RecordBatch:
    """Settles whole scenes; those that differ in their number alone keep the same, so one of them is settled for all."""
    begin, end, first = _alike(table)
    own, which = np.unique(first, return_inverse=True)
    if len(own) == len(first):
        return _scenes(table, min_depth, routing, shape)
    rows = np.concatenate([np.arange(begin[n], end[n]) for n in own])
    ids = np.asarray(table["scenario_id"])
    got = _scenes(table.take(pa.array(rows)), min_depth, routing, shape)
    a = np.searchsorted(np.asarray(got["scenario_id"]), ids[begin[own]], "left")
    b = np.searchsorted(np.asarray(got["scenario_id"]), ids[begin[own]], "right")
    out = got.take(pa.array(np.concatenate([np.arange(a[n], b[n]) for n in which.tolist()])))
    return out.set_column(0, "scenario_id", pa.array(np.repeat(ids[begin], (b - a)[which])))


def fill_spill(nodes: DataFrame, edges: DataFrame | None = None, min_depth: float = 0.0, routing: bool = True, shape: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> DataFrame:
    """Runs scenes (scenario_id, node_id, h, region, sink, src, v, e) with links (scenario_id, src, dst), or without such a
    table if the nodes carry their neighbours (``to``, an array), which saves the links' way through the shuffle.

    Returns (scenario_id, node_id, retained, owner, drained, lost); drained and lost stand on the first node of a region,
    owner numbers a scene's leaves from 1 (0: it runs off). Equal scenes of a block are settled once. Scenes stream through sorted partitions and are settled in
    blocks of about ``CELLS`` cells. One scene is one task's work: its order of filling is sequential by nature. A large
    field is for the staged operators. Links to nodes that aren't there are left out; a node stands once."""
    zero, none = F.lit(0.0), F.array().cast("array<long>")
    number = {"h": "double", "region": "long", "src": "double", "v": "double", "e": "double"}
    rows = nodes.select("scenario_id", F.lit(False).alias("link"), F.col("node_id").alias("a"), F.lit(0).cast("long").alias("b"), (F.col("to") if edges is None else none).alias("to"), "sink", *(F.col(c).cast(t).alias(c) for c, t in number.items()))
    if edges is not None:
        rows = rows.unionByName(edges.select("scenario_id", F.lit(True).alias("link"), F.col("src").alias("a"), F.col("dst").alias("b"), none.alias("to"), F.lit(False).alias("sink"), *(zero.cast(t).alias(c) for c, t in number.items())))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, enough = 0, CELLS
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < enough:
                continue
            table = pa.Table.from_batches(held)
            ids = np.asarray(table["scenario_id"])
            cut = int(np.searchsorted(ids, ids[-1]))  # the last scene may go on in the next batch
            if cut:
                yield _settled(table.slice(0, cut), min_depth, routing, shape)
            held, rows = table.slice(cut).to_batches(), rows - cut
            enough = CELLS if cut else 2 * rows
        if any(b.num_rows for b in held):
            yield _settled(pa.Table.from_batches(held), min_depth, routing, shape)

    return rows.repartition("scenario_id").sortWithinPartitions("scenario_id", "link", "a", "b").mapInArrow(stream, RESULT)


# ---- one large field as tables


def key_of(h: Column, sink: Column, node: Column) -> Column:
    """The order of visiting: sinks first, then height, then node."""
    return F.struct((~sink).alias("dry"), h.alias("h"), node.alias("node"))


def pointers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, next): the first of a node's neighbours in order if it comes before the node, else the node itself; sinks end."""
    keyed = nodes.select("node_id", "sink", key_of(F.col("h"), F.col("sink"), F.col("node_id")).alias("key"))
    lower = edges.join(keyed.select(F.col("node_id").alias("dst"), F.col("key").alias("to")), "dst").groupBy("src").agg(F.min("to").alias("to"))
    df = keyed.join(lower, keyed["node_id"] == lower["src"], "left")
    return df.select("node_id", F.when(~F.col("sink") & (F.col("to") < F.col("key")), F.col("to.node")).otherwise(F.col("node_id")).alias("next"))


def basins(points: DataFrame, most: int = 40) -> DataFrame:
    """(node_id, basin): where the chain of pointers ends, doubling the step each round."""
    at = round_of(points.select("node_id", F.col("next").alias("basin")))
    for _ in range(most):
        on = at.select(F.col("node_id").alias("basin"), F.col("basin").alias("further"))
        further = round_of(at.join(on, "basin").select("node_id", F.col("basin").alias("was"), F.col("further").alias("basin")))
        moved = not further.filter("was <> basin").isEmpty()
        at = further.select("node_id", "basin")
        if not moved:
            break
    return at


def candidates(nodes: DataFrame, edges: DataFrame, basin: DataFrame) -> DataFrame:
    """(node_id, basins): nodes whose lower neighbours lie in two basins or more."""
    keyed = nodes.select("node_id", "sink", key_of(F.col("h"), F.col("sink"), F.col("node_id")).alias("key"))
    a, b = keyed.select(F.col("node_id").alias("src"), F.col("key").alias("ka"), "sink"), keyed.select(F.col("node_id").alias("dst"), F.col("key").alias("kb"))
    lower = edges.join(a, "src").join(b, "dst").filter("kb < ka and not sink").join(basin.withColumnRenamed("node_id", "dst"), "dst")
    return lower.groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_set("basin")).alias("basins")).filter(F.size("basins") > 1)


def saddles(nodes: DataFrame, edges: DataFrame, basin: DataFrame) -> DataFrame:
    """(a, b, h): the lowest height at which two basins meet, over links between them, a < b. A sink takes what touches it,
    so its own height doesn't count; between sinks there is no height."""
    n = nodes.select("node_id", F.when(~F.col("sink"), F.col("h")).alias("h")).join(basin, "node_id")
    pair = edges.join(n.select(F.col("node_id").alias("src"), F.col("h").alias("h1"), F.col("basin").alias("b1")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("h").alias("h2"), F.col("basin").alias("b2")), "dst").filter("b1 < b2")
    return pair.groupBy(F.col("b1").alias("a"), F.col("b2").alias("b")).agg(F.min(F.greatest("h1", "h2")).alias("h"))


def flooded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, held): whether a cell is under water after everything was flooded: its height is below the lowest pass
    from its basin to a sink. Passes are a minimax over the graph of basins and saddles, which goes on until no pass changes."""
    b = round_of(basins(pointers(nodes, edges)))
    pass_ = round_of(saddles(nodes, edges, b))
    ways = round_of(pass_.union(pass_.select("b", "a", "h")).toDF("u", "v", "h"))
    best = round_of(nodes.filter("sink").join(b, "node_id").select(F.col("basin").alias("u"), F.lit(float("-inf")).alias("level")).distinct())
    while True:
        step = best.join(ways, "u").select(F.col("v").alias("u"), F.greatest("level", F.col("h").cast("double")).alias("level"))
        better = round_of(best.union(step).groupBy("u").agg(F.min("level").alias("level")))
        changed = not better.exceptAll(best).isEmpty()
        best = better
        if not changed:
            break
    out = nodes.join(b, "node_id").join(best.withColumnRenamed("u", "basin"), "basin", "left")
    return out.select("node_id", (~F.col("sink") & (F.col("level").isNull() | (F.col("h") < F.col("level")))).alias("held"))
