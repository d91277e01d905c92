"""Small solvers, one group a cluster: heads of full vessels, levels of gap channels, trapped gas under Boyle's law."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.physics import WATER, Fluid


def boyle_volume(amount: Column, p_here: Column, fluid: Fluid = WATER) -> Column:
    """Volume of an amount of gas, given as its volume at ambient pressure."""
    return amount * fluid.p_atm / p_here


def balanced_heads(vessels: DataFrame, ways: DataFrame, rounds: int = 200, tol: float = 1e-10) -> DataFrame:
    """(cluster, vessel, head) at which every full vessel passes on as much as it gets. ``vessels`` (cluster, vessel, head or
    null: to be found), ``ways`` (cluster, a, b, k): flow k * sign(dH) * sqrt(|dH|) from a to b.

    The heads minimise a convex potential, the sum of k |dH|^1.5; each vessel in turn is set to the root of its own balance,
    which rises with its head, so bisection finds it and the sweep goes down the potential."""

    def solve(key: tuple, v: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        names = v["vessel"].tolist()
        head = {n: (None if pd.isna(h) else float(h)) for n, h in zip(names, v["head"], strict=True)}
        known = [h for h in head.values() if h is not None]
        if not known:
            return pd.DataFrame({"cluster": key[0], "vessel": names, "head": np.nan})
        free = [n for n in names if head[n] is None]
        lo, hi = min(known), max(known)
        head |= dict.fromkeys(free, 0.5 * (lo + hi))
        around: dict[object, list[tuple[object, float]]] = {n: [] for n in names}
        for a, b, k in zip(w["a"], w["b"], w["k"], strict=True):
            around[a].append((b, float(k)))
            around[b].append((a, float(k)))
        for _ in range(rounds):
            moved = 0.0
            for n in [*free, *reversed(free)]:
                if not around[n]:
                    continue
                a, b = min(head[m] for m, _ in around[n]), max(head[m] for m, _ in around[n])
                for _ in range(60):
                    mid = 0.5 * (a + b)
                    out = sum(k * math.copysign(math.sqrt(abs(mid - head[m])), mid - head[m]) for m, k in around[n])
                    a, b = (mid, b) if out < 0 else (a, mid)
                moved = max(moved, abs(head[n] - b))
                head[n] = b
            if moved <= tol * max(hi - lo, 1e-12):
                break
        return pd.DataFrame({"cluster": key[0], "vessel": names, "head": [head[n] for n in names]})

    vessels, ways = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (vessels, ways))
    return vessels.groupBy("cluster").cogroup(ways.groupBy("cluster")).applyInPandas(solve, "cluster long, vessel long, head double")


def channel_levels(cells: DataFrame, mouths: DataFrame, dt: float, discharge: float = 0.6, g: float = WATER.g) -> DataFrame:
    """(channel, mouth, level, flow): the level H of each gap channel after a step, from its storage and its mouths:
    V0 = V(H) + dt * sum of outflow(H), by bisection, V(H) the volume of its cells (channel, h, e, v, liquid) below H.
    ``mouths`` (channel, mouth, h, area, outside: level beyond or null, vented): flow is out of the channel, inflow negative;
    a channel without a vented mouth passes only what flows through it in sum zero."""

    def solve(key: tuple, c: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        h, e, v = (c[x].to_numpy(float) for x in ("h", "e", "v"))
        held = float((c["liquid"].to_numpy(float) * v).sum())
        mh, area = m["h"].to_numpy(float), m["area"].to_numpy(float)
        beyond = m["outside"].to_numpy(float)
        beyond = np.where(np.isnan(beyond), -np.inf, beyond)
        vented = bool(m["vented"].any())

        def flows(level: float) -> np.ndarray:
            up = np.maximum(level, mh)
            other = np.maximum(beyond, mh)
            head = up - other
            return discharge * area * np.sign(head) * np.sqrt(2 * g * np.abs(head))

        def stored(level: float) -> float:
            return float((v * np.clip((level - h + e) / np.maximum(2 * e, 1e-300), 0.0, 1.0)).sum())

        finite = beyond[np.isfinite(beyond)]
        lo = min(float((h - e).min()), float(mh.min()))
        hi = max(float((h + e).max()), float(mh.max()), *(finite.tolist() or [lo])) + 1e-9
        for _ in range(60):
            mid = 0.5 * (lo + hi)
            over = flows(mid).sum() * dt + (stored(mid) - held if vented else 0.0)
            lo, hi = (lo, mid) if over > 0 else (mid, hi)
        level = 0.5 * (lo + hi)
        return pd.DataFrame({"channel": key[0], "mouth": m["mouth"], "level": level, "flow": flows(level)})

    cells, mouths = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (cells, mouths))
    return cells.groupBy("channel").cogroup(mouths.groupBy("channel")).applyInPandas(solve, "channel long, mouth long, level double, flow double")
