"""Fluids, throats, cells and films as Columns."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnflow.functions.geometry import Vec, _c, dot, times


@dataclass(frozen=True)
class Fluid:
    """Water: density, viscosity, surface tension, gravity, ambient pressure (SI)."""

    rho: float = 1000.0
    mu: float = 1.0e-3
    sigma: float = 0.072
    g: float = 9.81
    p_atm: float = 101325.0

    @property
    def capillary_length(self) -> float:
        return math.sqrt(self.sigma / (self.rho * self.g))


@dataclass(frozen=True)
class ThroatModel:
    """How openings pass liquid."""

    discharge: float = 0.6
    capillary: bool = True
    counter_current: float = 0.3
    rayleigh_taylor: float = 3.68
    side_factor: float = 2.0
    by_orientation: bool = True
    instant: bool = False
    profile: bool = True
    pressurised: bool = True
    fluid: Fluid = field(default_factory=Fluid)


@dataclass(frozen=True)
class FilmParams:
    """Wall film: thicknesses in metres, volumes in cubic metres."""

    h_bulk: float = 2.0e-3
    drop_volume: float = 5.0e-8
    hang_normal: float = 0.3
    hang_min: float = 2.0e-4
    dt_film: float = 0.05


WATER, THROATS = Fluid(), ThroatModel()


def holdup_head(d: Column, ndim: int = 3, model: ThroatModel = THROATS) -> Column:
    """Head that surface tension holds in an opening of width d."""
    f = model.fluid
    if not model.capillary:
        return F.lit(0.0)
    return F.when(d > 0, F.lit(2.0 * (ndim - 1) * f.sigma / (f.rho * f.g)) / d).otherwise(0.0)


def critical_width(ndim: int = 3, model: ThroatModel = THROATS) -> float:
    """Width below which an opening that faces up or down passes no counter-current flow."""
    return (model.rayleigh_taylor if ndim == 3 else math.pi) * model.fluid.capillary_length


def critical_width_tilted(cos_tilt: Column, ndim: int = 3, model: ThroatModel = THROATS) -> Column:
    """The same in a wall whose normal makes this cosine with the vertical: liquid and air pass side by side in a steep one."""
    flat = critical_width(ndim, model)
    if not model.by_orientation:
        return F.lit(flat)
    sine = F.sqrt(F.greatest(F.lit(0.0), 1.0 - cos_tilt * cos_tilt))
    return F.coalesce(F.least(F.lit(flat), F.try_divide(F.lit(model.side_factor * model.fluid.capillary_length), F.sqrt(sine))), F.lit(flat))


def orifice_flow(area: Column, head: Column, model: ThroatModel = THROATS) -> Column:
    return F.when(head > 0, model.discharge * area * F.sqrt(2.0 * model.fluid.g * F.greatest(head, F.lit(0.0)))).otherwise(0.0)


def torricelli_level(t: Column, h0: Column, area: Column, plan: Column, h_cap: Column | float = 0.0, model: ThroatModel = THROATS) -> Column:
    """Level of a prismatic tank that drains through a hole in its floor."""
    start = F.sqrt(F.greatest(h0 - _c(h_cap), F.lit(0.0)))
    left = F.greatest(start - model.discharge * area / plan * math.sqrt(model.fluid.g / 2.0) * t, F.lit(0.0))
    return left * left + _c(h_cap)


def wet_segment(c0: Column, slope: Column, radius: Column, level: Column, ndim: int = 3) -> tuple[Column, Column, Column]:
    """(wet share, height of its centroid, sill) of a round hole (2-D: a slot) whose plane rises by ``slope`` a unit."""
    sill = c0 - radius * slope
    flat = slope < 1e-9
    y = F.greatest(-radius, F.least(radius, F.coalesce(F.try_divide(level - c0, slope), F.lit(0.0))))
    q = F.greatest(radius * radius - y * y, F.lit(0.0))
    if ndim == 3:
        area = radius * radius * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -y / radius))) + y * F.sqrt(q)
        share, middle = area / (math.pi * radius * radius), F.lit(-2.0 / 3.0) * F.pow(q, F.lit(1.5)) / F.greatest(area, F.lit(1e-300))
    else:
        share, middle = (y + radius) / (2 * radius), 0.5 * (y - radius)
    dry = y <= -radius
    return (
        F.when(flat, F.when(level > c0, 1.0).otherwise(0.0)).when(dry, 0.0).otherwise(share),
        F.when(flat, c0).when(dry, sill).otherwise(F.greatest(sill, c0 + middle * slope)),
        F.when(flat, c0).otherwise(sill),
    )


#: Gauss-Legendre nodes and weights; a rule, not data.
GAUSS = np.polynomial.legendre.leggauss(48)


def hole_flux(c0: Column, slope: Column, radius: Column, level: Column, area: Column, g: float = WATER.g, ndim: int = 3) -> Column:
    """Integral of sqrt(2g(H - z)) over the wet part of a hole, with the end points taken out by a sine-squared substitution."""
    top = F.least(F.coalesce(F.try_divide(level - c0, slope), F.lit(0.0)), radius)
    span = top + radius
    terms = F.array(*(F.struct(F.lit(float(math.sin(th) ** 2)).alias("s"), F.lit(float(w * math.pi * math.sin(th) * math.cos(th) * 0.5)).alias("w")) for x, w in zip(*GAUSS, strict=True) for th in [0.25 * math.pi * (x + 1.0)]))

    def add(total: Column, t: Column) -> Column:
        y = span * t["s"] - radius
        width = 2.0 * F.sqrt(F.greatest(radius * radius - y * y, F.lit(0.0))) if ndim == 3 else F.lit(1.0)
        return total + width * F.sqrt(2.0 * g * F.greatest(level - (c0 + y * slope), F.lit(0.0))) * span * t["w"]

    flat = F.when(level > c0, area * F.sqrt(2.0 * g * F.greatest(level - c0, F.lit(0.0)))).otherwise(0.0)
    return F.when(slope < 1e-9, flat).when(top <= -radius, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), add))


def box_shape(up: Vec) -> Column:
    """Widths of a cube's projection on ``up``, largest first, adding to 1; widths under 1e-4 are dropped."""
    raw = F.array_sort(F.array(*(F.abs(_c(u)) for u in [*up, *[0.0] * (3 - len(up))])), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    share = lambda xs: F.transform(xs, lambda x: F.try_divide(x, F.aggregate(xs, F.lit(0.0), lambda s, y: s + y)))
    kept = F.transform(share(raw), lambda x: F.when(x < 1e-4, 0.0).otherwise(x))
    return share(kept)


def cell_cdf(t: Column, a: Column, b: Column, c: Column) -> Column:
    """Share of a cell below height t (0 bottom, 1 top) whose projection is the sum of uniform widths a >= b >= c, a + b + c = 1."""

    def powers(x: Column, n: int) -> Column:
        return F.pow(F.greatest(x, F.lit(0.0)), F.lit(float(n)))

    s = F.least(t, 1.0 - t)
    square = F.try_divide(powers(s, 2) - powers(s - a, 2) - powers(s - b, 2) + powers(s - a - b, 2), 2.0 * a * b)
    cube = F.try_divide(powers(s, 3) - powers(s - a, 3) - powers(s - b, 3) - powers(s - c, 3) + powers(s - a - b, 3) + powers(s - a - c, 3) + powers(s - b - c, 3), 6.0 * a * b * c)
    raw = F.when(b <= 0, s).when(c <= 0, square).otherwise(cube)
    below = F.when(t <= 0.5, raw).otherwise(1.0 - raw)
    return F.when(t <= 0, 0.0).when(t >= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), below)))


def cell_cdf_inverse(f: Column, a: Column, b: Column, c: Column, rounds: int = 50) -> Column:
    """Height below which the share f of a cell lies, by bisection: of whole batches of rows at a time."""
    from tarnflow.operators.fsm import cdf

    @F.pandas_udf("double")
    def found(f: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        widths = np.stack([x.to_numpy(float) for x in (a, b, c)], axis=-1)
        share = f.to_numpy(float)
        lo, hi = np.zeros(len(share)), np.ones(len(share))
        for _ in range(rounds):
            mid = 0.5 * (lo + hi)
            below = cdf(mid, widths) < share
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return pd.Series(np.where(np.isnan(share) | np.isnan(widths).any(axis=-1), np.nan, 0.5 * (lo + hi)))

    return F.when(f <= 0, 0.0).when(f >= 1, 1.0).when(b <= 0, f).otherwise(found(f, a, b, c))


def above_share(h: Column, level: Column, e: Column, shape: tuple[Column, Column, Column]) -> Column:
    """Share of a cell above a level."""
    return 1.0 - F.when(e > 0, cell_cdf(F.try_divide(level - h + e, 2.0 * e), *shape)).otherwise((h < level).cast("double"))


def trapped(liquid: Column, bath: Column, open_air: Column, above: Column) -> tuple[Column, Column]:
    """(liquid held above the bath, air held below it) as shares of a cell."""
    return F.when(bath, 0.0).otherwise(liquid * above), F.when(open_air, 0.0).otherwise((1.0 - liquid) * (1.0 - above))


def hydrostatic(h: Column, level: Column, joined: Column | None = None, fluid: Fluid = WATER) -> Column:
    """Ambient plus hydrostatic pressure; below ambient only where the liquid is joined to the bath."""
    depth = level - h
    down = F.greatest(depth, F.lit(0.0))
    return fluid.p_atm + fluid.rho * fluid.g * (down if joined is None else F.when(joined, depth).otherwise(down))


def combined(liquid: Column, air: Column, volume: Column, bath: Column, fluid_cell: Column) -> Column:
    """New liquid share from retained liquid, or in the bath from what retained air leaves."""
    share = F.when(bath, 1.0 - F.try_divide(air, volume)).otherwise(F.try_divide(liquid, volume))
    return F.when(fluid_cell, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0))))).otherwise(0.0)


def withdrawal_film(speed: Column, fluid: Fluid = WATER) -> Column:
    """Thickness of the film on a wall drawn out of the bath."""
    ca = fluid.mu / fluid.sigma * F.greatest(speed, F.lit(1e-4))
    return fluid.capillary_length * F.least(0.94 * F.pow(ca, F.lit(2.0 / 3.0)), F.sqrt(ca))


def tangential(gravity: Vec, normal: Vec) -> list[Column]:
    along = dot(gravity, normal)
    return [_c(g) - t for g, t in zip(gravity, times(normal, along), strict=True)]


def scaled(params: Any) -> Column:
    """A parameter object as a literal struct."""
    return F.struct(*(F.lit(v).alias(k) for k, v in vars(params).items() if isinstance(v, (bool, int, float))))
