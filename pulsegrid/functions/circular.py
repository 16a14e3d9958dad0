"""Circular statistics as column expressions and aggregates. Angles in radians; null angles are skipped."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.plans.ordered import bucketed_rank, scan

TWO_PI = 2 * math.pi
#: Bucket of angles in scans; angles are spread over the circle, so a key is cut into this many parts.
ARC = TWO_PI / 4096


def wrap(x: Column, low: float = 0.0, high: float = TWO_PI) -> Column:
    span = high - low
    return x - low - F.floor((x - low) / span) * span + low


def difference(phi: Column, theta: Column, directed: bool = False) -> Column:
    """theta - phi, directed in [-pi, pi) or undirected in [0, pi]."""
    d = wrap(theta - phi, -math.pi, math.pi)
    return d if directed else F.abs(d)


def in_range(theta: Column, low: float, high: float) -> Column:
    """Closed circular range, which may wrap; equal bounds hold everything."""
    if low == high:
        return F.lit(True)
    a, z, x = low % TWO_PI, high % TWO_PI, wrap(theta)
    return x.between(a, z) if a <= z else (x >= a) | (x <= z)


def _sums(weight: Column | None, theta: str, k: int = 1) -> tuple[Column, Column, Column]:
    w = F.when(F.col(theta).isNotNull(), weight if weight is not None else F.lit(1.0))
    return F.sum(w * F.cos(k * F.col(theta))), F.sum(w * F.sin(k * F.col(theta))), F.sum(w)


def moments(df: DataFrame, keys: Sequence[str], theta: str = "theta", weight: Column | None = None, alpha: float = 0.05) -> DataFrame:
    """Per key: n, mean direction, resultant length, second moment, dispersion, circular std, half width of the mean's interval, Rayleigh test."""
    c, s, w = _sums(weight, theta)
    c2, s2, _ = _sums(weight, theta, 2)
    d = df.groupBy(*keys).agg(F.count(theta).alias("n"), (c / w).alias("_c"), (s / w).alias("_s"), (c2 / w).alias("_c2"), (s2 / w).alias("_s2"))
    r = F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s"))
    d = d.withColumns({"mean": wrap(F.atan2("_s", "_c")), "r": r})
    # the second central moment about the angle of the second moment has the second moment's length
    d = d.withColumn("dispersion", F.try_divide(1 - F.sqrt(F.col("_c2") * F.col("_c2") + F.col("_s2") * F.col("_s2")), 2 * F.col("r") * F.col("r")))
    n, rr = F.col("n"), F.col("r")
    S = (1 - F.try_divide(F.lit(1.0), 2 * n)) * 2 * n * rr * rr + n * F.pow(rr, 4) / 2
    z = NormalDist().inv_cdf(1 - alpha / 2)
    return d.withColumns({"re2": F.col("_c2"), "im2": F.col("_s2"), "std": F.sqrt(-2 * F.ln("r")), "ci": F.asin(F.least(F.lit(1.0), z * F.sqrt(F.try_divide(F.col("dispersion"), n)))), "rayleigh_s": S, "rayleigh_p": F.exp(-S / 2)}).drop("_c", "_s", "_c2", "_s2")


def kuiper(df: DataFrame, keys: Sequence[str], theta: str = "theta") -> DataFrame:
    d = df.filter(F.col(theta).isNotNull()).withColumn("_x", wrap(F.col(theta)))
    d = scan(d, keys, ["_x"], ARC, _n=("count", None), _i=("rank", None))
    u = F.col("_x") / TWO_PI - F.col("_i") / F.col("_n")
    v = (F.max(u) - F.min(u) + 1 / F.col("_n")) * (F.sqrt("_n") + 0.155 + 0.24 / F.sqrt("_n"))
    return d.groupBy(*keys, "_n").agg(v.alias("v")).select(*keys, "v", ((8 * F.col("v") * F.col("v") - 2) * F.exp(-2 * F.col("v") * F.col("v"))).alias("p"))


def rank(df: DataFrame, keys: Sequence[str], theta: str = "theta") -> DataFrame:
    """Add ``rank``: 2 pi times the average rank over n."""
    d = df.withColumn("_x", wrap(F.col(theta)))
    sizes = d.filter("_x is not null").groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))  # equal angles count once each
    r = scan(sizes, keys, ["_x"], ARC, _upto=("sum", "_c"))
    total = sizes.groupBy(*keys).agg(F.sum("_c").alias("_n")).withColumnsRenamed({k: f"_t_{k}" for k in keys})
    by = [*keys, "_x"]
    r = r.select(*[F.col(c).alias(f"_r_{c}") for c in by], (F.col("_upto") - F.col("_c") + 1 + (F.col("_c") - 1) / 2).alias("_r"))
    on, same = F.lit(True), F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    d = d.join(r, on, "left").join(total, same, "left")
    return d.select(*df.columns, (TWO_PI * F.col("_r") / F.col("_n")).alias("rank"))


def interval(df: DataFrame, keys: Sequence[str], theta: str = "theta") -> DataFrame:
    """The shortest arc that holds all angles: 2 pi minus the largest gap."""
    d = scan(df.filter(F.col(theta).isNotNull()).select(*keys, wrap(F.col(theta)).alias("_x")), keys, ["_x"], ARC, _n=("lead", "_x"), _first=("min", "_x"))
    gap = F.coalesce("_n", F.col("_first") + TWO_PI) - F.col("_x")
    return d.withColumn("_g", gap).groupBy(*keys).agg((TWO_PI - F.max("_g")).alias("interval"))


def histogram(df: DataFrame, keys: Sequence[str], bins: int = 24, theta: str = "theta") -> DataFrame:
    """Counts around bin centres 2 pi k / bins; an angle on an edge goes to the upper bin."""
    k = F.floor(wrap(F.col(theta)) / (TWO_PI / bins) + 0.5) % bins
    return df.filter(F.col(theta).isNotNull()).groupBy(*keys, k.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def kde(df: DataFrame, keys: Sequence[str], bins: int = 24, kappa: float = 5.0, theta: str = "theta") -> DataFrame:
    """Von Mises density on ``bins`` angles. The grid is fixed and small, so it is an aggregate per grid angle, without a join."""
    norm = 1 / (TWO_PI * float(np.i0(kappa)))
    terms = [F.avg(norm * F.exp(kappa * F.cos(F.col(theta) - TWO_PI * k / bins))) for k in range(bins)]
    d = df.groupBy(*keys).agg(F.array(*terms).alias("_d"))
    return d.select(*keys, F.posexplode("_d").alias("bin", "density"))


def median(df: DataFrame, keys: Sequence[str], theta: str = "theta") -> DataFrame:
    """The data angle with the least mean circular distance to all. The distance is piecewise linear, so it follows from prefix
    sums of the sorted angles (rolled out twice), without comparing all pairs."""
    d = df.filter(F.col(theta).isNotNull()).withColumn("_x", wrap(F.col(theta)))
    d = d.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    turns = d.select(*keys, "_x", F.col("_c").alias("_w"), F.lit(1).alias("_probe")).unionByName(d.select(*keys, (F.col("_x") + math.pi).alias("_x"), F.lit(0).alias("_w"), F.lit(2).alias("_probe")))
    turns = turns.unionByName(d.select(*keys, (F.col("_x") + TWO_PI).alias("_x"), F.col("_c").alias("_w"), F.lit(0).alias("_probe")))
    p = scan(turns, keys, ["_x"], ARC, _n=("sum", "_w"), _s=("sum", F.col("_w") * F.col("_x")))
    a = p.filter("_probe = 1").select(*keys, F.col("_x").alias("_a"), F.col("_n").alias("_na"), F.col("_s").alias("_sa"))
    z = p.filter("_probe = 2").select(*keys, (F.col("_x") - math.pi).alias("_y"), F.col("_n").alias("_nz"), F.col("_s").alias("_sz"))
    total = d.groupBy(*keys).agg(F.sum("_c").alias("_N"), F.sum(F.col("_c") * F.col("_x")).alias("_S"))
    a, z = bucketed_rank(a, keys, ["_a"], ARC, "_i"), bucketed_rank(z, keys, ["_y"], ARC, "_i")
    j = a.join(z, [*keys, "_i"]).join(total, list(keys))
    ahead = (F.col("_sz") - F.col("_sa")) - (F.col("_nz") - F.col("_na")) * F.col("_a")  # angles in (a, a + pi]
    behind_n = F.col("_N") - (F.col("_nz") - F.col("_na"))
    behind_s = F.col("_S") + F.lit(TWO_PI) * F.col("_na") - (F.col("_sz") - F.col("_sa"))  # of one full turn above a
    cost = ahead + behind_n * (F.col("_a") + TWO_PI) - behind_s
    return j.withColumn("_cost", F.round(cost / F.col("_N"), 9)).groupBy(*keys).agg(F.min(F.struct("_cost", "_a")).alias("_m")).select(*keys, F.col("_m._a").alias("median"))


def vonmises_kappa(r: float) -> float:
    """Concentration with mean resultant length r, by Newton's method on I1/I0."""
    if not 0 < r < 1:
        return 0.0 if r <= 0 else math.inf
    k = r * (2 - r * r) / (1 - r * r)
    t = np.linspace(0, math.pi, 4001)
    for _ in range(50):
        e = np.exp(k * (np.cos(t) - 1))
        a = float(np.trapezoid(np.cos(t) * e, t) / np.trapezoid(e, t))
        step = (a - r) / (1 - a / k - a * a)
        k -= step
        if abs(step) < 1e-12:
            break
    return k
