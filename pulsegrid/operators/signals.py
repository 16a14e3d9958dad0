"""Operators on sampled signals in long form: keys..., i (sample number, without gaps), t, y. Everything here stays in SQL expressions.

What depends on order runs as a bucketed scan, and windows of neighbours over chunks of positions with a halo, so a long signal is spread.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators import segments as S
from pulsegrid.plans.joins import asof_join, band_join, range_join
from pulsegrid.plans.ordered import POSITIONS, SECONDS, near, scan

NORMAL_MAD = 0.6744897501960817


def threshold(df: DataFrame, keys: Sequence[str], kind: str, value: float = 1.0, y: str = "y") -> DataFrame:
    """A threshold per key: raw, zscore (mean + v std), median (median + v (P75 - median)), percentile, median mad, mean mad."""
    if kind == "raw":
        return df.select(*keys).distinct().withColumn("threshold", F.lit(float(value)))
    if kind == "zscore":
        return df.groupBy(*keys).agg((F.avg(y) + value * F.stddev_pop(y)).alias("threshold"))
    if kind == "median":
        return df.groupBy(*keys).agg((F.percentile(y, 0.5) + value * (F.percentile(y, 0.75) - F.percentile(y, 0.5))).alias("threshold"))
    if kind == "percentile":
        return df.groupBy(*keys).agg(F.percentile(y, value / 100).alias("threshold"))
    if kind in ("median mad", "mean mad"):
        center = df.groupBy(*keys).agg((F.percentile(y, 0.5) if kind == "median mad" else F.avg(y)).alias("_c"))
        spread = df.join(center, list(keys)).groupBy(*keys, "_c").agg(F.percentile(F.abs(F.col(y) - F.col("_c")), 0.5).alias("_m"))
        return spread.select(*keys, (F.col("_c") + value * F.col("_m") / NORMAL_MAD).alias("threshold"))
    raise ValueError(kind)


def mountains(df: DataFrame, keys: Sequence[str], low: float, high: float, gap: float = 0.0, minimum: float = 0.0, segs: DataFrame | None = None, width: float = 1.0, bucket: float = SECONDS) -> DataFrame:
    """Runs of y > low that exceed high before their last sample, joined over gaps and kept from a minimum duration on.

    With ``segs`` a mountain counts if it lies wholly within one merged segment.
    """
    d = scan(df.select(*keys, "t", (F.coalesce(F.col("y") > low, F.lit(False))).alias("_on"), "y"), keys, ["t"], bucket, _before=("lag", "_on"), _after=("lead", "_on")).filter("_on")
    head, tail = ~F.coalesce("_before", F.lit(False)), ~F.coalesce("_after", F.lit(False))
    d = scan(d.select(*keys, "t", "y", head.cast("int").alias("_head"), tail.alias("_tail")), keys, ["t"], bucket, _g=("sum", "_head"))
    runs = d.groupBy(*keys, "_g").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.max(F.when(~F.col("_tail"), F.col("y"))).alias("_top")).filter(F.col("_top") > high)
    out = S.merge(runs, keys, gap=gap, bucket=bucket).filter(F.col("stop") - F.col("start") >= minimum)
    if segs is None:
        return out
    m = S.merge(segs, keys, bucket=bucket).withColumnsRenamed({"start": "_s0", "stop": "_s1"})
    return range_join(out, m, keys, width, t="start", start="_s0", stop="_s1").filter(F.col("stop") <= F.col("_s1")).drop("_s0", "_s1")


def extrema(df: DataFrame, keys: Sequence[str], kind: str = "extrema", low: float | None = None, high: float | None = None, bucket: float = POSITIONS) -> DataFrame:
    """Local extrema: sample number (the middle of a plateau) and amplitude. Plateaus are reduced to one row before comparing.

    ``low`` and ``high`` keep amplitudes in that closed range.
    """
    d = scan(df.select(*keys, "i", "y"), keys, ["i"], bucket, _p=("lag", "y"), _n=("lead", "y"))
    head, tail = ~F.coalesce(F.col("_p") == F.col("y"), F.lit(False)), ~F.coalesce(F.col("_n") == F.col("y"), F.lit(False))
    ends = d.filter(head | tail).select(*keys, "i", "y", "_p", head.alias("_head"), F.when(tail, F.struct("i", F.col("_n").alias("n"))).alias("_tail"))
    runs = scan(ends, keys, ["i"], bucket, _end=("next", "_tail")).filter("_head")
    up, down = F.col("y") > F.col("_p"), F.col("y") > F.col("_end.n")
    found = runs.withColumn("kind", F.when(up & down, "max").when(~up & ~down, "min")).filter("kind is not null")
    found = found.select(*keys, ((F.col("i") + F.col("_end.i")) / 2).alias("position"), F.col("y").alias("amplitude"), "kind")
    if low is not None or high is not None:
        found = found.filter((F.col("amplitude") >= (low if low is not None else -math.inf)) & (F.col("amplitude") <= (high if high is not None else math.inf)))
    return found if kind == "extrema" else found.filter(F.col("kind") == kind)


def gradient_extrema(df: DataFrame, keys: Sequence[str], bucket: float = POSITIONS) -> DataFrame:
    """Extrema where the central difference of y changes sign, at the interpolated sample number: position, kind."""
    d = scan(df.select(*keys, "i", "y"), keys, ["i"], bucket, _p=("lag", "y"), _n=("lead", "y"))
    slope = F.when(F.col("_p").isNull(), F.col("_n") - F.col("y")).when(F.col("_n").isNull(), F.col("y") - F.col("_p")).otherwise((F.col("_n") - F.col("_p")) / 2)
    crossings = zero_crossings(d.select(*keys, "i", slope.alias("y")), keys, bucket)
    return crossings.select(*keys, "position", F.when(F.col("direction") == "rising", "min").otherwise("max").alias("kind"))


def zero_crossings(df: DataFrame, keys: Sequence[str], bucket: float = POSITIONS) -> DataFrame:
    """Interpolated sample number where y changes sign, and the direction; zeros in between: the middle of both neighbours."""
    d = scan(df.filter("y <> 0"), keys, ["i"], bucket, _p=("lag", F.struct("i", "y"))).filter(F.signum("y") != F.signum("_p.y"))
    at = F.when(F.col("i") - F.col("_p.i") == 1, F.col("_p.i") + F.col("_p.y") / (F.col("_p.y") - F.col("y"))).otherwise((F.col("i") + F.col("_p.i")) / 2.0)
    return d.select(*keys, at.alias("position"), F.when(F.col("y") > 0, "rising").otherwise("falling").alias("direction"))


def blank_artefacts(df: DataFrame, artefacts: DataFrame, keys: Sequence[str], before: float, after: float, fill: float | None = None, linear: bool = False) -> DataFrame:
    """y without the half-open windows [a - before, a + after) around artefacts: a constant, null, or linear between the neighbours."""
    spans = S.merge(artefacts.select(*keys, (F.col("t") - before).alias("start"), (F.col("t") + after).alias("stop")), keys)
    hit = range_join(df.select(*keys, "i", "t"), spans, keys, before + after, how="left_semi").select(*keys, "i").withColumn("_bad", F.lit(True))
    d = df.join(hit, [*keys, "i"], "left").withColumn("_y", F.when(F.col("_bad").isNull(), F.col("y")))
    if not linear:
        return d.withColumn("y", F.coalesce("_y", F.lit(fill).cast("double"))).drop("_y", "_bad")
    known = F.when(F.col("_y").isNotNull(), F.struct(F.col("t").alias("t"), F.col("_y").alias("y")))
    d = scan(d, keys, ["t"], SECONDS, _a=("last", known), _z=("next", known))
    between = F.col("_a.y") + (F.col("_z.y") - F.col("_a.y")) * F.try_divide(F.col("t") - F.col("_a.t"), F.col("_z.t") - F.col("_a.t"))
    return d.withColumn("y", F.coalesce("_y", between, F.col("_a.y"), F.col("_z.y"))).drop("_y", "_bad", "_a", "_z")


def windows(df: DataFrame, keys: Sequence[str], size: int, shift: int) -> DataFrame:
    """Samples in sliding windows: window number w starts at sample w x shift; incomplete windows are dropped. A sample meets its windows by arithmetic."""
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / shift)).cast("long")
    last = F.least(F.floor(F.col("i") / shift), F.floor((F.col("_n") - size) / shift)).cast("long")
    d = scan(df, keys, ["i"], POSITIONS, _m=("max", "i")).withColumn("_n", F.col("_m") + 1).withColumns({"_a": first, "_z": last}).filter("_a <= _z")
    d = d.withColumn("w", F.explode(F.sequence("_a", "_z")))
    return d.withColumn("j", F.col("i") - F.col("w") * shift).drop("_m", "_n", "_a", "_z")


def trigger_windows(df: DataFrame, triggers: DataFrame, keys: Sequence[str], half: int, id: str) -> DataFrame:
    """The 2 half + 1 samples around each trigger sample; triggers too near an end are dropped."""
    n = df.groupBy(*keys).agg(F.max("i").alias("_m"))
    ok = triggers.join(n, list(keys)).filter((F.col("i") >= half) & (F.col("i") + half <= F.col("_m"))).drop("_m")
    spread = ok.select(*keys, F.col(id).alias("trigger"), F.explode(F.sequence(F.col("i") - half, F.col("i") + half)).alias("_i"), F.col("i").alias("_c"))
    return spread.join(df.withColumnRenamed("i", "_i"), [*keys, "_i"]).select(*keys, "trigger", (F.col("_i") - F.col("_c")).alias("lag"), "y")


def interpolate_at(probes: DataFrame, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The signal at the probes' times, linear between samples, null outside."""
    b = asof_join(probes, df.select(*keys, "t", "y"), keys, ["y"], "backward", prefix="_b_")
    f = asof_join(b, df.select(*keys, "t", "y"), keys, ["y"], "forward", prefix="_f_")
    y = F.when(F.col("_f_t") == F.col("_b_t"), F.col("_b_y")).otherwise(F.col("_b_y") + (F.col("_f_y") - F.col("_b_y")) * F.try_divide(F.col("t") - F.col("_b_t"), F.col("_f_t") - F.col("_b_t")))
    return f.withColumn("y", y).drop("_b_t", "_b_y", "_f_t", "_f_y")


def triggered_average(df: DataFrame, events: DataFrame, keys: Sequence[str], lo: float, hi: float, step: float) -> DataFrame:
    """Mean of the interpolated signal at lags lo, lo + step, ... < hi around the events."""
    n = math.ceil((hi - lo) / step - 1e-9)
    probes = events.select(*keys, F.col("t").alias("_e"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("lag")).withColumn("t", F.col("_e") + lo + F.col("lag") * step)
    return interpolate_at(probes, df, keys).groupBy(*keys, "lag").agg(F.avg("y").alias("mean"))


def rolling_median(df: DataFrame, keys: Sequence[str], half: int, subtract: bool = False) -> DataFrame:
    """Centred rolling median (shorter at the ends), or the signal minus it."""
    d = near(df, keys, "i", half, half, _m=lambda w: F.percentile("y", 0.5).over(w.rowsBetween(-half, half)))
    return d.withColumn("m", F.col("y") - F.col("_m") if subtract else F.col("_m")).drop("_m")


def sliding_rms(df: DataFrame, keys: Sequence[str], half: int) -> DataFrame:
    """Root of the mean square over the nearest 2 half + 1 samples (fewer at the ends)."""
    return near(df, keys, "i", half, half, rms=lambda w: F.sqrt(F.avg(F.col("y") * F.col("y")).over(w.rowsBetween(-half, half))))


def kernel_weights(kernel: str, bandwidth: float, delta: float = 1.0) -> list[float]:
    """Weights on the sample grid, summing to one; u is the squared distance in bandwidths; support 4 (gaussian) or 1 bandwidth."""
    reach, shape = {
        "gaussian": (4.0, lambda u: math.exp(-u / 2)), "epanechnikov": (1.0, lambda u: 0.75 * (1 - u) if u < 1 else 0.0),
        "uniform": (1.0, lambda u: 1.0 if u < 1 else 0.0), "triangular": (1.0, lambda u: 1 - math.sqrt(u) if u < 1 else 0.0),
    }[kernel]
    half = math.ceil(reach * bandwidth / delta)
    w = [shape((k * delta / bandwidth) ** 2) for k in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def smooth(df: DataFrame, keys: Sequence[str], kernel: str, bandwidth: float, delta: float = 1.0) -> DataFrame:
    """Kernel smoothing along i, unbiased at ends and gaps: weighted mean of what is there; a null sample stays null."""
    weights = kernel_weights(kernel, bandwidth, delta)
    half = len(weights) // 2

    def sums(w: Window) -> Column:
        num, den = F.lit(0.0), F.lit(0.0)
        for k, x in zip(range(-half, half + 1), weights):
            if x:
                y = F.lead("y", k).over(w) if k > 0 else F.lag("y", -k).over(w) if k < 0 else F.col("y")
                num, den = num + x * F.coalesce(y, F.lit(0.0)), den + F.when(y.isNotNull(), F.lit(x)).otherwise(0.0)
        return F.struct(num.alias("n"), den.alias("d"))

    return near(df, keys, "i", half, half, _both=sums).withColumns({"_num": F.col("_both.n"), "_den": F.col("_both.d")}).drop("_both").withColumn("smooth", F.when(F.col("y").isNotNull(), F.col("_num") / F.col("_den"))).drop("_num", "_den")


def upsample(df: DataFrame, factor: int) -> DataFrame:
    """Zeros between samples."""
    d = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    return d.withColumns({"i": F.col("i") * factor + F.col("_k"), "y": F.when(F.col("_k") == 0, F.col("y")).otherwise(0.0)}).drop("_k")


def downsample(df: DataFrame, factor: int) -> DataFrame:
    return df.filter(F.col("i") % factor == 0)


def cross_correlation(x: DataFrame, y: DataFrame, keys: Sequence[str], maxlag: int, scale: str = "none") -> DataFrame:
    """c[l] = sum of x[i + l] y[i]; scale none, biased (/ n), unbiased (/ pairs), coeff (/ norms), pearson (correlation of the pairs)."""
    left = y.select(*keys, F.col("i").alias("t"), F.col("y").alias("b"))
    right = x.select(*keys, F.col("i").alias("t"), F.col("y").alias("a"))
    d = band_join(left, right, keys, -maxlag, maxlag).withColumn("lag", F.col("lag").cast("int"))
    s = F.sum(F.col("a_r") * F.col("b"))
    if scale == "pearson":
        return d.groupBy(*keys, "lag").agg(F.corr("a_r", "b").alias("c"))
    out = d.groupBy(*keys, "lag").agg(s.alias("c"), F.count(F.lit(1)).alias("_p"))
    if scale == "none":
        return out.drop("_p")
    if scale == "unbiased":
        return out.select(*keys, "lag", (F.col("c") / F.col("_p")).alias("c"))
    norms = y.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("y") * F.col("y")).alias("_b2")).join(x.groupBy(*keys).agg(F.sum(F.col("y") * F.col("y")).alias("_a2")), list(keys))
    by = F.col("_n") if scale == "biased" else F.sqrt(F.col("_a2") * F.col("_b2"))
    return out.join(norms, list(keys)).select(*keys, "lag", (F.col("c") / by).alias("c"))


def smooth_axes(df: DataFrame, keys: Sequence[str], axes: Sequence[str], kernels: Sequence[str], bandwidths: Sequence[float], value: str = "y") -> DataFrame:
    """Kernel smoothing of a value on an n-d grid, one kernel for each axis (whole-number columns): unbiased, a null or absent cell stays so.

    The kernel is the product of the axes' kernels, so each axis is one pass over sums of weight x value and of weight: every cell is
    sent to the cells within the kernel's reach, and partial sums are combined before the shuffle.
    """
    d = df.filter(F.col(value).isNotNull()).select(*keys, *axes, F.col(value).cast("double").alias("_num"), F.lit(1.0).alias("_den"))
    for axis, kernel, bandwidth in zip(axes, kernels, bandwidths):
        weights = kernel_weights(kernel, bandwidth)
        half = len(weights) // 2
        steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in zip(range(-half, half + 1), weights) if w])
        d = d.withColumn("_s", F.explode(steps)).withColumn(axis, F.col(axis) + F.col("_s.k"))
        d = d.groupBy(*keys, *axes).agg(F.sum(F.col("_num") * F.col("_s.w")).alias("_num"), F.sum(F.col("_den") * F.col("_s.w")).alias("_den"))
    known = df.filter(F.col(value).isNotNull())
    return known.join(d, [*keys, *axes]).withColumn("smooth", F.col("_num") / F.col("_den")).drop("_num", "_den")


def cross_correlation_2d(x: DataFrame, y: DataFrame, keys: Sequence[str], maxlag: tuple[int, int], scale: str = "none", remove_mean: bool = False) -> DataFrame:
    """c[p, q] = sum of x[i + p, j + q] y[i, j] of two grids (i, j, y): keys, lag_i, lag_j, c; missing cells take no part."""
    centre = lambda d: d.join(d.groupBy(*keys).agg(F.avg("y").alias("_m")), list(keys)).withColumn("y", F.col("y") - F.col("_m")).drop("_m") if remove_mean else d
    lags = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in range(-maxlag[0], maxlag[0] + 1) for q in range(-maxlag[1], maxlag[1] + 1)])
    l = centre(y).select(*keys, "i", "j", F.col("y").alias("_b"), F.explode(lags).alias("_l"))
    l = l.select(*keys, (F.col("i") + F.col("_l.p")).alias("i"), (F.col("j") + F.col("_l.q")).alias("j"), "_b", F.col("_l.p").alias("lag_i"), F.col("_l.q").alias("lag_j"))
    d = l.join(centre(x).select(*keys, "i", "j", F.col("y").alias("_a")), [*keys, "i", "j"])
    s = {"none": F.sum(F.col("_a") * F.col("_b")), "unbiased": F.avg(F.col("_a") * F.col("_b")), "pearson": F.corr("_a", "_b")}[scale]
    return d.groupBy(*keys, "lag_i", "lag_j").agg(s.alias("c"))


def local_integrate(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Sum over the n samples around each one (one more before than after for an even n): column ``total``."""
    before, after = n // 2, (n - 1) // 2
    return near(df, keys, "i", before, after, total=lambda w: F.sum("y").over(w.rowsBetween(-before, after)))
