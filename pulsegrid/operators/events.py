"""Event (point process) operators on DataFrames with the columns keys..., t (seconds).

What depends on order runs as a bucketed scan by time (and a tie-breaker where one is given), so a hot key is spread;
cross-series operators use the bucketed joins of ``plans.joins``. ``bucket`` is the span of a bucket, in the unit of t.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators import segments as S
from pulsegrid.plans.joins import asof_join, band_join, range_join
from pulsegrid.plans.ordered import SECONDS, bucket_of, scan


def split_labels(df: DataFrame, label: str) -> DataFrame:
    """The times of each label, sorted."""
    return df.groupBy(label).agg(F.array_sort(F.collect_list("t")).alias("times"))


def rate(events: DataFrame, keys: Sequence[str], segs: DataFrame | None = None, width: float = 1.0, separate: bool = False) -> DataFrame:
    """Events per second in the merged segments; without segments over [first - isi/2, last + isi/2) with the mean interval isi."""
    if segs is None:
        n, lo, hi = F.count("t"), F.min("t"), F.max("t")
        isi = F.try_divide(hi - lo, n - 1)
        return events.groupBy(*keys).agg(F.try_divide(n.cast("double"), hi - lo + isi).alias("rate"))
    m = S.merge(segs, keys)
    counted = S.count_in(events, m, keys, width)
    if separate:
        return counted.withColumn("rate", F.try_divide(F.col("n").cast("double"), F.col("stop") - F.col("start"))).select(*keys, "start", "stop", "rate")
    return counted.groupBy(*keys).agg(F.try_divide(F.sum("n").cast("double"), F.sum(F.col("stop") - F.col("start"))).alias("rate"))


def bin_events(events: DataFrame, bins: DataFrame, keys: Sequence[str], width: float, kind: str = "count") -> DataFrame:
    """Events in each half-open bin (bins may overlap): ``count``, ``binary`` or ``rate``."""
    if kind not in ("count", "binary", "rate"):
        raise NotImplementedError(kind)
    c = S.count_in(events, bins, keys, width)
    value = {"count": F.col("n"), "binary": (F.col("n") > 0).cast("int"), "rate": F.try_divide(F.col("n").cast("double"), F.col("stop") - F.col("start"))}[kind]
    return c.withColumn("value", value).drop("n", "first", "last")


def regular_bins(events: DataFrame, keys: Sequence[str], origin: float, width: float) -> DataFrame:
    """Counts in a regular grid of bins: one hash aggregation, no join."""
    return events.groupBy(*keys, F.floor((F.col("t") - origin) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def intervals(events: DataFrame, keys: Sequence[str], order: Sequence[str] = ("t",), segs: DataFrame | None = None, width: float = 1.0, bucket: float = SECONDS) -> DataFrame:
    """Signed time to the previous (``pre``, negative) and next (``post``) event of the series, and the smaller and larger of both (null unless both exist).

    With ``segs`` only events inside the merged segments take part, and only neighbours in the same one count.
    """
    if segs is not None:
        m = S.merge(segs, keys, bucket=bucket)
        events = range_join(events, m, keys, width).withColumnRenamed("start", "_seg").drop("stop")
        return intervals(events, [*keys, "_seg"], order, bucket=bucket).drop("_seg")
    d = scan(events, keys, list(order), bucket, _p=("lag", "t"), _n=("lead", "t"))
    return _extremes(d.withColumns({"pre": F.col("_p") - F.col("t"), "post": F.col("_n") - F.col("t")}).drop("_p", "_n"))


def _extremes(d: DataFrame) -> DataFrame:
    both = F.col("pre").isNotNull() & F.col("post").isNotNull()
    near = F.abs("post") <= F.abs("pre")
    return d.withColumns({"smallest": F.when(both, F.when(near, F.col("post")).otherwise(F.col("pre"))), "largest": F.when(both, F.when(~near, F.col("post")).otherwise(F.col("pre")))})


def cross_intervals(events: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same to the events of another series; an event at the same time counts on both sides."""
    b = asof_join(events, other, keys, [], "backward", prefix="_b_")
    f = asof_join(b, other, keys, [], "forward", prefix="_f_")
    return _extremes(f.withColumns({"pre": F.col("_b_t") - F.col("t"), "post": F.col("_f_t") - F.col("t")}).drop("_b_t", "_f_t"))


def filter_intervals(events: DataFrame, keys: Sequence[str], minimum: float = 0.003, order: Sequence[str] = ("t",), bucket: float = SECONDS) -> DataFrame:
    """Without the events that follow their (original) predecessor too soon."""
    return scan(events, keys, list(order), bucket, _p=("lag", "t")).filter(F.col("_p").isNull() | (F.col("t") - F.col("_p") >= minimum)).drop("_p")


def bursts(events: DataFrame, keys: Sequence[str], lo: float = 0.003, hi: float = 0.015, mark: str | None = None, nevents: tuple[int, int] | None = None, order: Sequence[str] = ("t",), bucket: float = SECONDS) -> DataFrame:
    """Add ``burst``: 0 none, 1 first, 2 middle, 3 last event of a burst (successive intervals in [lo, hi], marks not increasing)."""
    v = F.col(mark) if mark else F.lit(0)
    here = F.struct(F.col("t").alias("t"), v.alias("v"))
    d = scan(events, keys, list(order), bucket, _p=("lag", here), _n=("lead", here))
    was = F.coalesce((F.col("t") - F.col("_p.t")).between(lo, hi) & (v <= F.col("_p.v")), F.lit(False))
    goes = F.coalesce((F.col("_n.t") - F.col("t")).between(lo, hi) & (F.col("_n.v") <= v), F.lit(False))
    d = d.withColumn("burst", F.when(~was & goes, 1).when(was & goes, 2).when(was, 3).otherwise(0)).drop("_p", "_n")
    return burst_length(d, keys, nevents, order, bucket) if nevents else d


def burst_length(d: DataFrame, keys: Sequence[str], nevents: tuple[int, int] | int = 2, order: Sequence[str] = ("t",), bucket: float = SECONDS) -> DataFrame:
    """Set ``burst`` to 0 for bursts with fewer or more events than the pair, or, for one number n, with at least n."""
    d = scan(d, keys, list(order), bucket, _b=("sum", F.when(F.col("burst") == 1, 1).otherwise(0)))
    # events of one burst meet; events of none stay apart, by bucket
    group = F.when(F.col("burst") > 0, F.struct(F.col("_b").alias("b"), F.lit(0).cast("long").alias("o"))).otherwise(F.struct(F.lit(-1).cast("long").alias("b"), bucket_of(F.col(order[0]), bucket).alias("o")))
    d = d.withColumn("_g", group)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_g"))
    keep = size.between(*nevents) if isinstance(nevents, tuple) else size < nevents
    return d.withColumn("_s", keep).withColumn("burst", F.when((F.col("burst") > 0) & F.col("_s"), F.col("burst")).otherwise(0)).drop("_b", "_s", "_g")


BURST_FILTERS = {"none": "true", "reduce": "burst <= 1", "remove": "burst = 0", "isolate": "burst <> 0", "isolatereduce": "burst = 1"}


def filter_bursts(d: DataFrame, method: str = "none") -> DataFrame:
    return d.filter(BURST_FILTERS[method])


def count_until(events: DataFrame, probes: DataFrame, keys: Sequence[str], id: str, bucket: float = SECONDS) -> DataFrame:
    """Per probe the number of events at or before it."""
    e = events.filter("t is not null").select(*keys, "t", F.lit(1).alias("_d"), F.lit(None).cast(probes.schema[id].dataType).alias("_id"))
    p = probes.select(*keys, "t", F.lit(0).alias("_d"), F.col(id).alias("_id"))
    both = e.unionByName(p).withColumn("_after", 1 - F.col("_d"))
    return scan(both, keys, ["t", "_after"], bucket, n=("sum", "_d")).filter("_d = 0").select(*keys, F.col("_id").alias(id), "n")


def complex_spike_index(events: DataFrame, keys: Sequence[str], mark: str | None, lo: float, hi: float, bucket: float = SECONDS) -> DataFrame:
    """100 x (nearest intervals up to hi whose amplitude falls over time, minus those where it rises or that are shorter than lo), floor-divided by the events. Without a mark amplitudes are equal."""
    v = F.col(mark) if mark else F.lit(0.0)
    here = F.struct(F.col("t").alias("t"), v.alias("v"))
    d = scan(events, keys, ["t"], bucket, _p=("lag", here), _n=("lead", here))
    d = d.withColumns({"_pre": F.col("_p.t") - F.col("t"), "_post": F.col("_n.t") - F.col("t"), "_ap": F.col("_p.v") - v, "_an": F.col("_n.v") - v})
    near = F.col("_post") <= F.abs("_pre")
    dt, da = F.when(near, F.col("_post")).otherwise(F.col("_pre")), F.when(near, F.col("_an")).otherwise(F.col("_ap"))
    burst = ((dt < 0) & (da >= 0)) | ((dt > 0) & (da < 0))
    other = ((dt > 0) & (da >= 0)) | ((dt < 0) & (da < 0))
    sign = F.when(burst & (F.abs(dt) >= lo), 1).otherwise(0) - F.when(other | (F.abs(dt) < lo), 1).otherwise(0)
    sign = F.when((F.abs(dt) <= hi) & F.col("_pre").isNotNull() & F.col("_post").isNotNull(), sign).otherwise(0)
    return d.withColumn("_s", sign).groupBy(*keys).agg(F.floor(100 * F.sum("_s") / F.count(F.lit(1))).alias("csi"))


def correlation(events: DataFrame, reference: DataFrame, keys: Sequence[str], lo: float, hi: float, segs: DataFrame | None = None, width: float = 1.0, remove_zero_lag: bool = False, unbiased: str = "none") -> DataFrame:
    """Times of events relative to references within the closed window [lo, hi]; reference and event in one closed segment.

    ``unbiased``: ``strict`` keeps references whose whole window lies in the segment, ``relaxed`` lets the event lie outside.
    """
    ref = reference
    if segs is not None:
        m = S.merge(segs, keys, strict=False)
        ref = range_join(ref, m, keys, width, closed=True).withColumnsRenamed({"start": "_s0", "stop": "_s1"})
        if unbiased == "strict":
            ref = ref.filter((F.col("t") + lo >= F.col("_s0")) & (F.col("t") + hi <= F.col("_s1")))
    d = band_join(ref, events, keys, lo, hi)
    if segs is not None and unbiased != "relaxed":
        d = d.filter((F.col("t_r") >= F.col("_s0")) & (F.col("t_r") <= F.col("_s1")))
    if segs is not None:
        d = d.drop("_s0", "_s1")
    return d.filter("lag <> 0") if remove_zero_lag else d


def joint_correlation(events: DataFrame, reference: DataFrame, signal: DataFrame, keys: Sequence[str], lo: float, hi: float, value: str = "v") -> DataFrame:
    """Correlation with the value of a signal nearest to the reference's time."""
    b = asof_join(reference, signal, keys, [value], "backward", prefix="_b_")
    f = asof_join(b, signal, keys, [value], "forward", prefix="_f_")
    use_b = F.col("_f_t").isNull() | ((F.col("t") - F.col("_b_t")) <= (F.col("_f_t") - F.col("t")))
    ref = f.withColumn("x", F.when(use_b, F.col(f"_b_{value}")).otherwise(F.col(f"_f_{value}"))).drop("_b_t", f"_b_{value}", "_f_t", f"_f_{value}")
    return band_join(ref, events, keys, lo, hi)


NORMALIZATIONS = ("none", "coef", "rate", "conditional mean intensity", "product density", "cross covariance", "cumulant density", "standard cross covariance", "zscore")


def peri_event_histogram(events: DataFrame, reference: DataFrame, keys: Sequence[str], lo: float, hi: float, nbins: int, normalization: str = "none", remove_zero_lag: bool = False) -> DataFrame:
    """Histogram of relative times in ``nbins`` equal bins (the last one closed), for each key, with empty bins.

    p0 and p1 are the rates of reference and events over T, the span of both series; b is the bin width.
    """
    if normalization not in NORMALIZATIONS:
        raise ValueError(normalization)
    b = (hi - lo) / nbins
    lags = correlation(events, reference, keys, lo, hi, remove_zero_lag=remove_zero_lag)
    hist = lags.withColumn("bin", F.least(F.floor((F.col("lag") - lo) / b), F.lit(nbins - 1)).cast("int")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    both = events.select(*keys, "t", F.lit(1).alias("_e"), F.lit(0).alias("_r")).unionByName(reference.select(*keys, "t", F.lit(0).alias("_e"), F.lit(1).alias("_r")))
    ends = both.groupBy(*keys).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    inside = F.col("t") < F.col("_t1")  # membership is half-open
    totals = both.join(ends, list(keys)).groupBy(*keys).agg(F.max(F.col("_t1") - F.col("_t0")).alias("T"), F.sum(F.when(inside, F.col("_e")).otherwise(0)).alias("ne"), F.sum(F.when(inside, F.col("_r")).otherwise(0)).alias("nr"), F.sum("_r").alias("nv"))
    grid = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))))
    d = grid.join(hist, [*keys, "bin"], "left").fillna({"n": 0})
    n, T = F.col("n").cast("double"), F.col("T")
    p1, p0 = F.try_divide(F.col("ne"), T), F.try_divide(F.col("nr"), T)
    product = F.try_divide(n, b * T)
    cross = product - p1 * p0
    value = {
        "none": n, "coef": F.try_divide(n, F.col("nv")), "rate": F.try_divide(n, F.col("nv") * b), "conditional mean intensity": F.try_divide(n, F.col("nv") * b),
        "product density": product, "cross covariance": cross, "cumulant density": cross, "standard cross covariance": F.sqrt(F.try_divide(b * T, p1 * p0)) * cross,
        "zscore": F.try_divide(cross, p1 * p0 / (b * T)),
    }[normalization]
    return d.select(*keys, "bin", value.alias("value"))


def density(events: DataFrame, keys: Sequence[str], lo: float, hi: float, n: int, bandwidth: float, reach: float = 8.0) -> DataFrame:
    """Gaussian density of the events on ``n`` grid points; each event meets only the grid points within ``reach`` bandwidths."""
    step = (hi - lo) / (n - 1)
    total = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - reach * bandwidth - lo) / step)).cast("int")
    last = F.least(F.lit(n - 1), F.floor((F.col("t") + reach * bandwidth - lo) / step)).cast("int")
    d = events.withColumns({"_a": first, "_z": last}).filter("_a <= _z").select(*keys, "t", F.explode(F.sequence("_a", "_z")).alias("i"))
    u = (lo + F.col("i") * step - F.col("t")) / bandwidth
    sums = d.groupBy(*keys, "i").agg(F.sum(F.exp(-0.5 * u * u)).alias("_s"))
    grid = total.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.join(sums, [*keys, "i"], "left").select(*keys, "i", (F.coalesce("_s", F.lit(0.0)) / (F.col("_n") * bandwidth * math.sqrt(2 * math.pi))).alias("density"))


def peri_event_density(events: DataFrame, triggers: DataFrame, keys: Sequence[str], lo: float, hi: float, n: int, bandwidth: float) -> DataFrame:
    """Gaussian density of relative times, per trigger, on a grid of lags."""
    lags = band_join(triggers.select(*keys, "t"), events.select(*keys, "t"), keys, lo, hi)
    count = triggers.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nt"))
    pairs = lags.groupBy(*keys).agg(F.count(F.lit(1)).alias("_np"))
    d = density(lags.select(*keys, F.col("lag").alias("t")), keys, lo, hi, n, bandwidth)
    return d.join(count, list(keys)).join(pairs, list(keys)).select(*keys, "i", (F.col("density") * F.col("_np") / F.col("_nt")).alias("rate"))


def tiling_coefficient(a: DataFrame, b: DataFrame, epochs: DataFrame, keys: Sequence[str], dt: float) -> DataFrame:
    """Spike time tiling coefficient: 1/2 ((pa - tb) / (1 - pa tb) + (pb - ta) / (1 - pb ta)) within the epochs."""

    def around(d: DataFrame) -> DataFrame:
        start, stop = S.from_duration(F.col("t"), 2 * dt)
        return S.intersection([d.select(*keys, start, stop), epochs], keys)

    def length(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy(*keys).agg(F.sum(F.col("stop") - F.col("start")).alias(name))

    def share(d: DataFrame, tiles: DataFrame, name: str) -> DataFrame:
        inside = range_join(d, epochs, keys, 1e6, how="left_semi")
        hit = range_join(inside, tiles, keys, 10 * dt, how="left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_h"))
        return inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(hit, list(keys), "left").select(*keys, (F.coalesce("_h", F.lit(0)) / F.col("_n")).alias(name))

    ta, tb = around(a), around(b)
    d = length(epochs, "_t").join(length(ta, "_ta"), list(keys)).join(length(tb, "_tb"), list(keys)).join(share(a, tb, "pa"), list(keys)).join(share(b, ta, "pb"), list(keys))
    fa, fb = F.col("_ta") / F.col("_t"), F.col("_tb") / F.col("_t")
    one = lambda p, f: F.coalesce(F.try_divide(p - f, 1 - p * f), F.lit(1.0))
    return d.select(*keys, (0.5 * (one(F.col("pa"), fb) + one(F.col("pb"), fa))).alias("sttc"))


def shift(events: DataFrame, segs: DataFrame, keys: Sequence[str], by: float, width: float, circular: bool = True, bucket: float = SECONDS) -> DataFrame:
    """Shift events within the joined segments (gaps removed, then put back); ``circular`` wraps, else leavers are dropped."""
    m = S.merge(segs, keys, bucket=bucket).withColumn("_d", F.col("stop") - F.col("start"))
    m = scan(m, keys, ["start"], bucket, _hi=("sum", "_d")).withColumn("_lo", F.col("_hi") - F.col("_d"))
    total = m.groupBy(*keys).agg(F.sum("_d").alias("_all")).withColumnsRenamed({k: f"_t_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    m = m.join(total, on).drop(*[f"_t_{k}" for k in keys])
    flat = range_join(events, m, keys, width).withColumn("_u", F.col("t") - F.col("start") + F.col("_lo") + by)
    flat = flat.withColumn("_u", F.col("_u") - F.floor(F.col("_u") / F.col("_all")) * F.col("_all")) if circular else flat.filter("_u >= 0 and _u < _all")
    flat = flat.select(*events.columns, "_u")
    back = range_join(flat, m.select(*keys, F.col("_lo").alias("_a"), F.col("_hi").alias("_z"), F.col("start").alias("_s")), keys, width, t="_u", start="_a", stop="_z")
    return back.withColumn("t", F.col("_s") + F.col("_u") - F.col("_a")).select(*events.columns)
