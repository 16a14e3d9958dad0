"""Interval ("segment") algebra on DataFrames with the columns keys..., start, stop; half-open for membership.

Set operations are one sweep over the boundaries of all sets, without a join. Null bounds are left out; a stop before its
start is an error of the data and is left out as well (``invalid`` finds such rows). What depends on order runs as a bucketed
scan (``plans.ordered``), so no key's rows meet in one task; ``bucket`` is the span of a bucket on the axis of the segments.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.plans.joins import interval_join, range_join
from pulsegrid.plans.ordered import POSITIONS, SECONDS, bucketed_rank, scan

INF = float("inf")


def valid(df: DataFrame) -> DataFrame:
    return df.filter(F.col("start").isNotNull() & F.col("stop").isNotNull() & (F.col("stop") >= F.col("start")))


def invalid(df: DataFrame) -> DataFrame:
    """Rows that are no segments."""
    return df.filter(~F.coalesce(F.col("stop") >= F.col("start"), F.lit(False)))


def from_vector(df: DataFrame, keys: Sequence[str], order: str, v: str, bucket: float = SECONDS) -> DataFrame:
    """A vector a, b, c as adjacent segments [a, b], [b, c]."""
    return scan(df.select(*keys, F.col(order).alias("_o"), F.col(v).alias("start")), keys, ["_o"], bucket, stop=("lead", "start")).filter("stop is not null").drop("_o")


def from_duration(anchor: Column, duration: Column | float, reference: float = 0.5) -> tuple[Column, Column]:
    """start and stop of segments of a duration whose anchor lies at the share ``reference`` of it."""
    d = duration if isinstance(duration, Column) else F.lit(float(duration))
    return (anchor - reference * d).alias("start"), (anchor + (1 - reference) * d).alias("stop")


def from_logical(df: DataFrame, keys: Sequence[str], order: str, flag: Column, x: str | None = None, interpolate: bool = False, bucket: float = POSITIONS) -> DataFrame:
    """Runs of true as [first, last] of ``x`` (or ``order``), both included; ``interpolate`` adds half a sample at both ends, within the data."""
    x = x or order
    d = df.select(*keys, F.col(order).alias("_o"), F.col(x).alias("_x"), F.coalesce(flag, F.lit(False)).alias("_on"))
    d = scan(d, keys, ["_o"], bucket, _before=("lag", F.struct("_on", "_x")), _after=("lead", F.struct("_on", "_x"))).filter("_on")
    head, tail = ~F.coalesce(F.col("_before._on"), F.lit(False)), ~F.coalesce(F.col("_after._on"), F.lit(False))
    lo = F.coalesce((F.col("_before._x") + F.col("_x")) / 2, F.col("_x")) if interpolate else F.col("_x")
    hi = F.coalesce((F.col("_after._x") + F.col("_x")) / 2, F.col("_x")) if interpolate else F.col("_x")
    ends = d.filter(head | tail).select(*keys, "_o", F.when(head, lo).alias("start"), F.when(tail, hi).alias("stop"))
    return scan(ends, keys, ["_o"], bucket, _stop=("next", "stop")).filter("start is not null").select(*keys, "start", F.col("_stop").alias("stop"))


def from_indices(df: DataFrame, keys: Sequence[str], i: str, bucket: float = POSITIONS) -> DataFrame:
    """Runs of successive whole numbers as [first, last]."""
    d = scan(df.select(*keys, F.col(i).alias("_i")), keys, ["_i"], bucket, _p=("lag", "_i"), _n=("lead", "_i"))
    head, tail = ~F.coalesce(F.col("_i") - F.col("_p") <= 1, F.lit(False)), ~F.coalesce(F.col("_n") - F.col("_i") <= 1, F.lit(False))
    ends = d.filter(head | tail).select(*keys, "_i", F.when(head, F.col("_i")).alias("start"), F.when(tail, F.col("_i")).alias("stop"))
    return scan(ends, keys, ["_i"], bucket, _stop=("next", "stop")).filter("start is not null").select(*keys, "start", F.col("_stop").alias("stop"))


def from_onoff(on: DataFrame, off: DataFrame, keys: Sequence[str], greedy_start: bool = False, greedy_stop: bool = False, t: str = "t", bucket: float = SECONDS) -> DataFrame:
    """Pair on and off events: the last on of a run with the first off after it; greedy: the first on, or the last off."""
    both = on.select(*keys, F.col(t).alias("t"), F.lit(0).alias("_off")).unionByName(off.select(*keys, F.col(t).alias("t"), F.lit(1).alias("_off")))
    d = scan(both, keys, ["t", "_off"], bucket, _p=("lag", "_off"), _q=("lead", "_off"))
    first_on, last_on = F.coalesce(F.col("_p") == 1, F.lit(True)), F.coalesce(F.col("_q") == 1, F.lit(True))
    first_off, last_off = F.coalesce(F.col("_p") == 0, F.lit(True)), F.coalesce(F.col("_q") == 0, F.lit(True))
    keep = F.when(F.col("_off") == 0, first_on if greedy_start else last_on).otherwise(last_off if greedy_stop else first_off)
    d = scan(d.filter(keep).select(*keys, "t", "_off"), keys, ["t", "_off"], bucket, _n=("lead", F.struct("t", "_off")))
    return d.filter("_off = 0 and _n._off = 1").select(*keys, F.col("t").alias("start"), F.col("_n.t").alias("stop"))


def merge(df: DataFrame, keys: Sequence[str], strict: bool = True, gap: float = 0.0, bucket: float = SECONDS) -> DataFrame:
    """Overlapping segments as one; ``strict`` also fuses touching ones, ``gap`` those at most that far apart.

    One scan finds the rows that begin a period and the largest stop before each; a second one, over those rows only, gives each
    period its stop: the largest stop before the next one, or of the whole key.
    """
    d = scan(valid(df).select(*keys, "start", "stop"), keys, ["start", "stop"], bucket, _p=("max_before", "stop"), _last=("max", "stop"))
    reach = F.col("_p") + F.lit(float(gap)) if gap else F.col("_p")
    heads = d.filter(F.col("_p").isNull() | (F.col("start") > reach if strict or gap else F.col("start") >= reach))
    heads = scan(heads.select(*keys, "start", "_p", "_last"), keys, ["start"], bucket, _stop=("lead", "_p"))
    return heads.select(*keys, "start", F.coalesce("_stop", "_last").alias("stop"))


def join_gaps(df: DataFrame, keys: Sequence[str], gap: float = 0.0) -> DataFrame:
    """Merge, also over gaps of at most ``gap``."""
    return merge(df, keys, True, gap)


def invert(df: DataFrame, keys: Sequence[str], bucket: float = SECONDS) -> DataFrame:
    """The complement on the real line, from -inf to inf, per key that has a segment."""
    m = scan(merge(df, keys, bucket=bucket), keys, ["start"], bucket, _a=("lag", "stop"), _z=("lead", "start"))
    before = m.select(*keys, F.coalesce("_a", F.lit(-INF)).alias("_s"), F.col("start").alias("_e"), "stop", "_z")
    pieces = F.array(F.struct(F.col("_s").alias("start"), F.col("_e").alias("stop")), F.struct(F.when(F.col("_z").isNull(), F.col("stop")).alias("start"), F.lit(INF).alias("stop")))
    return before.select(*keys, F.inline(pieces)).filter("start < stop")


def sweep(sets: Sequence[DataFrame], keys: Sequence[str], holds: Callable[[list[Column]], Column], bucket: float = SECONDS) -> DataFrame:
    """Where ``holds`` is true of the sets' coverage: it gets one boolean column per set. Points are not segments, so what has zero length disappears."""
    n = len(sets)
    steps = None
    for i, s in enumerate(sets):
        ends = F.array(*[F.struct(F.col(at).cast("double").alias("t"), *[F.lit(d if j == i else 0).alias(f"_d{j}") for j in range(n)]) for at, d in (("start", 1), ("stop", -1))])
        rows = valid(s).select(*keys, F.inline(ends))
        steps = rows if steps is None else steps.unionByName(rows)
    steps = steps.groupBy(*keys, "t").agg(*[F.sum(f"_d{j}").alias(f"_d{j}") for j in range(n)])
    state = scan(steps, keys, ["t"], bucket, stop=("lead", "t"), **{f"_c{j}": ("sum", f"_d{j}") for j in range(n)})
    state = state.withColumn("_on", holds([F.col(f"_c{j}") > 0 for j in range(n)])).filter("stop is not null")
    return merge(state.filter("_on").select(*keys, F.col("t").alias("start"), "stop"), keys, bucket=bucket)


def union(sets: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    out = sets[0].select(*keys, "start", "stop")
    for s in sets[1:]:
        out = out.unionByName(s.select(*keys, "start", "stop"))
    return merge(out, keys)


def _all(c: list[Column]) -> Column:
    out = c[0]
    for x in c[1:]:
        out = out & x
    return out


def _any(c: list[Column]) -> Column:
    out = c[0]
    for x in c[1:]:
        out = out | x
    return out


def intersection(sets: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return merge(sets[0], keys) if len(sets) == 1 else sweep(sets, keys, _all)


def difference(sets: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Covered by some set but not by all."""
    return sweep(sets, keys, lambda c: _any(c) & ~_all(c))


def exclusive(sets: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """In the first set and in no other; the first set itself, overlaps included, if there is no other."""
    return sets[0] if len(sets) == 1 else sweep(sets, keys, lambda c: c[0] & ~_any(c[1:]))


def span(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def has_overlap(df: DataFrame, keys: Sequence[str], bucket: float = SECONDS) -> DataFrame:
    """Per key whether two segments overlap by more than a point."""
    return scan(df, keys, ["start", "stop"], bucket, _n=("lead", "start")).groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("_n") < F.col("stop")), F.lit(False)).alias("has_overlap"))


def intervals(df: DataFrame, keys: Sequence[str], order: str = "start", bucket: float = SECONDS) -> DataFrame:
    """Start of the next segment minus the stop of this one."""
    return scan(df, keys, [order], bucket, _n=("lead", "start")).withColumn("interval", F.col("_n") - F.col("stop")).drop("_n")


def scale(df: DataFrame, value: float, reference: float = 0.5) -> DataFrame:
    delta = (F.col("stop") - F.col("start")) * (value - 1)
    return df.withColumns({"start": F.col("start") - reference * delta, "stop": F.col("stop") + (1 - reference) * delta})


def offset(df: DataFrame, value: float | Column) -> DataFrame:
    return df.withColumns({"start": F.col("start") + value, "stop": F.col("stop") + value})


def contains(points: DataFrame, segs: DataFrame, keys: Sequence[str], width: float, anti: bool = False) -> DataFrame:
    """The points inside (or, ``anti``, outside) the segments of their key."""
    return range_join(points, segs, keys, width, how="left_anti" if anti else "left_semi")


def _aggregated(hits: DataFrame, segs: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates of the points of each distinct segment, joined to every occurrence of it; null keys and bounds match themselves."""
    by = [*keys, "start", "stop"]
    found = hits.groupBy(*by).agg(*aggregates).withColumnsRenamed({c: f"_r_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return segs.join(found, on, "left").drop(*[f"_r_{c}" for c in by])


def count_in(points: DataFrame, segs: DataFrame, keys: Sequence[str], width: float, order: Sequence[str] = ("t",)) -> DataFrame:
    """Per segment the number of points inside and the 0-based positions of the first and last of them, or -1.

    Overlapping segments count their points each, repeated segments the same ones; null keys are a key of their own.
    """
    ranked = bucketed_rank(points, keys, list(order), width, "_i").select(*keys, "t", "_i")
    spans = segs.select(*keys, "start", "stop").distinct()
    out = _aggregated(range_join(ranked, spans, keys, width), segs, keys, [F.count(F.lit(1)).alias("n"), F.min("_i").alias("first"), F.max("_i").alias("last")])
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "first": F.coalesce("first", F.lit(-1)), "last": F.coalesce("last", F.lit(-1))})


def depth(points: DataFrame, segs: DataFrame, keys: Sequence[str], id: str, bucket: float = SECONDS) -> DataFrame:
    """Per point the number of segments that contain it, by one sweep (stops and starts before points at one time)."""
    ends = F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("_d")), F.struct(F.col("stop").alias("t"), F.lit(-1).alias("_d")))
    s = valid(segs).select(*keys, F.inline(ends)).withColumns({"_r": F.lit(0), "_id": F.lit(None).cast(points.schema[id].dataType)})
    p = points.filter("t is not null").select(*keys, "t", F.lit(0).alias("_d"), F.lit(1).alias("_r"), F.col(id).alias("_id"))
    return scan(s.unionByName(p), keys, ["t", "_r"], bucket, depth=("sum", "_d")).filter("_r = 1").select(*keys, F.col("_id").alias(id), "depth")


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Overlapping pairs with the overlap, also relative to either duration (null where that is zero)."""
    o = F.least("stop", "stop_b") - F.greatest("start", "start_b")
    return interval_join(a, b, keys, width).withColumns({"overlap": o, "rel_a": F.try_divide(o, F.col("stop") - F.col("start")), "rel_b": F.try_divide(o, F.col("stop_b") - F.col("start_b"))})


def split(df: DataFrame, size: float = 1.0, overlap: float = 0.0, tol: float = 1e-7) -> DataFrame:
    """Windows of ``size`` inside each segment, each overlapping the last by the share ``overlap``; the rest is dropped."""
    step = (1 - overlap) * size
    n = (F.col("stop") - F.col("start") - overlap * size) / step
    bins = F.when(F.ceil(n) - n < tol, F.ceil(n)).otherwise(F.floor(n)).cast("long")
    d = df.withColumn("_n", bins).filter("_n >= 1").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    start = F.col("start") + F.col("_k") * step
    return d.withColumns({"start": start, "stop": start + size}).drop("_n", "_k")


def apply_aggregates(points: DataFrame, segs: DataFrame, keys: Sequence[str], width: float, **aggregates: Column) -> DataFrame:
    """Aggregates of the points inside each segment; null for a segment without points. Repeated segments get the same values each."""
    spans = segs.select(*keys, "start", "stop").distinct()
    return _aggregated(range_join(points, spans, keys, width), segs, keys, [c.alias(k) for k, c in aggregates.items()])


def apply_in_pandas(points: DataFrame, segs: DataFrame, keys: Sequence[str], width: float, function: Callable, schema: str) -> DataFrame:
    """An arbitrary function of the points of each segment (pandas in, pandas out)."""
    return range_join(points, segs, keys, width).groupBy(*keys, "start", "stop").applyInPandas(function, schema)


def partition(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int | None = None, nparts: int | None = None, method: str = "block", seed: int = 0, keep_remainder: bool = True, bucket: float = POSITIONS) -> DataFrame:
    """Rows in parts: ``block`` (runs of ``size``, or ``nparts`` nearly equal runs), ``sequence`` (every nparts-th), ``random`` (blocks of a seeded order)."""
    d = df.withColumn("_h", F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(1 << 40)))
    d = scan(d, keys, ["_h", *order], float(1 << 30), _i=("rank", None), _n=("count", None)) if method == "random" else scan(d, keys, list(order), bucket, _i=("rank", None), _n=("count", None))
    i, n = F.col("_i"), F.col("_n")
    if method == "sequence":
        part = i % nparts
    elif size:
        part = F.floor(i / size)
    else:  # the first parts have one row more
        small, more = F.floor(n / nparts), n % nparts
        part = F.when(i < more * (small + 1), F.floor(i / (small + 1))).otherwise(more + F.floor((i - more * (small + 1)) / F.greatest(small, F.lit(1))))
    out = d.withColumn("part", part.cast("long"))
    if size and not keep_remainder:
        out = out.filter((F.col("part") + 1) * size <= n)
    return out.drop("_h", "_i", "_n")


def uniform_random(segs: DataFrame, n: int, seed: int = 0, bucket: float = SECONDS) -> DataFrame:
    """``n`` points uniform on the union of all segments: drawn on the joined length, put back by their cumulative range."""
    s = scan(valid(segs).select(F.col("start").cast("double").alias("start"), (F.col("stop") - F.col("start")).alias("_d")), [], ["start", "_d"], bucket, _hi=("sum", "_d")).withColumn("_lo", F.col("_hi") - F.col("_d"))
    total = segs.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0.0
    draws = segs.sparkSession.range(n).select("id", (F.rand(seed) * total).alias("t"))
    hits = range_join(draws, s.select(F.col("_lo").alias("_a"), F.col("_hi").alias("_z"), F.col("start").alias("_s")), [], max(total / 1000, 1e-9), start="_a", stop="_z")
    return hits.select("id", (F.col("_s") + F.col("t") - F.col("_a")).alias("t"))


class Segments:
    """Fluent form of the functions above: ``|`` union, ``&`` intersection, ``^`` difference, ``~`` complement, ``+`` concat or offset."""

    def __init__(self, df: DataFrame, keys: Sequence[str] = ()):
        self.df, self.keys = df, list(keys)

    def _new(self, df: DataFrame) -> Segments:
        return Segments(df, self.keys)

    def __or__(self, other: Segments) -> Segments:
        return self._new(union([self.df, other.df], self.keys))

    def __and__(self, other: Segments) -> Segments:
        return self._new(intersection([self.df, other.df], self.keys))

    def __xor__(self, other: Segments) -> Segments:
        return self._new(difference([self.df, other.df], self.keys))

    def __invert__(self) -> Segments:
        return self._new(invert(self.df, self.keys))

    def __add__(self, other: Segments | float) -> Segments:
        return self._new(self.df.unionByName(other.df) if isinstance(other, Segments) else offset(self.df, other))

    def __sub__(self, value: float) -> Segments:
        return self._new(offset(self.df, -value))

    def __mul__(self, value: float) -> Segments:
        return self._new(scale(self.df, value))

    def __truediv__(self, value: float) -> Segments:
        return self._new(scale(self.df, 1 / value))

    def exclusive(self, *others: Segments) -> Segments:
        return self._new(exclusive([self.df, *[o.df for o in others]], self.keys))

    def join(self, gap: float = 0.0) -> Segments:
        return self._new(join_gaps(self.df, self.keys, gap))

    def split(self, size: float = 1.0, overlap: float = 0.0) -> Segments:
        return self._new(split(self.df, size, overlap))

    def remove_overlap(self, strict: bool = True) -> Segments:
        return self._new(merge(self.df, self.keys, strict))

    def span(self) -> DataFrame:
        return span(self.df, self.keys)

    def contains(self, points: DataFrame, width: float) -> DataFrame:
        return contains(points, self.df, self.keys, width)

    def durations(self) -> DataFrame:
        return self.df.withColumns({"duration": F.col("stop") - F.col("start"), "center": (F.col("start") + F.col("stop")) / 2})
