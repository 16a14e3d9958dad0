"""The event container, and operators on whole series: clocks, shuffles, order checks, display reductions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import events as E
from pulsegrid.operators import segments as S
from pulsegrid.plans.joins import asof_join, range_join
from pulsegrid.plans.ordered import POSITIONS, SECONDS, bucketed_rank, scan


class Events:
    """Events of series (``keys``) at times ``t``; further columns are their attributes and follow every operation.

    ``+ number`` and ``- number`` shift, ``+ Events`` concatenates, ``==`` gives a frame of the rows that only one side has
    (empty if equal; repeated events count).
    """

    def __init__(self, df: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("t",)):
        missing = [c for c in (*keys, "t") if c not in df.columns]
        if missing:
            raise ValueError(f"columns missing: {missing}")
        self.df, self.keys, self.order = df, list(keys), list(order)

    def _new(self, df: DataFrame) -> Events:
        return Events(df, self.keys, self.order)

    def set_attribute(self, name: str, value: Column) -> Events:
        return self._new(self.df.withColumn(name, value))

    def del_attribute(self, name: str) -> Events:
        return self._new(self.df.drop(name))

    def attributes(self) -> list[str]:
        return [c for c in self.df.columns if c not in (*self.keys, "t")]

    def offset(self, value: float | Column) -> Events:
        return self._new(self.df.withColumn("t", F.col("t") + value))

    def concat(self, *others: Events) -> Events:
        df = self.df
        for o in others:
            df = df.unionByName(o.df, allowMissingColumns=True)
        return self._new(df)

    def __add__(self, other: Events | float) -> Events:
        return self.concat(other) if isinstance(other, Events) else self.offset(other)

    def __sub__(self, value: float) -> Events:
        if isinstance(value, Events):
            raise ValueError("events can't be subtracted from events")
        return self.offset(-value)

    def __eq__(self, other: object) -> DataFrame:  # type: ignore[override]
        if not isinstance(other, Events):
            return NotImplemented
        return same(self.df, other.df, [*self.keys, "t"])

    def between(self, lo: float, hi: float) -> Events:
        """Events of the half-open range, as slicing by time."""
        return self._new(self.df.filter((F.col("t") >= lo) & (F.col("t") < hi)))

    def is_sorted(self, position: str) -> DataFrame:
        return is_sorted(self.df, self.keys, position, "t")

    def count(self) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(F.count("t").alias("n"))

    def rate(self, segs: DataFrame | None = None, width: float = 1.0) -> DataFrame:
        return E.rate(self.df, self.keys, segs, width)

    def intervals(self, segs: DataFrame | None = None, width: float = 1.0) -> DataFrame:
        return E.intervals(self.df, self.keys, self.order, segs, width)

    def bin(self, bins: DataFrame, width: float, kind: str = "count") -> DataFrame:
        return E.bin_events(self.df, bins, self.keys, width, kind)

    def bursts(self, lo: float = 0.003, hi: float = 0.015, mark: str | None = None, nevents: tuple[int, int] | None = None) -> DataFrame:
        return E.bursts(self.df, self.keys, lo, hi, mark, nevents, self.order)

    def filter_bursts(self, method: str = "reduce", **options) -> Events:
        return self._new(E.filter_bursts(self.bursts(**options), method).drop("burst"))

    def filter_intervals(self, minimum: float = 0.003) -> Events:
        return self._new(E.filter_intervals(self.df, self.keys, minimum, self.order))

    def complex_spike_index(self, mark: str | None = None, lo: float = 0.003, hi: float = 0.015) -> DataFrame:
        return E.complex_spike_index(self.df, self.keys, mark, lo, hi)

    def density(self, lo: float, hi: float, n: int, bandwidth: float) -> DataFrame:
        return E.density(self.df, self.keys, lo, hi, n, bandwidth)

    def peri_event_histogram(self, reference: Events, lo: float, hi: float, nbins: int, normalization: str = "none") -> DataFrame:
        return E.peri_event_histogram(self.df, reference.df, self.keys, lo, hi, nbins, normalization)

    def peri_event_density(self, triggers: Events, lo: float, hi: float, n: int, bandwidth: float) -> DataFrame:
        return E.peri_event_density(self.df, triggers.df, self.keys, lo, hi, n, bandwidth)

    def average(self, signal: DataFrame, lo: float, hi: float, step: float) -> DataFrame:
        from pulsegrid.operators.signals import triggered_average

        return triggered_average(signal, self.df, self.keys, lo, hi, step)


def same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (with ``n``, the count in a minus the count in b) that two tables don't have alike; none if they are equal as bags."""
    both = a.select(*columns, F.lit(1).alias("n")).unionByName(b.select(*columns, F.lit(-1).alias("n")))
    return both.groupBy(*columns).agg(F.sum("n").alias("n")).filter("n <> 0")


def is_sorted(df: DataFrame, keys: Sequence[str], position: str, x: str, bucket: float = POSITIONS) -> DataFrame:
    """Per key: ascending, strictly ascending, descending, strictly descending along ``position``; a null breaks all."""
    d = scan(df.select(*keys, F.col(position).alias("_i"), F.col(x).alias("_x")), keys, ["_i"], bucket, _p=("lag", F.struct("_x")))
    later = F.col("_p").isNotNull()
    every = lambda c: F.coalesce(F.bool_and(F.when(later, F.coalesce(c, F.lit(False)))), F.lit(True))
    p = F.col("_p._x")
    return d.groupBy(*keys).agg(every(F.col("_x") >= p).alias("ascending"), every(F.col("_x") > p).alias("strictly_ascending"), every(F.col("_x") <= p).alias("descending"), every(F.col("_x") < p).alias("strictly_descending"))


def randomize(df: DataFrame, keys: Sequence[str], position: str, columns: Sequence[str], method: str = "shuffle", seed: int = 0, bucket: float = POSITIONS) -> DataFrame:
    """``columns`` moved together to other rows of the key: ``shuffle`` (a seeded permutation) or ``roll`` (by a seeded distance)."""
    moved = F.struct(*columns)
    d = scan(df.select(*keys, position, moved.alias("_v")), keys, [position], bucket, _i=("rank", None), _n=("count", None))
    if method == "roll":
        by = F.pmod(F.xxhash64(F.lit(seed), *keys), F.col("_n"))
        d = d.withColumn("_to", F.pmod(F.col("_i") + by, F.col("_n")))
    elif method == "shuffle":
        d = d.withColumn("_h", F.pmod(F.xxhash64(F.lit(seed), *keys, "_i"), F.lit(1 << 40)) / float(1 << 40) * F.col("_n"))
        d = bucketed_rank(d, keys, ["_h", "_i"], bucket, "_to")
    else:
        raise ValueError(method)
    a = d.select(*keys, position, F.col("_i").alias("_at"))
    b = d.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_to").alias("_at2"), "_v")
    on = F.col("_at") == F.col("_at2")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return a.join(b, on).select(*keys, position, "_v.*")


def nearest(grid: DataFrame, df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The row of the series that is nearest to each time of a grid (the earlier of two equally near): its time and columns as ``near_``."""
    b = asof_join(grid, df, keys, columns, "backward", prefix="_b_")
    f = asof_join(b, df, keys, columns, "forward", prefix="_f_")
    back = F.col("_f_t").isNull() | (F.col("t") - F.col("_b_t") <= F.col("_f_t") - F.col("t"))
    return f.select(*grid.columns, *[F.when(back, F.col(f"_b_{c}")).otherwise(F.col(f"_f_{c}")).alias(f"near_{c}") for c in ("t", *columns)])


def event_image(events: DataFrame, keys: Sequence[str], lo: float, hi: float, pixels: int) -> DataFrame:
    """The pixels (0 .. pixels - 1 of [lo, hi)) that hold an event, for display."""
    x = F.floor((F.col("t") - lo) / ((hi - lo) / pixels)).cast("int")
    return events.filter((F.col("t") >= lo) & (F.col("t") < hi)).select(*keys, F.least(x, F.lit(pixels - 1)).alias("pixel")).distinct()


def thin(df: DataFrame, keys: Sequence[str], lo: float, hi: float, every: int, order: Sequence[str] = ("t",), bucket: float = SECONDS) -> DataFrame:
    """Every n-th sample of the closed range [lo, hi], for display."""
    return bucketed_rank(df.filter(F.col("t").between(lo, hi)), keys, list(order), bucket).filter(F.col("_rank") % every == 0).drop("_rank")


def interpolated_times(df: DataFrame, t: str, dt: float, factor: int) -> DataFrame:
    """Each time as ``factor`` times, dt / factor apart."""
    return df.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn(t, F.col(t) + F.col("_j") * dt / factor).drop("_j")


def clock_lag(a: DataFrame, b: DataFrame, maxlag: int, bucket: float = SECONDS) -> DataFrame:
    """Shift (in pulses) at which the intervals of two pulse trains on different clocks agree best: lag, score (Pearson), pairs.

    One row for each lag up to ``maxlag`` either way; pulse i of ``b`` belongs to pulse i + lag of ``a``.
    """
    intervals = lambda d: scan(d.select("t"), [], ["t"], bucket, i=("rank", None), _n=("lead", "t")).filter("_n is not null").select("i", (F.col("_n") - F.col("t")).alias("d"))
    x, y = intervals(a), intervals(b).withColumn("lag", F.explode(F.sequence(F.lit(-maxlag), F.lit(maxlag))))
    pairs = y.select("lag", (F.col("i") + F.col("lag")).alias("i"), F.col("d").alias("e")).join(x, "i")
    return pairs.groupBy("lag").agg(F.corr("d", "e").alias("score"), F.count(F.lit(1)).alias("pairs"))


def synchronize(a: DataFrame, b: DataFrame, maxlag: int, bucket: float = SECONDS) -> DataFrame:
    """How clock b maps to clock a, from matched pulses: lag, shift (mean difference), drift and intercept (t_a = intercept + drift t_b), pairs."""
    best = clock_lag(a, b, maxlag, bucket).orderBy(F.desc(F.coalesce(F.round("score", 12), F.lit(-2.0))), F.abs("lag"), "lag").first()  # one row
    if best is None:
        return clock_lag(a, b, 0, bucket).limit(0).select("lag", F.lit(0.0).alias("shift"), F.lit(0.0).alias("drift"), F.lit(0.0).alias("intercept"), "pairs")
    number = lambda d, n: bucketed_rank(d.select(F.col("t").alias(n)), [], [n], bucket, f"_{n}")
    pairs = number(b, "tb").withColumn("lag", F.lit(best["lag"])).withColumn("_ta", F.col("_tb") + F.col("lag")).join(number(a, "ta"), "_ta")
    return pairs.groupBy("lag").agg(F.avg(F.col("ta") - F.col("tb")).alias("shift"), F.regr_slope("ta", "tb").alias("drift"), F.regr_intercept("ta", "tb").alias("intercept"), F.count(F.lit(1)).alias("pairs"))


def recording_times(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First start and last stop of a recording by its system messages: start_us, stop_us."""
    text = F.lower(F.translate("eventstring", "\0", " "))
    start, stop = F.when(text.contains("starting recording"), F.col("timestamp")), F.when(text.contains("stopping recording"), F.col("timestamp"))
    return events.groupBy(*keys).agg(F.min(start).alias("start_us"), F.max(stop).alias("stop_us"))


def sync_signal(ttl: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The (board, port, bit) that a recording's TTL values ever set, if there is just one; null bits where it isn't unique."""
    bits = ttl.select(*keys, "board", "port", F.explode(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.call_function("getbit", F.col("value"), b) == 1)).alias("bit")).distinct()
    one = F.count(F.lit(1)) == 1
    return bits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.when(one, F.min(c)).alias(c) for c in ("board", "port", "bit")])


def segments_equal(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments that two sets don't have alike (see ``same``)."""
    return same(a, b, [*keys, "start", "stop"])


def nth_segments(df: DataFrame, keys: Sequence[str], first: int, last: int, bucket: float = SECONDS) -> DataFrame:
    """Segments at positions first .. last - 1 of each key in the order of start and stop, as indexing."""
    return bucketed_rank(S.valid(df).select(*keys, "start", "stop"), keys, ["start", "stop"], bucket, "position").filter((F.col("position") >= first) & (F.col("position") < last))


def clipped_to(events: DataFrame, segs: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Events with the start of the merged segment they lie in, as ``segment``."""
    return range_join(events, S.merge(segs, keys), keys, width).withColumnRenamed("start", "segment").drop("stop")
