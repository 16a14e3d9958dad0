"""Joins on time that Spark has no operator for: range, interval, band and as-of joins as equi-joins on time buckets.

None of them compares all pairs of a key: a bucket is part of the join key, and the exact predicate filters what is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.plans.ordered import SECONDS, scan


def _bucket(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(float(width))).cast("long")


def range_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], width: float, t: str = "t", start: str = "start", stop: str = "stop", how: str = "inner", closed: bool = False) -> DataFrame:
    """Points with the intervals of their key that hold them: ``start <= t < stop``, or ``<= stop`` if ``closed``.

    ``how``: inner, left (all points), left_semi, left_anti. ``width`` should be near the usual interval length; interval
    bounds must be finite. Columns other than the keys must not clash. Null times and bounds match nothing.
    """
    spread = intervals.filter(F.col(start).isNotNull() & F.col(stop).isNotNull()).withColumn("_b", F.explode(F.sequence(_bucket(F.col(start), width), _bucket(F.col(stop), width))))
    p, s = points.withColumn("_b", _bucket(F.col(t), width)).alias("p"), spread.alias("s")
    inside = (F.col(f"p.{t}") >= F.col(f"s.{start}")) & ((F.col(f"p.{t}") <= F.col(f"s.{stop}")) if closed else (F.col(f"p.{t}") < F.col(f"s.{stop}")))
    on = (F.col("p._b") == F.col("s._b")) & inside
    for k in keys:
        on = on & F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}"))
    joined = p.join(s, on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_b")
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"s.{c}") for c in intervals.columns if c not in keys])


def interval_join(a: DataFrame, b: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Pairs of intervals (columns start, stop) of one key that overlap by more than a point; b's columns get the suffix ``_b``.

    Both sides are spread over their buckets; a pair is kept in the bucket of the later start only, so it appears once.
    """
    spread = lambda d: d.withColumn("_b", F.explode(F.sequence(_bucket(F.col("start"), width), _bucket(F.col("stop"), width))))
    right = spread(b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys]).withColumnsRenamed({"start_b": "start", "stop_b": "stop"})).withColumnsRenamed({"start": "start_b", "stop": "stop_b"})
    pairs = spread(a).join(right, [*keys, "_b"])
    once = F.col("_b") == _bucket(F.greatest("start", "start_b"), width)
    return pairs.filter((F.col("start") < F.col("stop_b")) & (F.col("start_b") < F.col("stop")) & once).drop("_b")


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], lo: float, hi: float, t: str = "t", suffix: str = "_r") -> DataFrame:
    """Pairs with ``left.t + lo <= right.t <= left.t + hi``; right's columns get the suffix, ``lag`` is right minus left."""
    width = max(hi - lo, 1e-9)
    l = left.withColumn("_b", F.explode(F.sequence(_bucket(F.col(t) + lo, width), _bucket(F.col(t) + hi, width))))
    r = right.select(*keys, *[F.col(c).alias(c + suffix) for c in right.columns if c not in keys]).withColumn("_b", _bucket(F.col(t + suffix), width))
    lag = F.col(t + suffix) - F.col(t)
    return l.join(r, [*keys, "_b"]).withColumn("lag", lag).filter((F.col("lag") >= lo) & (F.col("lag") <= hi)).drop("_b")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], direction: str = "backward", t: str = "t", prefix: str = "asof_", bucket: float = SECONDS) -> DataFrame:
    """Each left row with the right row of its key at or before (backward), or at or after (forward), its time.

    One scan by key and time over the union of both sides, in buckets, so a hot key is spread; ties are inclusive, and of right
    rows at one time the one of the largest (backward) or smallest (forward) columns counts. The time and ``columns`` of the match
    come as ``prefix`` columns, null where there is none.
    """
    state = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate([t, *columns])])
    rows = F.struct(*[F.col(c) for c in left.columns])
    l = left.select(*keys, F.col(t).alias("_t"), rows.alias("_row"))
    r = right.select(*keys, F.col(t).alias("_t"), state.alias("_s"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_side", F.when(F.col("_row").isNotNull(), 1).otherwise(0 if direction == "backward" else 2))
    out = scan(both, keys, ["_t", "_side"], bucket, _m=("last" if direction == "backward" else "next", "_s")).filter("_side = 1")
    return out.select("_row.*", *[F.col(f"_m.v{i}").alias(prefix + c) for i, c in enumerate([t, *columns])])
