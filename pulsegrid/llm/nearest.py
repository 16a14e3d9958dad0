"""Pair records of two tables with the nearest record in time of the same entity, within a tolerance.

Tick expansion: the time axis is cut into ticks as wide as the tolerance. Each right record is expanded to every tick from
which it can be reached (its own and both neighbours). Per entity and tick only the nearest candidates stay: the last record
before the tick, the first one after it, and the distinct times inside it (at most as many as the tick has clock units). Left
records join their tick and take the nearest candidate on either side in one ordered pass, so a tick costs its rows, never
their pairs, and no list of a tick is ever built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, left_id: str, right_time: str, right_id: str, tolerance: int) -> DataFrame:
    """For each left record the right record of the same ``keys`` with the smallest time distance, at most ``tolerance`` (bound included).

    Of equally near right records the smallest id wins. Gives left_id, target_id and distance; left records without a
    partner give no row. Null keys or times take no part. Repeated right records (same keys and time) are reduced to the
    smallest id before anything is expanded; repeated left records each get their row. Ticks that hold no left record are
    removed before the expansion is kept, so the work follows the smaller side. Other columns are ignored, so clashing names
    do no harm. Times are whole numbers on one clock.
    """
    width = int(tolerance) + 1
    tick = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    keys = list(keys)
    l = left.select(*keys, F.col(left_time).alias("_lt"), F.col(left_id).alias("_lid")).dropna(subset=[*keys, "_lt", "_lid"]).withColumn("_tick", tick("_lt"))
    r = right.select(*keys, F.col(right_time).alias("_rt"), F.col(right_id).alias("_rid")).dropna(subset=[*keys, "_rt", "_rid"])
    # ticks from which some left record looks, widened by one to both sides: only right records there matter
    around = l.select(*keys, "_tick").distinct().select(*keys, F.explode(F.array(F.col("_tick") - 1, F.col("_tick"), F.col("_tick") + 1)).alias("_tick")).distinct()
    first = r.groupBy(*keys, "_rt").agg(F.min("_rid").alias("_rid")).withColumn("_tick", tick("_rt"))
    near = first.join(around, [*keys, "_tick"], "left_semi")
    wanted = l.select(*keys, "_tick").distinct()
    expanded = near.select(*keys, "_rt", "_rid", F.inline(F.array(*[F.struct((F.col("_tick") + d).alias("_to"), F.lit(d).alias("_side")) for d in (-1, 0, 1)])))
    expanded = expanded.withColumnRenamed("_to", "_tick").join(wanted, [*keys, "_tick"], "left_semi")
    record = F.struct("_rt", "_rid")
    kept = expanded.groupBy(*keys, "_tick", "_side", F.when(F.col("_side") == 0, F.col("_rt")).alias("_own")).agg(F.when(F.col("_side") == 1, F.max(record)).otherwise(F.min(record)).alias("_r"))
    both = kept.select(*keys, "_tick", F.col("_r._rt").alias("_t"), "_r").unionByName(l.select(*keys, "_tick", F.col("_lt").alias("_t"), "_lid"), allowMissingColumns=True)
    tick_rows = Window.partitionBy(*keys, "_tick").orderBy("_t", F.col("_r").isNull())  # a candidate at the same time comes first
    before = F.last("_r", True).over(tick_rows.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_r", True).over(tick_rows.rowsBetween(0, Window.unboundedFollowing))
    sides = both.withColumns({"_b": before, "_a": after}).filter("_lid is not null")
    distance = lambda r: F.struct(F.abs(F.col("_t") - F.col(r)["_rt"]).alias("distance"), F.col(r)["_rid"].alias("target_id"))
    best = F.array_min(F.array_compact(F.array(*[F.when(F.col(r).isNotNull(), distance(r)) for r in ("_b", "_a")])))
    paired = sides.select(F.col("_lid").alias(left_id), best.alias("_m")).filter(F.col("_m.distance") <= tolerance)
    return paired.select(left_id, F.col("_m.target_id").alias("target_id"), F.col("_m.distance").alias("distance"))
