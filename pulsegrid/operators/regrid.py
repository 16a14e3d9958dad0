"""Irregular readings of cumulative counters on a regular grid.

Increments between successive readings (a falling counter is a reset) are spread over the grid cells they overlap, in
proportion to the overlap; cells that no increment covers are marked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.plans.ordered import bucketed_lag


def counter_increments(df: DataFrame, keys: Sequence[str], time: str, counter: str, bucket: float, max_span: Column | None = None, begins: str | None = None) -> DataFrame:
    """Successive readings -> (keys, t0, t1, amount, reset).

    ``begins`` names a column with the time from which a reading counted, where the source knows it: increments of uneven
    readings may then overlap.

    A counter below its predecessor was reset and its own value is the amount. ``max_span`` bounds how far before a reading
    its increment reaches; the rest of the time since the last reading stays uncovered. The first reading of a key has an
    increment only if ``max_span`` is given (its own value). Rows with a null time or counter are left out. Of readings at
    one time the largest counter follows the smaller ones; the others have zero length and give no rows.
    """
    rows = df.filter(F.col(time).isNotNull() & F.col(counter).isNotNull())
    lagged = bucketed_lag(rows.select(*keys, time, counter, *[begins] * bool(begins)), keys, [time, counter], [time, counter], bucket)
    prev_t, prev_c = F.col(f"prev_{time}"), F.col(f"prev_{counter}")
    reset = F.coalesce(F.col(counter) < prev_c, F.lit(False))
    amount = F.when(prev_c.isNull() | reset, F.col(counter)).otherwise(F.col(counter) - prev_c)
    floor = F.col(time) - max_span if max_span is not None else prev_t
    t0 = F.col(begins) if begins else F.greatest(prev_t, floor) if max_span is not None else prev_t
    return lagged.select(*keys, t0.alias("t0"), F.col(time).alias("t1"), amount.cast("double").alias("amount"), reset.alias("reset")).filter("t0 < t1")


def distribute(increments: DataFrame, keys: Sequence[str], origin: Column, period: Column) -> DataFrame:
    """Spread each increment over the cells [origin + k period, origin + (k+1) period) it overlaps: keys, cell, amount, covered (share of the cell; over 1 where increments overlap),
    filled (one increment alone covers most of the cell; of two equal halves the one from its beginning)."""
    lo, hi = (F.col("t0") - origin) / period, (F.col("t1") - origin) / period
    cells = increments.select("*", lo.alias("_lo"), hi.alias("_hi"), F.explode(F.sequence(F.floor(lo), F.greatest(F.ceil(hi) - 1, F.floor(lo)))).alias("cell"))
    overlap = F.least("_hi", F.col("cell") + 1) - F.greatest("_lo", F.col("cell"))
    share = cells.withColumn("_part", overlap).filter("_part > 0")
    most = F.when(F.col("_lo") <= F.col("cell"), F.col("_part") >= 0.5).otherwise(F.col("_part") > 0.5)
    return share.groupBy(*keys, "cell").agg(F.sum(F.col("amount") * F.col("_part") / (F.col("_hi") - F.col("_lo"))).alias("amount"), F.sum("_part").alias("covered"), F.max(most).alias("filled"))


def mark_uncovered(cells: DataFrame, keys: Sequence[str], block: int = 4096, first: int | None = None) -> DataFrame:
    """The whole grid of each key up to its last filled cell, with ``covered`` 0 and a null amount for cells nothing covers.

    The grid begins at each key's first cell, or at ``first``. It is built in blocks, so a long series is spread.
    """
    ends = cells.filter("filled").groupBy(*keys).agg(F.min("cell").alias("_a"), F.max("cell").alias("_b"))
    if first is not None:
        ends = ends.withColumn("_a", F.lit(first).cast("long"))
    blocks = ends.select(*keys, "_a", "_b", F.explode(F.sequence(F.floor(F.col("_a") / block), F.floor(F.col("_b") / block))).alias("_block"))
    blocks = blocks.repartition(*keys, "_block")
    grid = blocks.select(*keys, F.explode(F.sequence(F.greatest("_a", F.col("_block") * block), F.least("_b", F.col("_block") * block + block - 1))).alias("cell"))
    return grid.join(cells, [*keys, "cell"], "left").select(*keys, "cell", "amount", F.coalesce("covered", F.lit(0.0)).alias("covered"), F.coalesce("filled", F.lit(False)).alias("filled"))
