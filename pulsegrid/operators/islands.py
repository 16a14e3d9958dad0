"""Overlapping and gapped intervals: continuous periods and the gaps between them, by a range-sorted scan.

All rows are range-sorted by entity and start, so a hot entity spreads over many partitions. Each partition is reduced to
its largest end per entity (and later its number of period heads); those summaries, at most one row per entity and
partition, are prefix-combined, and a rescan with the carried state labels the islands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import frozen


def label_islands(df: DataFrame, keys: Sequence[str], start: str = "start", stop: str = "stop", gap=0, touching: bool = True) -> DataFrame:
    """Add ``island`` (1, 2, ... per entity) and ``prev_stop`` (the largest stop of all earlier rows of the entity).

    Rows belong to one island if they overlap, nest, touch (unless ``touching`` is false) or lie at most ``gap`` apart.
    Rows with a null start or stop, or that stop before they start, are left out. Null keys form an entity of their own.
    """
    rows = df.filter(F.col(start).isNotNull() & F.col(stop).isNotNull() & (F.col(stop) >= F.col(start)))
    by = [F.col(k).isNotNull().alias(f"_k{i}n") for i, k in enumerate(keys)]
    key = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]
    ids = [f"_k{i}{n}" for i in range(len(keys)) for n in ("n", "")]
    ranged = rows.select("*", *by, *key).repartitionByRange(*ids, start).withColumn("_pid", F.spark_partition_id())
    ranged = frozen(ranged)  # partition numbers must not change between the passes
    prior = Window.partitionBy(*ids).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy(*ids, "_pid").agg(F.max(stop).alias("_end")).withColumn("_carry", F.max("_end").over(prior)).drop("_end")
    scan = Window.partitionBy(*ids, "_pid").orderBy(start, stop)
    before = scan.rowsBetween(Window.unboundedPreceding, -1)
    prev = F.greatest(F.max(stop).over(before), F.col("_carry"))
    reach = F.col("prev_stop") + F.lit(gap)
    apart = F.col(start) > reach if touching else F.col(start) >= reach
    heads = ranged.join(ends, [*ids, "_pid"]).withColumn("prev_stop", prev).withColumn("_head", F.when(F.col("prev_stop").isNull() | apart, 1).otherwise(0))
    counts = heads.groupBy(*ids, "_pid").agg(F.sum("_head").alias("_heads"))
    counts = counts.select(*ids, "_pid", F.coalesce(F.sum("_heads").over(prior), F.lit(0)).alias("_labels"))
    running = F.sum("_head").over(scan.rowsBetween(Window.unboundedPreceding, 0))
    labelled = heads.withColumn("_running", running).join(counts, [*ids, "_pid"])
    return labelled.withColumn("island", (F.col("_labels") + F.col("_running")).cast("long")).drop("_carry", "_labels", "_running", "_pid", *ids)


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str = "start", stop: str = "stop", gap=0) -> DataFrame:
    """Per entity, its merged periods and the gaps between successive ones: keys, kind, start, stop.

    An empty input gives no rows; repeated rows change nothing; zero-length intervals count as periods.
    """
    labelled = label_islands(df.select(*keys, start, stop), keys, start, stop, gap)
    periods = labelled.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(stop).alias(stop))
    gaps = labelled.filter("_head = 1 and prev_stop is not null").select(*keys, F.lit("gap").alias("kind"), F.col("prev_stop").alias(start + "_"), F.col(start).alias(stop + "_"))
    gaps = gaps.withColumnsRenamed({start + "_": start, stop + "_": stop})
    return periods.select(*keys, F.lit("period").alias("kind"), start, stop).unionByName(gaps)
