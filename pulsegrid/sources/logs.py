"""Text logs of acquisition software as tables; files are read by Spark, so they may lie on any storage it knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The line of a log, the source of a message, what names a time and a source in an error, and the line of a lost stretch.
LINE = r"-\* +([A-Z]+) +\*- +[0-9:.]+ +- +([0-9]+) +- (.*)"
SOURCE = r"^([A-Za-z0-9_]+::[A-Za-z0-9_]+\(\)) +- +(.*)"
ERROR_TIME = r"[tT]imestamp: ([0-9]+)"
ERROR_SOURCES = (r"Data Source Name: ([0-9A-Za-z_\-]+)", r"(VT[0-9]+)")
LOST = r"([0-9]+), ([0-9]+), ([0-9]+), RecordsLost"


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("encoding", "ISO-8859-1").text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value"))


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines as kind, timestamp (µs), source (null if none is named) and message; other lines are left out."""
    rest = F.regexp_extract(column, LINE, 3)
    named = F.regexp_extract(rest, SOURCE, 1)
    d = lines.filter(F.col(column).rlike(LINE))
    return d.select(*[c for c in lines.columns if c != column], F.regexp_extract(column, LINE, 1).alias("kind"), F.regexp_extract(column, LINE, 2).cast("long").alias("timestamp"), F.when(named != "", named).alias("source"), F.when(named != "", F.regexp_extract(rest, SOURCE, 2)).otherwise(rest).alias("message"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The logs at a path: file, kind, timestamp, source, message."""
    return parse_log(_text(spark, path))


def errors(log: DataFrame, start_us: int | None = None, stop_us: int | None = None) -> DataFrame:
    """Errors of a parsed log by what they are about: adds ``about`` (unknown if nothing is named); the message's own time counts if it has one.

    The half-open window from start to stop bounds the time.
    """
    own = F.regexp_extract("message", ERROR_TIME, 1)
    d = log.filter("kind = 'ERROR'").withColumn("timestamp", F.when(own != "", own.cast("long")).otherwise(F.col("timestamp")))
    names: list[Column] = [F.nullif(F.regexp_extract("message", p, 1), F.lit("")) for p in ERROR_SOURCES]
    d = d.withColumn("about", F.coalesce(*names, F.lit("unknown")))
    if start_us is not None:
        d = d.filter(F.col("timestamp") >= start_us)
    return d if stop_us is None else d.filter(F.col("timestamp") < stop_us)


def read_lost_records(spark: SparkSession, path: str) -> DataFrame:
    """Stretches of lost records: file, start_us, stop_us, lost."""
    d = _text(spark, path).withColumn("value", F.regexp_extract("value", LOST, 0)).filter("value <> ''")
    return d.select("file", *[F.regexp_extract("value", LOST, i).cast("long").alias(n) for i, n in ((1, "start_us"), (2, "stop_us"), (3, "lost"))])
