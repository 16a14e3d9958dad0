"""Order-dependent plans that never put one key's rows into one task.

A window over ``partitionBy(key)`` breaks down when a key holds a large share of all rows. Here each key is cut into buckets of
the order (time, position, angle); a bucket is small whatever its key weighs. What a row needs from outside its bucket (how
many rows, which row came last, the largest value so far) comes from a table with one row per bucket, which is the only thing
a window over the whole key ever sees. Rows are shuffled once, by key and bucket; the summary reuses that exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Default bucket of times in seconds, and of sample positions.
SECONDS, POSITIONS = 3600.0, float(1 << 16)
_FAR = 4e18


def bucket_of(time: Column, width: float) -> Column:
    """Whole number of the bucket; infinite times lie in the outermost ones."""
    return F.floor(F.least(F.greatest(time.cast("double") / F.lit(float(width)), F.lit(-_FAR)), F.lit(_FAR))).cast("long")


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float, **specs: tuple[str, Column | str | None]) -> DataFrame:
    """Add running columns, name=(kind, value), in the order of ``order`` within each key; equal rows are told apart by the values.

    Kinds: ``rank`` (0-based), ``sum`` (up to and with the row), ``max_before`` (largest of all earlier rows), ``last`` and ``next``
    (nearest value that isn't null at or before, at or after the row), ``lag`` and ``lead`` (value of the row before, after), and
    ``count``, ``max`` and ``min`` of the whole key. ``order[0]`` is the number that buckets of ``width`` cut; its nulls come first,
    in a bucket of their own. Null keys form a key. An empty input gives no rows.
    """
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    values = {f"__v{i}": F.lit(1) if v is None else F.col(v) if isinstance(v, str) else v for i, (_, v) in enumerate(specs.values())}
    d = df.withColumns({"__key": key, "__bucket": F.coalesce(bucket_of(F.col(order[0]), width), F.lit(-(1 << 63)))}).withColumns(values)
    d = d.repartition("__key", "__bucket")
    ordered = [F.col(o) for o in dict.fromkeys([*order, *[v for v, (kind, x) in zip(values, specs.values()) if x is not None and kind in ("lag", "lead", "last", "next")]])]
    rank_of = F.struct(*[x for o in ordered for x in (o.isNotNull(), o)])
    inner = Window.partitionBy("__key", "__bucket").orderBy(*ordered)
    # Spark reads a frame that ends at the last row anew for every row, so what lies ahead is read backwards
    upto, ahead = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (inner, Window.partitionBy("__key", "__bucket").orderBy(*[o.desc() for o in ordered])))
    outer = Window.partitionBy("__key").orderBy("__bucket")
    prior, later = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (outer, Window.partitionBy("__key").orderBy(F.desc("__bucket"))))
    whole = Window.partitionBy("__key")
    inside: dict[str, Column] = {}
    sums: dict[str, Column] = {}
    carries: dict[str, Column] = {}
    out: dict[str, Column] = {}
    for (name, (kind, _)), v in zip(specs.items(), values):
        x, i, s, c = F.col(v), f"__i{v}", f"__s{v}", f"__c{v}"
        if kind in ("rank", "sum"):
            inside[i] = F.row_number().over(inner) - 1 if kind == "rank" else F.coalesce(F.sum(x).over(upto), F.lit(0))
            sums[s], carries[c] = F.count(F.lit(1)) if kind == "rank" else F.coalesce(F.sum(x), F.lit(0)), F.coalesce(F.sum(s).over(prior), F.lit(0))
            out[name] = (F.col(c) + F.col(i)).cast("long") if kind == "rank" else F.col(c) + F.col(i)
        elif kind == "max_before":
            inside[i], sums[s], carries[c] = F.max(x).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.max(x), F.max(s).over(prior)
            out[name] = F.greatest(i, c)
        elif kind in ("last", "next"):
            known = F.when(x.isNotNull(), rank_of)
            inside[i] = F.last(x, True).over(upto if kind == "last" else ahead)
            sums[s] = F.max_by(x, known) if kind == "last" else F.min_by(x, known)
            carries[c] = F.last(s, True).over(prior if kind == "last" else later)
            out[name] = F.coalesce(i, c)
        elif kind in ("lag", "lead"):
            row = F.struct(x.alias("x"))
            inside[i] = F.lag(row).over(inner) if kind == "lag" else F.lead(row).over(inner)
            sums[s] = F.max_by(row, rank_of) if kind == "lag" else F.min_by(row, rank_of)
            carries[c] = F.lag(s).over(outer) if kind == "lag" else F.lead(s).over(outer)
            out[name] = F.coalesce(i, c)["x"]
        else:
            total = {"count": (F.count(x), F.sum), "max": (F.max(x), F.max), "min": (F.min(x), F.min)}[kind]
            sums[s], carries[c], out[name] = total[0], total[1](s).over(whole), F.col(c)
    summary = d.groupBy("__key", "__bucket").agg(*[x.alias(n) for n, x in sums.items()]).select("__key", "__bucket", *[x.alias(n) for n, x in carries.items()])
    rows = d.withColumns(inside) if inside else d
    kept = [c for c in df.columns if c not in out]
    return rows.join(summary, ["__key", "__bucket"]).select(*kept, *[x.alias(n) for n, x in out.items()])


def near(df: DataFrame, keys: Sequence[str], position: str, before: int, after: int, width: float = POSITIONS, **columns: Column) -> DataFrame:
    """Add columns computed over a window of at most ``before`` rows back and ``after`` ahead, by name = a function of the window.

    Rows are cut by position into chunks; a chunk gets copies of what lies within ``before`` and ``after`` of it. ``position`` must
    number the rows of a key without gaps (``bucketed_rank``).
    """
    halo = max(before, after, 1)
    chunks = chunk_with_halo(df, position, max(int(width), halo), halo)
    w = Window.partitionBy(*keys, "_chunk").orderBy(position)
    return chunks.withColumns({n: f(w) for n, f in columns.items()}).filter("_core").drop("_chunk", "_core")


def bucketed_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float, rank: str = "_rank") -> DataFrame:
    """Add the 0-based position of each row within its key, ordered by ``order`` (the first of which is the time).

    Rows with a null time must be removed before. Equal rows get successive positions. An empty input gives no rows.
    """
    return scan(df, keys, order, width, **{rank: ("rank", None)})


def bucketed_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], width: float, prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<column>``: the value in the preceding row of the same key; null in the first row of a key."""
    out = scan(df, keys, order, width, __prev=("lag", F.struct(*columns)))
    return out.select(*df.columns, *[F.col("__prev")[c].alias(f"{prefix}{c}") for c in columns])


def chunk_with_halo(df: DataFrame, rank: str, chunk_rows: int, halo: int) -> DataFrame:
    """Cut each key into chunks of ``chunk_rows`` positions; the outer ``halo`` rows of a chunk are copied to its neighbours.

    Adds ``_chunk`` and ``_core`` (false for a copy). ``halo`` must not exceed ``chunk_rows``.
    """
    if halo > chunk_rows:
        raise ValueError("halo must not exceed chunk_rows")
    at, chunk = F.col(rank) % chunk_rows, F.floor(F.col(rank) / chunk_rows).cast("long")
    copies = F.array_compact(F.array(
        F.struct(chunk.alias("c"), F.lit(True).alias("core")),
        F.when((at < halo) & (chunk > 0), F.struct((chunk - 1).alias("c"), F.lit(False).alias("core"))),
        F.when(at >= chunk_rows - halo, F.struct((chunk + 1).alias("c"), F.lit(False).alias("core"))),
    ))
    return df.withColumn("_to", F.explode(copies)).select(*df.columns, F.col("_to.c").alias("_chunk"), F.col("_to.core").alias("_core"))
