"""General statistics: binning, grouped aggregation, p-values, modes, distances, information."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = (0.001, 0.01, 0.05)


def bin_index(x: Column, lo: float, hi: float, n: int) -> Column:
    """0-based bin of n equal bins in [lo, hi); null outside (the last edge is open)."""
    return F.when((x >= lo) & (x < hi), F.least(F.floor((x - lo) / ((hi - lo) / n)), F.lit(n - 1)).cast("int"))


def bin_index_edges(x: Column, edges: Sequence[float]) -> Column:
    """The same for given sorted edges."""
    i = sum((F.when(x >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return F.when((x >= edges[0]) & (x < edges[-1]), i)


def dense(df: DataFrame, keys: Sequence[str], axes: dict[str, int], value: str, fill=0) -> DataFrame:
    """A sparse result on the full grid of its axes (0 .. n - 1 each), missing cells filled."""
    grid = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    for a, n in axes.items():
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.join(df, [*keys, *axes], "left").fillna({value: fill})


def stars(p: Column, levels: Sequence[float] = LEVELS) -> Column:
    """One star for each level that p lies below, else n.s.; null for null."""
    n = sum((F.when(p < a, 1).otherwise(0) for a in levels), F.lit(0))
    return F.when(p.isNotNull(), F.when(n > 0, F.repeat(F.lit("*"), n)).otherwise("n.s."))


def exact(p: Column, precision: int = 3) -> Column:
    return F.when(p < 10.0**-precision, F.format_string(f"p=%.{precision}e", p)).when(p.isNotNull(), F.format_string(f"p=%.{precision}f", p))


def relative(p: Column, levels: Sequence[float] = LEVELS) -> Column:
    out = F.lit(f"p≥{max(levels):g}")
    for a in sorted(levels, reverse=True):
        out = F.when(p < a, f"p<{a:g}").otherwise(out)
    return F.when(p.isNotNull(), out)


def monte_carlo_pvalue(simulated: str, test: Column, tails: str = "right", center: float = 0.0) -> Column:
    """(simulated at least as extreme + 1) / (simulated + 1), as an aggregate; null simulations don't count."""
    x, t = F.col(simulated) - center, test - center
    hit = {"right": x >= t, "left": x <= t, "both": F.abs(x) >= F.abs(t)}[tails]
    return (F.count_if(hit) + 1) / (F.count(x) + 1)


def combine_pvalues(p: str, method: str) -> Column:
    """Aggregate: nichols max(p), friston max(p)^n, tippett 1 - (1 - min p)^n (for fisher see below)."""
    n = F.count(p)
    if method == "nichols":
        return F.max(p)
    if method == "friston":
        return F.pow(F.max(p), n)
    if method == "tippett":
        return 1 - F.pow(1 - F.min(p), n)
    raise ValueError(method)


def fisher(df: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """Fisher's combined p-value per key: the tail of a chi-square with 2n degrees of freedom, in closed form."""
    d = df.groupBy(*keys).agg(F.count(p).cast("int").alias("_n"), (-F.sum(F.ln(p))).alias("_x"))
    # terms exp(-x) x^j / j! by their logarithms: exp(-x) is 0 and x^j infinite for some hundred values
    start = F.struct((-F.col("_x")).alias("term"), F.lit(0.0).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.col("_n")), start, lambda s, k: F.struct((s["term"] + F.ln(F.col("_x") / k)).alias("term"), (s["sum"] + F.exp(s["term"])).alias("sum")))
    return d.select(*keys, F.when(F.col("_x") <= 0, 1.0).otherwise(total["sum"]).alias("p"))


def mode_kde(df: DataFrame, keys: Sequence[str], x: str, grid: int = 201, decimals: int = 2) -> DataFrame:
    """The grid point of the largest Gaussian density (Scott's bandwidth, grid over the data's range).

    Values are first counted at ``decimals`` places, so the work per key is its distinct values times the grid.
    """
    d = df.filter(F.col(x).isNotNull()).groupBy(*keys, F.round(x, decimals).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    s = df.groupBy(*keys).agg(F.count(x).alias("_n"), F.stddev_samp(x).alias("_sd"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    j = d.join(s, list(keys)).withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), -0.2))
    j = j.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("_x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("g") / (grid - 1))
    u = (F.col("_x") - F.col("_v")) / F.col("_h")
    dens = j.groupBy(*keys, "g", "_x").agg(F.sum(F.col("_c") * F.exp(-0.5 * u * u)).alias("_d"))
    return dens.groupBy(*keys).agg(F.max(F.struct(F.round("_d", 6).alias("d"), (-F.col("g")).alias("g"), F.col("_x").alias("x"))).alias("_m")).select(*keys, F.col("_m.x").alias("mode"))


def beta_parameters(mode: Column, concentration: Column) -> tuple[Column, Column]:
    return (mode * (concentration - 2) + 1).alias("alpha"), ((1 - mode) * (concentration - 2) + 1).alias("beta")


def spatial_information(df: DataFrame, keys: Sequence[str], rate: str, occupancy: str, per_second: bool = False) -> DataFrame:
    """Bits per spike, or per second, of a rate map; bins without spikes add nothing."""
    n = F.col(rate) * F.col(occupancy)
    total = df.groupBy(*keys).agg(F.sum(n).alias("_n"), F.sum(occupancy).alias("_t"))
    term = F.when(F.col(rate) > 0, n / F.col("_n") * F.log2(F.col(rate) / (F.col("_n") / F.col("_t"))))
    d = df.join(total, list(keys)).groupBy(*keys, "_n", "_t").agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("information"))
    return d.select(*keys, (F.col("information") * F.col("_n") / F.col("_t") if per_second else F.col("information")).alias("information"))


def bhattacharyya(p: Column, q: Column) -> Column:
    """Sum of sqrt(p q) of two arrays; its negative log is the distance."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.sqrt(a * b)), F.lit(0.0), lambda s, x: s + x)


def bhattacharyya_distance(p: Column, q: Column) -> Column:
    return -F.ln(bhattacharyya(p, q))


def hellinger(p: Column, q: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 1 - bhattacharyya(p, q)))


def weighted_distance(p: Column, q: Column, exponent: float = 2.0) -> Column:
    """(sum over i, j of p_i q_j |i - j|^e)^(1/e), positions as coordinates."""
    row = lambda a, i: F.aggregate(F.transform(q, lambda b, j: a * b * F.pow(F.abs(i - j).cast("double"), F.lit(exponent))), F.lit(0.0), lambda s, x: s + x)
    return F.pow(F.aggregate(F.transform(p, row), F.lit(0.0), lambda s, x: s + x), F.lit(1 / exponent))


def in_range(x: Column, low: float | None = None, high: float | None = None, closed: bool = True) -> Column:
    """Inside the range; outside it if low > high."""
    above = (x >= low if closed else x > low) if low is not None else F.lit(True)
    below = (x <= high if closed else x < high) if high is not None else F.lit(True)
    return above | below if low is not None and high is not None and low > high else above & below


def natural_key(text: Column) -> Column:
    """A sort key in which runs of digits compare as numbers: leading zeros go, and the count of digits (as one character) goes first."""
    digits = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    number = lambda d: F.concat(F.lpad(F.length(d).cast("string"), 10, "0"), F.lit(":"), d)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1), lambda x: F.when(x.rlike(r"^\d"), number(digits(x))).otherwise(x)), "")


def bootstrap_statistic(df: DataFrame, keys: Sequence[str], statistic: dict[str, Column] | Column, x: str, nsamples: int = 200, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile interval of any weighted statistic of ``x`` by the Poisson bootstrap.

    Equal values of a key are one row with a count n first; resample b gives it a weight from Poisson(n), drawn by the seed, so the
    data are read once, nothing is joined, and repeated rows are independent. ``statistic`` is an aggregate of the columns ``x`` and
    ``w`` (its weight); by default callers use the weighted mean.
    """
    counted = df.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("_n"))
    reps = counted.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(nsamples))))
    draw = lambda i: (F.pmod(F.xxhash64(F.lit(seed), "b", F.struct(*keys, "x"), i), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cuts, p, c = [], math.exp(-1), 0.0
    for k in range(12):
        c += p
        cuts.append(c)
        p /= k + 1
    one = lambda u: sum((F.when(u > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    draws = F.transform(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(32)).cast("int")), draw)
    few = F.aggregate(draws, F.lit(0), lambda s, u: s + one(u))
    reps = reps.withColumn("_u", draw(F.lit(1)))  # most values occur once
    normal = F.sqrt(-2 * F.ln(draw(F.lit(1)))) * F.cos(2 * math.pi * draw(F.lit(2)))  # Poisson(n) of a large n
    many = F.greatest(F.lit(0), F.round(F.col("_n") + F.sqrt("_n") * normal)).cast("int")
    reps = reps.withColumn("w", F.when(F.col("_n") == 1, one(F.col("_u"))).when(F.col("_n") <= 32, few).otherwise(many)).filter("w > 0")
    values = reps.groupBy(*keys, "b").agg(statistic.alias("_m"))
    return values.groupBy(*keys).agg(F.percentile("_m", alpha / 2).alias("lo"), F.percentile("_m", 1 - alpha / 2).alias("hi"))


def bootstrap_ci(df: DataFrame, keys: Sequence[str], x: str, nsamples: int = 200, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean; see ``bootstrap_statistic``."""
    return bootstrap_statistic(df, keys, F.sum(F.col("w") * F.col("x")) / F.sum("w"), x, nsamples, alpha, seed)
