"""Operators along paths held as rows keys..., i (node number), x, y: edges, positions on the path, directions, gradients, maps.

A path position s is the length from the first node. Nodes are ordered by bucketed scans, positions are found by as-of joins, so
long paths spread. Single shapes given as literals are in ``functions.geometry``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.plans.joins import asof_join
from pulsegrid.plans.ordered import POSITIONS, scan

TAU = 2 * math.pi


def path_edges(nodes: DataFrame, keys: Sequence[str], bucket: float = POSITIONS) -> DataFrame:
    """Edges of open paths: keys, edge (number of the first node), x, y, dx, dy, length, before (path position of the first node)."""
    d = scan(nodes.select(*keys, "i", "x", "y"), keys, ["i"], bucket, _n=("lead", F.struct("x", "y"))).filter("_n is not null")
    d = d.select(*keys, F.col("i").alias("edge"), "x", "y", (F.col("_n.x") - F.col("x")).alias("dx"), (F.col("_n.y") - F.col("y")).alias("dy"))
    d = d.withColumn("length", F.hypot("dx", "dy"))
    return scan(d, keys, ["edge"], bucket, _upto=("sum", "length")).withColumn("before", F.col("_upto") - F.col("length")).drop("_upto")


def tangents(edges: DataFrame) -> DataFrame:
    """Add the direction of each edge and its normal (a quarter turn to the right), both in [0, 2 pi)."""
    turn = lambda a: a - F.floor(a / TAU) * TAU
    t = F.atan2("dy", "dx")
    return edges.withColumns({"tangent": turn(t), "normal": turn(t - math.pi / 2)})


def edge_to_path(points: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, edge, along) -> adds the path position s. Points on edges that aren't there are left out."""
    return points.join(edges.select(*keys, "edge", "before"), [*keys, "edge"]).withColumn("s", F.col("before") + F.col("along")).drop("before")


def path_to_edge(points: DataFrame, edges: DataFrame, keys: Sequence[str], bucket: float) -> DataFrame:
    """(keys, s) -> adds edge, along and the point x, y; a node belongs to the edge that it begins, positions past the end to the last edge."""
    at = asof_join(points, edges.filter("length > 0").withColumnRenamed("before", "s"), keys, ["edge", "x", "y", "dx", "dy", "length"], t="s", prefix="_e_", bucket=bucket).filter("_e_edge is not null")
    along = F.least(F.col("s") - F.col("_e_s"), F.col("_e_length"))
    share = along / F.col("_e_length")
    return at.select(*points.columns, F.col("_e_edge").alias("edge"), along.alias("along"), (F.col("_e_x") + share * F.col("_e_dx")).alias("x"), (F.col("_e_y") + share * F.col("_e_dy")).alias("y"))


def path_distance(a: Column, b: Column, length: Column | None = None) -> Column:
    """Signed distance from position a to b along a path; along a closed one of that ``length`` the shorter way."""
    d = b - a
    return d if length is None else d + length / 2 - F.floor((d + length / 2) / length) * length - length / 2


def gradient(df: DataFrame, keys: Sequence[str], order: str, value: str, dx: float = 1.0, bucket: float = POSITIONS) -> DataFrame:
    """Central differences of a value along the rows (one-sided at the ends), per dx: column ``gradient``."""
    d = scan(df, keys, [order], bucket, _p=("lag", value), _n=("lead", value))
    ends = F.when(F.col("_p").isNull(), (F.col("_n") - F.col(value)) / dx).when(F.col("_n").isNull(), (F.col(value) - F.col("_p")) / dx)
    return d.withColumn("gradient", F.coalesce(ends, (F.col("_n") - F.col("_p")) / (2 * dx))).drop("_p", "_n")


def bin_path(edges: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """Equal bins of each path whose size comes nearest to ``size``: keys, bin, start, stop."""
    total = edges.groupBy(*keys).agg(F.sum("length").alias("_l"))
    n = F.greatest(F.lit(1), F.round(F.col("_l") / size)).cast("int")
    d = total.withColumn("_n", n).withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return d.select(*keys, "bin", (F.col("_l") * F.col("bin") / F.col("_n")).alias("start"), (F.col("_l") * (F.col("bin") + 1) / F.col("_n")).alias("stop"))


def random_on(edges: DataFrame, keys: Sequence[str], n: int, bucket: float, seed: int = 0) -> DataFrame:
    """``n`` seeded points uniform on each path: keys, id, s, edge, along, x, y."""
    total = edges.groupBy(*keys).agg(F.sum("length").alias("_l"))
    u = (F.pmod(F.xxhash64(F.lit(seed), *keys, "id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    points = total.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(*keys, "id", (u * F.col("_l")).alias("s"))
    return path_to_edge(points, edges, keys, bucket)


def path_to_map(nearest: Column, x: tuple[float, float, int], y: tuple[float, float, int], df: DataFrame) -> DataFrame:
    """A grid of cell centres (lo, hi, n on either axis) with the nearest point of a literal path (``geometry.point_to_polyline`` of x and y): ix, iy, x, y, distance, s."""
    g = df.sparkSession.range(x[2] * y[2]).select((F.col("id") % x[2]).cast("int").alias("ix"), F.floor(F.col("id") / x[2]).cast("int").alias("iy"))
    g = g.withColumns({"x": x[0] + (F.col("ix") + 0.5) * (x[1] - x[0]) / x[2], "y": y[0] + (F.col("iy") + 0.5) * (y[1] - y[0]) / y[2]}).withColumn("_p", nearest)
    return g.select("ix", "iy", "x", "y", F.abs("_p.distance").alias("distance"), F.col("_p.along_path").alias("s"))


def is_circle(width: Column, height: Column) -> Column:
    return width == height


def radius(width: Column, height: Column) -> Column:
    """Of a circle; null for another ellipse."""
    return F.when(width == height, width / 2)


def decompose(matrix) -> tuple[float, tuple[float, float], tuple[float, float]]:
    """Rotation, scale and translation of a 3 x 3 affine matrix without shear (rotation after scale)."""
    (a, b, tx), (c, d, ty) = (tuple(float(v) for v in row) for row in list(matrix)[:2])
    sx = math.hypot(a, c)
    return math.atan2(c, a), (sx, (a * d - b * c) / sx), (tx, ty)
