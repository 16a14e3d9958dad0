"""Plane geometry as column expressions; shapes are small driver-side values that become literals."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.plans.ordered import POSITIONS, scan


def cart2pol(x: Column, y: Column) -> tuple[Column, Column]:
    return F.atan2(y, x).alias("theta"), F.hypot(x, y).alias("rho")


def pol2cart(theta: Column, rho: Column) -> tuple[Column, Column]:
    return (rho * F.cos(theta)).alias("x"), (rho * F.sin(theta)).alias("y")


@dataclass
class Transform:
    """A stack of scalings, rotations and translations: one matrix, one projection."""

    matrix: np.ndarray = field(default_factory=lambda: np.eye(3))

    def _then(self, m: np.ndarray) -> Transform:
        return Transform(m @ self.matrix)

    def _about(self, m: np.ndarray, origin: Sequence[float]) -> Transform:
        there, back = np.eye(3), np.eye(3)
        there[:2, 2], back[:2, 2] = np.negative(origin), origin
        return self._then(back @ m @ there)

    def scale(self, factor: float | Sequence[float] = 1.0, origin: Sequence[float] = (0, 0)) -> Transform:
        sx, sy = np.broadcast_to(factor, 2)
        return self._about(np.diag([sx, sy, 1.0]), origin)

    def rotate(self, angle: float = 0.0, origin: Sequence[float] = (0, 0)) -> Transform:
        c, s = math.cos(angle), math.sin(angle)
        return self._about(np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]]), origin)

    def translate(self, offset: Sequence[float]) -> Transform:
        m = np.eye(3)
        m[:2, 2] = offset
        return self._then(m)

    def inverse(self) -> Transform:
        return Transform(np.linalg.inv(self.matrix))

    def apply(self, x: Column, y: Column) -> tuple[Column, Column]:
        m = self.matrix.tolist()
        return (m[0][0] * x + m[0][1] * y + m[0][2]).alias("x"), (m[1][0] * x + m[1][1] * y + m[1][2]).alias("y")

    def points(self, xy: np.ndarray) -> np.ndarray:
        return xy @ self.matrix[:2, :2].T + self.matrix[:2, 2]


def edges(nodes: Sequence[Sequence[float]], closed: bool = True) -> list[tuple[float, float, float, float]]:
    p = [(float(x), float(y)) for x, y in nodes]
    ring = p + p[:1] if closed and p[0] != p[-1] else p
    return [(*a, *b) for a, b in zip(ring[:-1], ring[1:])]


def in_polygon(x: Column, y: Column, nodes: Sequence[Sequence[float]]) -> Column:
    """Winding number of a closed polygon around the point is not zero (half-open in y, so a shared border counts once)."""
    winding = F.lit(0)
    for x0, y0, x1, y1 in edges(nodes):
        side = (x1 - x0) * (y - y0) - (x - x0) * (y1 - y0)
        winding = winding + F.when((y >= y0) & (y < y1) & (side > 0), 1).when((y < y0) & (y >= y1) & (side < 0), -1).otherwise(0)
    return winding != 0


def polygon_area(df: DataFrame, keys: Sequence[str], order: str, x: str = "x", y: str = "y", bucket: float = POSITIONS) -> DataFrame:
    """Signed area of the polygon whose vertices are the rows in their order (the last joins the first); 0 for fewer than three."""
    point = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    d = scan(df, keys, [order], bucket, _n=("lead", point))
    ends = F.struct(F.min_by(point, order).alias("a"), F.max_by(point, order).alias("z"))
    cross = F.sum(F.col(x) * F.col("_n.y") - F.col("_n.x") * F.col(y))
    d = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), cross.alias("_s"), ends.alias("_e"))
    close = F.col("_e.z.x") * F.col("_e.a.y") - F.col("_e.a.x") * F.col("_e.z.y")
    return d.select(*keys, F.when(F.col("_c") < 3, 0.0).otherwise((F.col("_s") + close) / 2).alias("area"))


def path_length(df: DataFrame, keys: Sequence[str], order: str, x: str = "x", y: str = "y", bucket: float = POSITIONS) -> DataFrame:
    """Length of the open path through the rows in their order."""
    d = scan(df, keys, [order], bucket, _n=("lead", F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    return d.withColumn("_d", F.hypot(F.col("_n.x") - F.col(x), F.col("_n.y") - F.col(y))).groupBy(*keys).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length"))


def point_to_polyline(x: Column, y: Column, nodes: Sequence[Sequence[float]], closed: bool = False) -> Column:
    """struct(distance, edge, px, py, along_edge, along_path) of the nearest point on a path given as a literal; distance is signed (left of the path > 0)."""
    before, options = 0.0, []
    for i, (x0, y0, x1, y1) in enumerate(edges(nodes, closed)):
        vx, vy = x1 - x0, y1 - y0
        length = math.hypot(vx, vy)
        b = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * vx + (y - y0) * vy) / (length * length)))
        px, py = x0 + b * vx, y0 + b * vy
        d = F.hypot(x - px, y - py)
        sign = F.signum(vx * (y - y0) - vy * (x - x0))
        options.append(F.struct(d.alias("d"), F.lit(i).alias("edge"), (d * sign).alias("distance"), px.alias("px"), py.alias("py"), (b * length).alias("along_edge"), (b * length + before).alias("along_path")))
        before += length
    return F.array_min(F.array(*options))


def polyline_at(s: Column, nodes: Sequence[Sequence[float]], closed: bool = False) -> tuple[Column, Column]:
    """The point at a position along a path (clipped to its ends)."""
    ends, e = [0.0], edges(nodes, closed)
    for x0, y0, x1, y1 in e:
        ends.append(ends[-1] + math.hypot(x1 - x0, y1 - y0))
    px, py = F.lit(e[0][0]), F.lit(e[0][1])
    for k, (x0, y0, x1, y1) in enumerate(e):
        f = F.least(F.lit(1.0), (s - ends[k]) / (ends[k + 1] - ends[k]))
        px, py = F.when(s > ends[k], x0 + f * (x1 - x0)).otherwise(px), F.when(s > ends[k], y0 + f * (y1 - y0)).otherwise(py)
    return px.alias("x"), py.alias("y")


@dataclass
class Box:
    """Ellipse or rectangle by centre, size and orientation."""

    kind: str
    center: tuple[float, float] = (0.0, 0.0)
    size: tuple[float, float] = (1.0, 1.0)
    orientation: float = 0.0

    def _local(self, x: Column, y: Column) -> tuple[Column, Column]:
        return Transform().translate((-self.center[0], -self.center[1])).rotate(-self.orientation).apply(x, y)

    def contains(self, x: Column, y: Column) -> Column:
        u, v = self._local(x, y)
        if self.kind == "ellipse":
            return F.pow(u / (self.size[0] / 2), 2) + F.pow(v / (self.size[1] / 2), 2) <= 1
        return (F.abs(u) <= self.size[0] / 2) & (F.abs(v) <= self.size[1] / 2)

    def area(self) -> float:
        return self.size[0] * self.size[1] * (math.pi / 4 if self.kind == "ellipse" else 1.0)

    def eccentricity(self) -> float:
        a, b = max(self.size), min(self.size)
        return math.sqrt(1 - (b / a) ** 2)

    def bounding_box(self) -> tuple[float, float]:
        c, s, (w, h) = abs(math.cos(self.orientation)), abs(math.sin(self.orientation)), self.size
        return (math.hypot(w * c, h * s), math.hypot(w * s, h * c)) if self.kind == "ellipse" else (w * c + h * s, w * s + h * c)

    def perimeter(self, n: int = 20001) -> float:
        if self.kind != "ellipse":
            return 2 * sum(self.size)
        t = np.linspace(0, 2 * math.pi, n)
        return float(np.hypot(np.diff(self.size[0] / 2 * np.cos(t)), np.diff(self.size[1] / 2 * np.sin(t))).sum())

    def polygon(self, n: int = 100) -> np.ndarray:
        if self.kind == "ellipse":
            t = np.arange(n) * 2 * math.pi / n
            local = np.c_[self.size[0] / 2 * np.cos(t), self.size[1] / 2 * np.sin(t)]
        else:
            local = np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]]) * np.array(self.size) / 2
        return Transform().rotate(self.orientation).translate(self.center).points(local)


def ngon(n: int, size: float = 1.0) -> np.ndarray:
    t = np.arange(n) * 2 * math.pi / n
    return size * np.c_[np.cos(t), np.sin(t)]


def sample_path(nodes: Sequence[Sequence[float]], oversampling: int = 20, closed: bool = False) -> np.ndarray:
    """Points of an interpolating cubic spline through the nodes (natural ends, periodic if closed), by chord length."""
    p = np.asarray(nodes, float)
    if closed:
        p = np.vstack([p, p[:1]])
    t = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
    h, n = np.diff(t), len(t)
    A, r = np.eye(n), np.zeros((n, 2))
    for i in range(1, n - 1):
        A[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * ((p[i + 1] - p[i]) / h[i] - (p[i] - p[i - 1]) / h[i - 1])
    if closed:
        A[0], A[-1] = 0, 0
        A[0, [0, -1]] = 1, -1
        A[-1, [0, 1, -2, -1]] = 2 * h[0], h[0], h[-1], 2 * h[-1]
        r[-1] = 6 * ((p[1] - p[0]) / h[0] - (p[-1] - p[-2]) / h[-1])
    m = np.linalg.solve(A, r)
    s = np.linspace(0, t[-1], (n - 1) * oversampling + 1)
    k = np.clip(np.searchsorted(t, s, side="right") - 1, 0, n - 2)
    a, b, hk = (t[k + 1] - s)[:, None], (s - t[k])[:, None], h[k][:, None]
    return m[k] * a**3 / (6 * hk) + m[k + 1] * b**3 / (6 * hk) + (p[k] / hk - m[k] * hk / 6) * a + (p[k + 1] / hk - m[k + 1] * hk / 6) * b


def shortest_paths(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Distance and previous node from each source to every node it reaches: src, node, distance, previous.

    ``links`` (a, b, length; both directions; without length no link), ``sources`` (node). Each round relaxes the links of the
    nodes that came nearer and keeps the best per (source, node); lineage is cut by a checkpoint, and it ends when nothing gets
    shorter, which is certain as lengths must not be negative.
    """
    from pulsegrid.session import frozen

    links = links.filter("length is not null")
    if not links.filter("length < 0").isEmpty():
        raise ValueError("negative length")
    both = links.select("a", "b", "length").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "length"))
    best = frozen(sources.select(F.col("node").alias("src"), "node", F.lit(0.0).alias("distance"), F.lit(None).cast(sources.schema["node"].dataType).alias("previous"), F.lit(True).alias("_nearer")).distinct())
    while not best.filter("_nearer").isEmpty():
        step = best.filter("_nearer").join(both, best.node == both.a).select("src", F.col("b").alias("node"), (F.col("distance") + F.col("length")).alias("distance"), F.col("a").alias("previous"))
        both_rounds = best.select("src", "node", "distance", "previous", F.col("distance").alias("_old")).unionByName(step, allowMissingColumns=True)
        found = both_rounds.groupBy("src", "node").agg(F.min(F.struct("distance", "previous")).alias("_m"), F.min("_old").alias("_old"))
        best = frozen(found.select("src", "node", "_m.distance", "_m.previous", (F.col("_old").isNull() | (F.col("_m.distance") < F.col("_old"))).alias("_nearer")))
    return best.drop("_nearer")


def path_between(links: Sequence[tuple], a, b) -> tuple[float, list] | None:
    """Shortest path on a small literal graph."""
    near: dict = {}
    for x, y, d in links:
        near.setdefault(x, []).append((y, d))
        near.setdefault(y, []).append((x, d))
    queue, seen = [(0.0, a, [a])], set()
    while queue:
        d, x, path = heapq.heappop(queue)
        if x == b:
            return d, path
        if x not in seen:
            seen.add(x)
            for y, e in near.get(x, []):
                heapq.heappush(queue, (d + e, y, [*path, y]))
    return None
