"""Bucketed scans, event containers, paths, grids and options against brute force: nulls, ties, repeats, empty tables, clashing names."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import paths as P
from pulsegrid.functions import stats as ST
from pulsegrid.operators import kernels as K
from pulsegrid.operators import segments as S
from pulsegrid.operators import series as SE
from pulsegrid.operators import signals as SG
from pulsegrid.plans.joins import asof_join
from pulsegrid.plans.ordered import near, scan


def test_scan(spark):
    rng = np.random.default_rng(0)
    rows = [(None if rng.random() < 0.1 else "hot" if rng.random() < 0.7 else "b", int(t), i, None if rng.random() < 0.3 else int(v)) for i, (t, v) in enumerate(zip(rng.integers(-50, 50, 600), rng.integers(0, 9, 600)))]
    df = spark.createDataFrame(rows, "k string, t int, id int, v int").withColumn("_bucket", F.lit("clash"))
    got = scan(df, ["k"], ["t", "id"], 7.0, r=("rank", None), s=("sum", "v"), m=("max_before", "v"), last=("last", "v"), nxt=("next", "v"), lag=("lag", "v"), lead=("lead", "v"), n=("count", None), top=("max", "v")).collect()
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        found = sorted((r for r in got if r.k == k), key=lambda r: (r.t, r.id))
        v = [r[3] for r in own]
        for i, f in enumerate(found):
            known = [x for x in v[: i + 1] if x is not None]
            assert (f.r, f.s, f.n) == (i, sum(known), len(own)) and f.last == (known[-1] if known else None)
            assert f.m == max((x for x in v[:i] if x is not None), default=None) and f.nxt == next((x for x in v[i:] if x is not None), None)
            assert f.lag == (v[i - 1] if i else None) and f.lead == (v[i + 1] if i + 1 < len(v) else None) and f.top == max(x for x in v if x is not None)
    assert scan(df.limit(0), ["k"], ["t"], 7.0, r=("rank", None)).count() == 0
    ends = spark.createDataFrame([("a", -math.inf, 1), ("a", 0.0, 2), ("a", math.inf, 3), ("a", None, 0)], "k string, t double, i int")
    assert [r.p for r in scan(ends, ["k"], ["t"], 5.0, p=("lag", "i")).orderBy("i").collect()] == [None, 0, 1, 2]


def test_near_and_asof(spark):
    df = spark.range(50).select(F.lit("a").alias("k"), F.col("id").alias("i"), (F.col("id") % 5).cast("double").alias("y"))
    got = [r.s for r in near(df, ["k"], "i", 2, 1, 10, s=lambda w: F.sum("y").over(w.rowsBetween(-2, 1))).orderBy("i").collect()]
    assert got == [sum(j % 5 for j in range(max(0, i - 2), min(50, i + 2))) for i in range(50)]
    left = spark.createDataFrame([(None, 5.0), ("a", 0.0), ("a", 7.0), ("a", 99.0), ("b", 1.0)], "k string, t double")
    right = spark.createDataFrame([("a", 7.0, 1), ("a", 3.0, 2), ("a", 7.0, 9), (None, 4.0, 8)], "k string, t double, v int")
    both = lambda d: {(r.k, r.t): (r.asof_t, r.asof_v) for r in asof_join(left, right, ["k"], ["v"], d, bucket=3.0).collect()}
    assert both("backward") == {(None, 5.0): (4.0, 8), ("a", 0.0): (None, None), ("a", 7.0): (7.0, 9), ("a", 99.0): (7.0, 9), ("b", 1.0): (None, None)}
    assert both("forward") == {(None, 5.0): (None, None), ("a", 0.0): (3.0, 2), ("a", 7.0): (7.0, 1), ("a", 99.0): (None, None), ("b", 1.0): (None, None)}


def test_repeated_segments(spark):
    segs = spark.createDataFrame([("a", 0.0, 10.0), ("a", 0.0, 10.0), ("a", 5.0, 20.0), (None, 0.0, 9.0), ("a", 30.0, 31.0)], "k string, start double, stop double")
    points = spark.createDataFrame([("a", 1.0, 1), ("a", 7.0, 2), (None, 3.0, 5)], "k string, t double, v int")
    got = sorted(((r.k, r.start, r.n, r.first, r.last) for r in S.count_in(points, segs, ["k"], 4.0).collect()), key=str)
    assert got == sorted([("a", 0.0, 2, 0, 1), ("a", 0.0, 2, 0, 1), ("a", 5.0, 1, 1, 1), (None, 0.0, 1, 0, 0), ("a", 30.0, 0, -1, -1)], key=str)
    sums = sorted((r.total for r in S.apply_aggregates(points, segs, ["k"], 4.0, total=F.sum("v")).collect()), key=str)
    assert sums == sorted([3, 3, 2, 5, None], key=str)
    merged = sorted(((r.k, r.start, r.stop) for r in S.merge(segs, ["k"], bucket=3.0).collect()), key=str)
    assert merged == sorted([("a", 0.0, 20.0), ("a", 30.0, 31.0), (None, 0.0, 9.0)], key=str)
    inverse = [(r.start, r.stop) for r in S.invert(segs.filter("k = 'a'"), ["k"]).orderBy("start").collect()]
    assert inverse == [(-math.inf, 0.0), (20.0, 30.0), (31.0, math.inf)]
    assert S.merge(segs.limit(0), ["k"]).count() == S.invert(segs.limit(0), ["k"]).count() == 0


def test_events(spark):
    a = SE.Events(spark.createDataFrame([("x", 1.0, 5), ("x", 2.0, 6), ("x", 2.0, 6)], "k string, t double, m int"), ["k"])
    assert (a == a).count() == 0 and [r.n for r in (a == SE.Events(a.df.distinct(), ["k"])).collect()] == [1]
    assert a.attributes() == ["m"] and (a + 2.0).concat(a - 1.0).count().first().n == 6 and a.del_attribute("m").attributes() == []
    assert a.between(1.0, 2.0).df.count() == 1 and a.is_sorted("m").first()["ascending"]
    with pytest.raises(ValueError):
        a - a
    with pytest.raises(ValueError):
        SE.Events(a.df, ["missing"])
    d = spark.createDataFrame([("x", i, None if i == 3 else float(i)) for i in range(6)], "k string, i int, y double")
    assert SE.is_sorted(d, ["k"], "i", "y").first()[1:] == (False, False, False, False)
    for method in ("shuffle", "roll"):
        moved = SE.randomize(d, ["k"], "i", ["y"], method, 3).orderBy("i").collect()
        assert [r.i for r in moved] == list(range(6)) and sorted((r.y for r in moved), key=str) == sorted([0.0, 1.0, 2.0, None, 4.0, 5.0], key=str)
    pulses = np.cumsum(np.random.default_rng(1).uniform(1, 9, 200))
    t = lambda x: spark.createDataFrame([(float(v),) for v in x], "t double")
    r = SE.synchronize(t(pulses), t((pulses[4:] - 3) / 1.001), 6).first()
    assert r.lag == 4 and abs(r.drift - 1.001) < 1e-9 and abs(r.intercept - 3) < 1e-6
    assert SE.synchronize(t(pulses[:0]), t(pulses[:0]), 6).count() == 0


def test_paths(spark):
    square = spark.createDataFrame([("p", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (2, 2), (0, 2)])] + [("one", 0, 1.0, 1.0)], "k string, i int, x double, y double")
    e = P.path_edges(square, ["k"])
    assert [(r.length, r.before) for r in e.orderBy("edge").collect()] == [(2, 0), (2, 2), (0, 4), (2, 4)]
    assert [round(r.tangent / math.pi, 6) for r in P.tangents(e).filter("length > 0").orderBy("edge").collect()] == [0, 0.5, 1]
    at = spark.createDataFrame([("p", 0.0), ("p", 3.0), ("p", 4.0), ("p", 99.0), ("q", 1.0)], "k string, s double")
    assert [(r.edge, r.x, r.y) for r in P.path_to_edge(at, e, ["k"], 2.0).orderBy("s").collect()] == [(0, 0, 0), (1, 2, 1), (3, 2, 2), (3, 0, 2)]
    on = P.random_on(e, ["k"], 50, 2.0).collect()
    assert len(on) == 50 and all(r.x in (0, 2) or r.y in (0, 2) for r in on) and P.path_edges(square.limit(0), ["k"]).count() == 0
    angle, scale, shift = P.decompose([[0, -3, 5], [2, 0, 6], [0, 0, 1]])
    assert (round(angle, 9), scale, shift) == (round(math.pi / 2, 9), (2.0, 3.0), (5.0, 6.0))


def test_grids_and_options(spark):
    g = spark.createDataFrame([("a", i, j, None if (i, j) == (2, 2) else float(i * j)) for i in range(5) for j in range(4)], "k string, i int, j int, y double")
    out = {(r.i, r.j): r.smooth for r in SG.smooth_axes(g, ["k"], ["i", "j"], ["uniform", "triangular"], [1.5, 2.0]).collect()}
    wi, wj = SG.kernel_weights("uniform", 1.5), SG.kernel_weights("triangular", 2.0)
    cells = [(wi[i - 1 + len(wi) // 2], wj[j - 1 + len(wj) // 2], i * j) for i in range(5) for j in range(4) if (i, j) != (2, 2) and abs(i - 1) <= len(wi) // 2 and abs(j - 1) <= len(wj) // 2]
    assert len(out) == 19 and abs(out[1, 1] - sum(a * b * v for a, b, v in cells) / sum(a * b for a, b, _ in cells)) < 1e-12
    assert abs(K.chi2_quantile(0.975, 10) - 20.483177) < 1e-5 and abs(K.t_quantile(0.975, 4) - 2.776445) < 1e-5 and abs(K.t_quantile(0.975, 5) - 2.570582) < 1e-5
    with pytest.raises(ValueError):
        K.MultitaperOptions(bandwidth=1e9).validate(64, 64.0)
    assert K.MultitaperOptions(bandwidth=1e9).validate(64, 64.0, correct=True).bandwidth == 31.5
    rows = [("a", float(i % 10)) for i in range(1000)]
    b = ST.bootstrap_ci(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", 200).first()
    assert 4.2 < b.lo < 4.45 and 4.55 < b.hi < 4.8  # repeated rows draw apart
    keys = [r[0] for r in spark.createDataFrame([("a10",), ("a9",), ("a" + "9" * 25,), ("a1" + "0" * 25,), ("a009",)], "t string").select("t", ST.natural_key(F.col("t")).alias("n")).orderBy("n", "t").collect()]
    assert keys == ["a009", "a9", "a10", "a" + "9" * 25, "a1" + "0" * 25]
    p = spark.createDataFrame([("a", 0.4)] * 2000, "k string, p double")
    assert 0 < ST.fisher(p, ["k"], "p").first().p < 1
