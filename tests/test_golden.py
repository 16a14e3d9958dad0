"""Golden values of the interval, event, signal, angle and geometry operators on tiny inputs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import circular as C
from pulsegrid.functions import geometry as G
from pulsegrid.functions import stats as ST
from pulsegrid.operators import events as E
from pulsegrid.operators import kernels as K
from pulsegrid.operators import segments as S
from pulsegrid.operators import signals as SG
from pulsegrid.plans.joins import asof_join, band_join

INF = math.inf


def segs(spark, rows):
    return spark.createDataFrame([(float(a), float(b)) for a, b in rows], "start double, stop double")


def times(spark, values):
    return spark.createDataFrame([(float(t),) for t in values], "t double")


def pairs(df):
    return sorted((r.start, r.stop) for r in df.collect())


S1, S2, S3 = [(0, 10), (20, 30), (50, 100)], [(4, 6), (15, 25), (40, 200)], [(8, 20), (35, 60), (150, 180)]


def test_set_operations(spark):
    a, b, c = (segs(spark, s) for s in (S1, S2, S3))
    assert pairs(S.exclusive([a, b], [])) == [(0, 4), (6, 10), (25, 30)]
    assert pairs(S.union([a, b], [])) == [(0, 10), (15, 30), (40, 200)]
    assert pairs(S.intersection([a, b], [])) == [(4, 6), (20, 25), (50, 100)]
    assert pairs(S.difference([a, b], [])) == [(0, 4), (6, 10), (15, 20), (25, 30), (40, 50), (100, 200)]
    x = S.Segments(a) & ~S.Segments(b) & ~S.Segments(c)
    assert pairs(x.df) == pairs(S.exclusive([a, b, c], []))


def test_merge_and_invert(spark):
    assert pairs(S.invert(segs(spark, [(1, 2), (4, 5)]), [])) == [(-INF, 1), (2, 4), (5, INF)]
    assert pairs(S.merge(segs(spark, [(2, 4), (1, 5)]), [])) == [(1, 5)]
    assert pairs(S.merge(segs(spark, [(2, 4), (1, 2)]), [], strict=False)) == [(1, 2), (2, 4)]
    assert pairs(S.merge(segs(spark, [(2, 4), (1, 2)]), [])) == [(1, 4)]
    assert pairs(S.join_gaps(segs(spark, [(1, 2), (2.5, 3.5), (5, 6)]), [], 1.0)) == [(1, 3.5), (5, 6)]
    many = segs(spark, [(i * 3 % 97, i * 3 % 97 + 2) for i in range(60)])
    assert pairs(S.merge(many, [], bucket=10.0)) == pairs(S.merge(many, []))
    assert pairs(S.merge(segs(spark, []), [])) == []


def test_constructors(spark):
    y = spark.createDataFrame([(i, float(2 * i + 2), float(v)) for i, v in enumerate([10, 5, 12, 10, 3])], "i long, x double, y double")
    assert pairs(S.from_logical(y, [], "i", F.col("y") > 8)) == [(0, 0), (2, 3)]
    assert pairs(S.from_logical(y, [], "i", F.col("y") > 8, "x")) == [(2, 2), (6, 8)]
    assert pairs(S.from_logical(y, [], "i", F.col("y") < 8, "x", True)) == [(3, 5), (9, 10)]
    assert pairs(S.from_indices(spark.createDataFrame([(3,), (6,), (7,), (9,)], "i long"), [], "i")) == [(3, 3), (6, 7), (9, 9)]
    on, off = times(spark, [10, 15]), times(spark, [20, 30])
    assert pairs(S.from_onoff(on, off, [])) == [(15, 20)] and pairs(S.from_onoff(on, off, [], greedy_start=True)) == [(10, 20)] and pairs(S.from_onoff(on, off, [], greedy_stop=True)) == [(15, 30)]
    assert pairs(times(spark, [10]).select(*S.from_duration(F.col("t"), 20, 0))) == [(10, 30)]


def test_membership(spark):
    s = segs(spark, [(1, 2), (4, 5)])
    assert [r.t for r in S.contains(times(spark, [0, 4, 5]), s, [], 1.0).collect()] == [4]
    assert sorted((r.start, r.n, r.first, r.last) for r in S.count_in(times(spark, [0, 4]), s, [], 1.0).collect()) == [(1, 0, -1, -1), (4, 1, 1, 1)]
    p = times(spark, [3, 8]).withColumn("id", F.col("t"))
    assert {r.id: r.depth for r in S.depth(p, segs(spark, [(2, 4), (2, 6)]), [], "id").collect()} == {3: 2, 8: 0}
    o = S.overlap(segs(spark, [(2, 4), (2, 6)]), segs(spark, [(5, 8)]), [], 2.0).collect()
    assert [(r.overlap, r.rel_a, round(r.rel_b, 4)) for r in o] == [(1, 0.25, 0.3333)]


def test_split_scale(spark):
    assert pairs(S.split(segs(spark, [(1, 3)]), 1)) == [(1, 2), (2, 3)] and pairs(S.split(segs(spark, [(1, 3)]), 1, 0.25)) == [(1, 2), (1.75, 2.75)]
    assert pairs(S.scale(segs(spark, [(1, 2), (2, 3)]), 3)) == [(0, 3), (1, 4)] and pairs(S.scale(segs(spark, [(1, 2)]), 3, 0)) == [(1, 4)]
    part = S.partition(spark.range(7), [], ["id"], size=3, keep_remainder=False).collect()
    assert [r.part for r in sorted(part)] == [0, 0, 0, 1, 1, 1]


def test_events(spark):
    assert E.rate(times(spark, [1, 1.5, 2, 2.5]).withColumn("k", F.lit(1)), ["k"]).first().rate == 2.0
    ev = times(spark, [1, 1.5, 2, 2.5, 3, 4, 5, 6, 6.5, 7])
    assert {r.start: r.value for r in E.bin_events(ev, segs(spark, [(1, 3), (2, 7)]), [], 2.0).collect()} == {1: 4, 2: 7}
    assert {r.start: r.value for r in E.bin_events(ev, segs(spark, [(0, 1), (2, 7)]), [], 2.0, "binary").collect()} == {0: 0, 2: 1}
    with pytest.raises(NotImplementedError):
        E.bin_events(ev, segs(spark, []), [], 1.0, "other")
    b = E.bursts(times(spark, [2, 2.5, 3, 4, 5, 6, 6.5, 7]), [], 0.9, 1.1)
    assert [r.burst for r in b.orderBy("t").collect()] == [0, 0, 1, 2, 2, 3, 0, 0]
    full = E.bursts(times(spark, [1, 2, 2.5, 3, 4, 5, 6, 6.5, 7]), [], 0.9, 1.1)
    want = {"reduce": [1, 2.5, 3, 6.5, 7], "remove": [2.5, 6.5, 7], "isolate": [1, 2, 3, 4, 5, 6], "isolatereduce": [1, 3]}
    assert {m: sorted(r.t for r in E.filter_bursts(full, m).collect()) for m in want} == want
    codes = spark.createDataFrame(list(enumerate([1, 2, 3, 0, 1, 2, 2, 2, 3])), "t int, burst int")
    assert [r.burst for r in E.burst_length(codes, [], (3, 4)).orderBy("t").collect()] == [1, 2, 3, 0, 0, 0, 0, 0, 0]
    assert [r.burst for r in E.burst_length(codes, []).orderBy("t").collect()] == [0] * 9
    assert [r.t for r in E.filter_intervals(times(spark, [1, 2, 2.5, 3, 4, 5, 6, 6.5, 7]), [], 1.0).orderBy("t").collect()] == [1, 2, 4, 5, 6]


def test_intervals(spark):
    got = E.intervals(times(spark, [1, 3, 9]), []).orderBy("t").collect()
    assert [(r.pre, r.post, r.smallest, r.largest) for r in got] == [(None, 2, None, None), (-2, 6, -2, 6), (-6, None, None, None)]
    assert [r.post for r in E.cross_intervals(times(spark, [1, 2, 3]), times(spark, [2, 3]), []).orderBy("t").collect()] == [1, 0, 0]
    probes = times(spark, [2, 4]).withColumn("id", F.col("t"))
    assert {r.id: r.n for r in E.count_until(times(spark, [1, 2, 3, 4]), probes, [], "id").collect()} == {2: 2, 4: 4}
    assert asof_join(times(spark, [5, 1]), times(spark, [2, 5]).withColumn("v", F.lit(1)), [], ["v"]).orderBy("t").collect()[0].asof_t is None
    assert band_join(times(spark, [1, 2]), times(spark, [2, 3]), [], -1, 1).count() == 3
    a = times(spark, [1, 5, 9]).withColumn("k", F.lit(1))
    assert E.tiling_coefficient(a, a, segs(spark, [(0, 20)]).withColumn("k", F.lit(1)), ["k"], 0.5).first().sttc == 1.0


def test_artefacts(spark):
    t = [0, 1, 2, 3, 4, 4.5, 5, 6, 7, 8]
    y = spark.createDataFrame([(i, float(a), float(i)) for i, a in enumerate(t)], "i long, t double, y double")
    fill = SG.blank_artefacts(y, times(spark, [2, 3]), [], 1, 1, 0.0).orderBy("i").collect()
    assert [r.y for r in fill] == [0, 0, 0, 0, 4, 5, 6, 7, 8, 9]
    bent = spark.createDataFrame([(i, float(a), float(v)) for i, (a, v) in enumerate(zip(t, [0, 1, 1.2, 1.3, 4, 5, 6, 7, 8, 9]))], "i long, t double, y double")
    line = SG.blank_artefacts(bent, times(spark, [2, 3]), [], 1, 1, linear=True).orderBy("i").collect()
    assert np.allclose([r.y for r in line][:5], [0, 1, 2, 3, 4])


def test_signals(spark):
    y = [0, 1, 2, 2, 1, 0, -1, 0, 0, 3]
    d = spark.createDataFrame([(i, float(i), float(v)) for i, v in enumerate(y)], "i long, t double, y double")
    assert sorted((r.position, r.kind) for r in SG.extrema(d, []).collect()) == [(2.5, "max"), (6, "min")]
    assert sorted((r.position, r.direction) for r in SG.zero_crossings(d, []).collect()) == [(5.0, "falling"), (7.5, "rising")]
    avg = SG.triggered_average(spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (2.0, 1.0), (3.0, 0.0)], "t double, y double"), times(spark, [1]), [], -1.0, 1.0, 1.0)
    assert [r["mean"] for r in avg.orderBy("lag").collect()] == [0, 1]
    gap = d.withColumn("y", F.when(F.col("i") != 4, 2.0))
    assert [r.smooth for r in SG.smooth(gap, [], "gaussian", 1.0).orderBy("i").collect()] == [2.0] * 4 + [None] + [2.0] * 5


def test_circular(spark):
    rng = np.random.default_rng(0)
    th = rng.vonmises(1.0, 2.0, 151) % (2 * math.pi)
    d = spark.createDataFrame([(1, float(t)) for t in th], "k int, theta double")
    cost = [np.abs((th - a + math.pi) % (2 * math.pi) - math.pi).mean() for a in th]
    assert math.isclose(C.median(d, ["k"]).first()["median"], th[int(np.argmin(cost))], abs_tol=1e-9)
    m = C.moments(d, ["k"]).first()
    assert math.isclose(m.r, abs(np.exp(1j * th).mean()), rel_tol=1e-9) and math.isclose(C.vonmises_kappa(m.r), 2.0, rel_tol=0.4)
    assert C.moments(d.withColumn("theta", F.lit(None).cast("double")), ["k"]).first().n == 0


def test_geometry(spark):
    p = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0), (0.0, 0.9), (0.75, 0.75)], "x double, y double")
    e, r = G.Box("ellipse", (0, 0), (1, 2)), G.Box("rectangle", (0, 0), (1, 2))
    assert [x.c for x in p.select(e.contains(F.col("x"), F.col("y")).alias("c")).collect()][:2] == [True, False]
    assert [x.c for x in p.select(r.contains(F.col("x"), F.col("y")).alias("c")).collect()][2:] == [True, False]
    assert round(G.Box("ellipse", size=(10, 20)).eccentricity(), 1) == 0.9 and G.Box("ellipse", size=(2, 2)).eccentricity() == 0
    assert round(G.Box("ellipse", size=(1, 2), orientation=math.pi / 4).bounding_box()[0], 2) == 1.58 and round(G.Box("rectangle", size=(1, 2), orientation=math.pi / 4).bounding_box()[0], 2) == 2.12
    assert G.path_between([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0)], 1, 3) == (2.0, [1, 2, 3]) and G.path_between([(1, 2, 1.0)], 1, 9) is None
    links = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0)], "a int, b int, length double")
    assert {x.node: x.distance for x in G.shortest_paths(links, spark.createDataFrame([(1,)], "node int")).collect()} == {1: 0.0, 2: 1.0, 3: 2.0}
    ring = G.sample_path(G.ngon(12), 10, closed=True)
    assert np.allclose(np.hypot(*ring.T), 1, atol=2e-3)
    t = G.Transform().scale(2).rotate(0.3, (1, 1)).translate((3, 4))
    assert np.allclose(t.inverse().points(t.points(ring)), ring)


def test_kernels(spark):
    fs = 100.0
    x = np.sin(2 * math.pi * 5 * np.arange(3000) / fs) + np.sin(2 * math.pi * 30 * np.arange(3000) / fs)
    taps = K.fir((3.0, 8.0), fs)
    d = spark.createDataFrame(pd.DataFrame({"k": 1, "i": np.arange(3000), "y": x}))
    whole = K.zero_phase(x, taps)
    parts = K.filter_signal(d, ["k"], taps, 256).orderBy("i").toPandas().filtered.to_numpy()
    inner = slice(len(taps), -len(taps))
    assert np.allclose(parts[inner], whole[inner]) and np.abs(whole[inner] - np.sin(2 * math.pi * 5 * np.arange(3000) / fs)[inner]).max() < 0.05
    w = K.tapers(128, 3.0, 5)
    assert np.allclose(w @ w.T, np.eye(5), atol=1e-10)
    assert np.allclose(K.analytic_envelope(np.cos(2 * math.pi * 8 * np.arange(256) / 256)), 1, atol=1e-6)
    spec = K.spectrum(K.arrays(d, ["k"]), ["k"], "samples", fs).toPandas()
    assert any(abs(spec.freq[spec.power.idxmax()] - f) < 0.3 for f in (5, 30)) and K.factors(48) == [12, 4]
    with pytest.raises(RuntimeError):
        K.factors(26)
    image = np.zeros((21, 21))
    image[np.arange(21), np.arange(21)] = 1
    fit = K.fit_line(spark.createDataFrame([(1, image.tolist())], "k int, image array<array<double>>"), ["k"]).first()
    assert abs(fit.slope - 1) < 0.1 and K.bresenham(0, 0, 4, 2) == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 2)]


def test_stats(spark):
    d = spark.createDataFrame([(1, i % 5) for i in range(100)], "k int, x int").withColumn("id", F.monotonically_increasing_id())
    ci = ST.bootstrap_ci(d, ["k"], "x", 200).first()
    assert ci.lo < 2.0 < ci.hi and ci.hi - ci.lo < 0.8
    p = spark.createDataFrame([(0.0005,), (0.02,), (0.5,), (None,)], "p double").select(ST.stars(F.col("p")).alias("s"), ST.relative(F.col("p")).alias("r")).collect()
    assert [x.s for x in p] == ["***", "*", "n.s.", None] and [x.r for x in p] == ["p<0.001", "p<0.05", "p≥0.05", None]
    names = spark.createDataFrame([("a10",), ("a9",), ("b1",)], "s string").orderBy(ST.natural_key(F.col("s"))).collect()
    assert [r.s for r in names] == ["a9", "a10", "b1"]
