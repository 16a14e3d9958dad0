"""Queries and operators over all of their input, against brute force."""

import datetime as dt
import math
import re

import pandas as pd
import pytest

import __spark_entry__ as entry
from pulsegrid.operators import signals as SG


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with an events table whose user ids go far beyond 40."""
    d = str(tmp_path_factory.mktemp("data"))
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "ab"[i % 7 == 0], i % 500, float(i * 37 % 101), t0 + dt.timedelta(seconds=i * 7919 % 2_592_000)) for i in range(8000)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double, ts timestamp_ntz").write.parquet(f"{d}/events.parquet")
    return d, pd.DataFrame(rows, columns=["event_id", "k", "user_id", "v", "ts"])


def test_p_values_of_all_users(spark, folder):
    d, e = folder
    e = e.assign(g=e.user_id % 20, p=(e.v // 1 % 97 + 1) / 98)
    got = {(r.k, r.g): r for r in entry.queries()["stat_combine_p"](spark, d).collect()}
    fisher = {(r.k, r.g): r.p for r in entry.queries()["stat_fisher"](spark, d).collect()}
    assert set(got) == set(fisher) == {*zip(e.k, e.g)}
    for key, p in e.groupby(["k", "g"]).p:
        n, x = len(p), -sum(map(math.log, p))
        assert math.isclose(got[key].friston, max(p) ** n, abs_tol=1e-9) and math.isclose(got[key].tippett, 1 - (1 - min(p)) ** n, abs_tol=1e-9) and got[key].nichols == round(max(p), 9)
        assert math.isclose(fisher[key], sum(math.exp(j * math.log(x) - x - math.lgamma(j + 1)) for j in range(n)), abs_tol=1e-6)
    assert {r.p for r in entry.queries()["stat_format_p"](spark, d).collect()} == {round(p, 6) for p in e.p}


def test_fisher_of_many_values(spark):
    """1200 values of e^-1: exp(-1200) is 0 as a double."""
    from pulsegrid.functions import stats as ST

    df = spark.range(1200).selectExpr("1 AS k", "exp(-1.0D) AS p")
    want = sum(math.exp(j * math.log(1200) - 1200 - math.lgamma(j + 1)) for j in range(1200))
    assert math.isclose(ST.fisher(df, ["k"], "p").first().p, want, rel_tol=1e-6)


def test_windows_at_the_mixture(spark, monkeypatch):
    """Token shares of the sources in every window, against those of all items, in one group of windows and in several."""
    import numpy as np

    from pulsegrid.llm import packing

    rng = np.random.default_rng(5)
    rows = [(i, str(q), int(n)) for i, (q, n) in enumerate(zip(rng.choice(4, 6000, p=[0.5, 0.25, 0.13, 0.12]), rng.integers(1, 300, 6000)))]
    sizes = pd.DataFrame(rows, columns=["doc_id", "source", "size"])
    target = sizes.groupby("source")["size"].sum() / sizes["size"].sum()
    for group, worst in ((1 << 17, 0.01), (1000, 0.06)):  # a group of 1000 items is a random sample
        monkeypatch.setattr(packing, "GROUP", group, raising=False)
        out = packing.pack(spark.createDataFrame(sizes), spark.createDataFrame([("p", 512)], "pack_name string, capacity_tokens int"), 32).toPandas()
        assert not out.groupby("container").window_no.nunique().gt(1).any() and out.groupby("doc_id").n_tokens.sum().tolist() == sizes["size"].tolist()
        shares = out.merge(sizes, on="doc_id").pivot_table(index="window_no", columns="source", values="n_tokens", aggfunc="sum", fill_value=0)
        assert (shares.div(shares.sum(axis=1), axis=0) - target).abs().values.max() < worst and 30 <= out.groupby("window_no").container.nunique().mean() <= 34


def test_segments_of_all_events(spark, folder):
    d, e = folder
    t = e.assign(t=(e.ts - pd.Timestamp("2024-01-01")).dt.total_seconds())
    merged, gaps = set(), set()
    for k, own in t.sort_values("t").groupby("k"):
        new = own.t.diff().gt(1200).cumsum()
        ends = own.groupby(new).t.agg(["min", "max"]).to_numpy()
        merged |= {(k, a - 600, z + 600) for a, z in ends}
        gaps |= {(k, a[1] + 600, z[0] - 600) for a, z in zip(ends, ends[1:])}
        gaps |= {(k, -math.inf, ends[0][0] - 600), (k, ends[-1][1] + 600, math.inf)}  # the complement reaches to infinity
    run = lambda name: {tuple(r)[:3] for r in entry.queries()[name](spark, d).collect()}
    assert run("seg_merge") == run("seg_intervals") == merged and run("seg_invert") == gaps
    assert run("seg_span") == {(k, own.t.min() - 600, own.t.max() + 600) for k, own in t.groupby("k")}
    assert run("seg_offset") == {(k, x - 587.5, x + 612.5) for k, x in zip(t.k, t.t)} and run("seg_scale") == {(k, x - 1800, x + 1800) for k, x in zip(t.k, t.t)}


def test_shortest_paths_of_many_links(spark):
    """A chain of 54 links, and a direct link to its end that is longer than the chain."""
    from pulsegrid.functions import geometry as G

    links = spark.createDataFrame([(i, i + 1, 1.0) for i in range(54)] + [(0, 54, 60.0), (3, 5, None)], "a long, b long, length double").coalesce(1)
    got = {r.node: (r.distance, r.previous) for r in G.shortest_paths(links, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {i: (float(i), i - 1 if i else None) for i in range(55)}
    with pytest.raises(ValueError):
        G.shortest_paths(spark.createDataFrame([(0, 1, -1.0)], "a long, b long, length double"), spark.createDataFrame([(0,)], "node long"))


def test_all_points_and_angles(spark, folder, tmp_path):
    """Discounts of 0.05 and angles from 5 rad on count too."""
    from pulsegrid.queries_reference import PATH, TAU

    rows = [(i, 1, "N", float(1 + i % 50), round(i // 50 % 11 * 0.01, 2), 1.0) for i in range(550)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double, l_discount double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: (r.distance, r.along_path) for r in entry.queries()["geo_point_to_polyline"](spark, str(tmp_path)).collect()}
    assert len(got) == 550
    for i, _, _, x, y, _ in rows:
        before, options = 0.0, []
        for edge, ((x0, y0), (x1, y1)) in enumerate(zip(PATH, PATH[1:])):
            n = math.hypot(x1 - x0, y1 - y0)
            b = min(1.0, max(0.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / n**2))
            options.append((math.hypot(x - x0 - b * (x1 - x0), y - y0 - b * (y1 - y0)), edge, b * n + before))
            before += n
        assert math.isclose(got[i][0], min(options)[0], abs_tol=2e-5) and math.isclose(got[i][1], min(options)[2], abs_tol=2e-5)
    d, e = folder
    theta = (e.ts - e.ts.dt.normalize()).dt.total_seconds() * TAU / 86400
    for r in entry.queries()["circ_interval"](spark, d).collect():
        own = sorted(theta[e.k == r.k])
        assert math.isclose(r.interval, TAU - max(z - a for a, z in zip(own, [*own[1:], own[0] + TAU])), abs_tol=2e-6)


def test_density_over_all_days(spark, folder):
    """Every event adds to the grid: the density sums up to 1, but for the tails beyond its ends."""
    total: dict = {}
    for r in entry.queries()["ev_density"](spark, folder[0]).collect():
        total[r.k] = total.get(r.k, 0) + r.density * 8640
    assert set(total) == {"a", "b"} and all(0.99 < x < 1.01 for x in total.values())


def frames_read_anew(df):
    """Window frames that end at the last row and start at none: Spark reads their rows once per row."""
    return set(re.findall(r"RowFrame, (?!unboundedpreceding)[^,]+, unboundedfollowing", df._jdf.queryExecution().executedPlan().toString()))


def plateaus(y):
    """First sample, last sample and value of each run of equal values."""
    cuts = [0, *[i for i in range(1, len(y)) if y[i] != y[i - 1]], len(y)]
    return [(a, z - 1, y[a]) for a, z in zip(cuts, cuts[1:])]


def test_extrema_of_a_long_signal(spark, tmp_path):
    """All samples of the key lie in one bucket; many extrema are plateaus."""
    y = [float(i * i % 7919 * 37 % 211 // 4) * 4 for i in range(30_000)]
    rows = pd.DataFrame({"event_id": range(len(y)), "event_type": "a", "user_id": 1, "value": y, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(range(len(y)), unit="min")})
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    found = entry.queries()["sig_extrema_range"](spark, str(tmp_path))
    assert not {f for f in frames_read_anew(found) if "currentrow" in f}
    runs = plateaus(y)
    want = [("a", (a + z) / 2, v, "max") for (_, _, p), (a, z, v), (_, _, n) in zip(runs, runs[1:], runs[2:]) if v > p and v > n and 60 <= v <= 200]
    assert len(want) > 1000 and any(p % 1 for _, p, _, _ in want) and sorted(map(tuple, found.collect())) == want


def test_extrema_over_many_buckets(spark):
    """20,000 buckets of one key, and plateaus that go over several of them: the carry from later buckets is one pass too."""
    y = [float(i // (1 + i // 20_000 * 6) * 37 % 101 // 2) for i in range(40_000)]
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "i": range(len(y)), "y": y}))
    found = SG.extrema(d, ["k"], bucket=2.0)
    assert not frames_read_anew(found)
    runs = plateaus(y)
    want = [("a", (a + z) / 2, v, "max" if v > p else "min") for (_, _, p), (a, z, v), (_, _, n) in zip(runs, runs[1:], runs[2:]) if (v > p) == (v > n)]
    assert len(want) > 10_000 and any(z - a > 4 for a, z, _ in runs) and sorted(map(tuple, found.collect())) == want
