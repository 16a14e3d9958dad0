"""Queries of event containers, paths, clocks, grids and shuffles over the star-schema tables, with DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pulsegrid.functions import circular as C
from pulsegrid.functions import geometry as G
from pulsegrid.functions import paths as P
from pulsegrid.functions import stats as ST
from pulsegrid.operators import kernels as K
from pulsegrid.operators import segments as S
from pulsegrid.operators import series as SE
from pulsegrid.operators import signals as SG
from pulsegrid.plans.ordered import bucketed_rank
from pulsegrid.queries_reference import EVERY, KEY, PATH, PV, QUERIES, SIDES, TAU, A, Bq, M, R, X, ang, emb, ev, every, line, pv, query, sig
from pulsegrid.session import table
from pulsegrid.sources import binary as B

# Event container


def train(s, d, rest):
    return SE.Events((X if rest == 0 else R)(s, d).select("k", "event_id", "t", "v"), KEY, ("t", "event_id"))


query("evset_shift_concat", lambda s, d: (train(s, d, 0) + 100.0).concat(train(s, d, 1) - 50.0).set_attribute("late", F.col("t") > 86400.0).df, "SELECT k, event_id, t, v, t > 86400 AS late FROM (SELECT k, event_id, t + 100 AS t, v FROM x UNION ALL SELECT k, event_id, t - 50, v FROM r)", "t")
query("evset_equal", lambda s, d: train(s, d, 0) == SE.Events(ev(s, d).select("k", "event_id", "t", "v"), KEY), "SELECT k, t, CAST(-count(*) AS BIGINT) AS n FROM r GROUP BY ALL", "t")
query("evset_between", lambda s, d: train(s, d, 0).between(86400.0, 864000.0).count(), "SELECT k, count(*) AS n FROM x WHERE t >= 86400 AND t < 864000 GROUP BY k")
query("evset_filter_bursts", lambda s, d: train(s, d, 0).filter_bursts("reduce", lo=60.0, hi=900.0).df.select("event_id"), """SELECT event_id FROM (SELECT event_id, coalesce(p BETWEEN 60 AND 900, false) AS i FROM (SELECT event_id, t - lag(t) OVER (PARTITION BY k ORDER BY t, event_id) AS p FROM x)) WHERE NOT i""")
query("evset_intervals_in_segments", lambda s, d: train(s, d, 0).intervals(A(s, d), 1500.0).select("event_id", "pre", "post"), f"SELECT event_id, lag(t) OVER w - t AS pre, lead(t) OVER w - t AS post FROM (SELECT x.*, m.start FROM x JOIN {M('a')} m ON m.k = x.k AND x.t >= m.start AND x.t < m.stop) WINDOW w AS (PARTITION BY k, start ORDER BY t, event_id)", "pre post")
query("ev_is_sorted", lambda s, d: SE.is_sorted(ev(s, d), KEY, "event_id", "t"), "SELECT k, coalesce(bool_and(t >= p), true) AS ascending, coalesce(bool_and(t > p), true) AS strictly_ascending, coalesce(bool_and(t <= p), true) AS descending, coalesce(bool_and(t < p), true) AS strictly_descending FROM (SELECT k, t, lag(t) OVER (PARTITION BY k ORDER BY event_id) AS p FROM ev) GROUP BY k")
query("ev_image", lambda s, d: SE.event_image(ev(s, d), KEY, 0.0, 2592000.0, 500), "SELECT DISTINCT k, CAST(floor(t / 5184) AS INT) AS pixel FROM ev WHERE t >= 0 AND t < 2592000")
query("ev_thinned", lambda s, d: SE.thin(ev(s, d), KEY, 0.0, 864000.0, 10, ("t", "event_id")).select("event_id"), "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY k ORDER BY t, event_id) - 1 AS n FROM ev WHERE t BETWEEN 0 AND 864000) WHERE n % 10 = 0")
query("ev_nearest_on_grid", lambda s, d: SE.nearest(ev(s, d).select("k").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(719)))).select("k", (F.col("n") * 3600.0).alias("t")), ev(s, d), KEY, ["v"]), "SELECT k, t, CASE WHEN f.st IS NULL OR t - b.st <= f.st - t THEN b.st ELSE f.st END AS near_t, CASE WHEN f.st IS NULL OR t - b.st <= f.st - t THEN b.sv ELSE f.sv END AS near_v FROM (SELECT g.k, g.t, e.t AS st, e.v AS sv FROM (SELECT k, n * 3600.0::DOUBLE AS t FROM (SELECT DISTINCT k FROM ev), range(720) r(n)) g ASOF LEFT JOIN ev e ON e.k = g.k AND g.t >= e.t) b JOIN (SELECT g.k, g.t, e.t AS st, e.v AS sv FROM (SELECT k, n * 3600.0::DOUBLE AS t FROM (SELECT DISTINCT k FROM ev), range(720) r(n)) g ASOF LEFT JOIN ev e ON e.k = g.k AND g.t <= e.t) f USING (k, t)", "t near_t")
query("seg_equal", lambda s, d: SE.segments_equal(A(s, d), every(s, d), KEY), f"SELECT k, start, stop, CAST(count(*) FILTER (w = 1) - count(*) FILTER (w = 2) AS BIGINT) AS n FROM (SELECT *, 1 AS w FROM a UNION ALL SELECT *, 2 FROM {EVERY}) GROUP BY k, start, stop HAVING count(*) FILTER (w = 1) <> count(*) FILTER (w = 2)", "start stop")
query("seg_by_position", lambda s, d: SE.nth_segments(S.merge(A(s, d), KEY), KEY, 5, 25), f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY start, stop) - 1 AS position FROM {M('a')}) WHERE position BETWEEN 5 AND 24", "start stop")
REPEATED = "(SELECT CASE WHEN k = 'click' THEN NULL ELSE k END AS k, start, stop FROM (SELECT * FROM b UNION ALL SELECT * FROM b UNION ALL SELECT k, start, stop + 60 FROM b))"
nulls = lambda df: df.withColumn("k", F.when(F.col("k") != "click", F.col("k")))
repeated = lambda s, d: nulls(Bq(s, d).unionByName(Bq(s, d)).unionByName(Bq(s, d).withColumn("stop", F.col("stop") + 60)))
NULLED = "(SELECT CASE WHEN k = 'click' THEN NULL ELSE k END AS k, t, v FROM ev)"
query("seg_count_repeated", lambda s, d: S.count_in(nulls(ev(s, d)), repeated(s, d), KEY, 900.0).select("k", "start", "stop", "n"), f"SELECT b.k, b.start, b.stop, coalesce(c.n, 0) AS n FROM {REPEATED} b LEFT JOIN (SELECT q.k, q.start, q.stop, count(*) AS n FROM (SELECT DISTINCT * FROM {REPEATED}) q JOIN {NULLED} e ON e.k IS NOT DISTINCT FROM q.k AND t >= q.start AND t < q.stop GROUP BY ALL) c ON c.k IS NOT DISTINCT FROM b.k AND c.start = b.start AND c.stop = b.stop", "start stop")
query("seg_apply_repeated", lambda s, d: S.apply_aggregates(nulls(ev(s, d)), repeated(s, d), KEY, 900.0, total=F.sum("v"), top=F.max("v")), f"SELECT b.k, b.start, b.stop, c.total, c.top FROM {REPEATED} b LEFT JOIN (SELECT q.k, q.start, q.stop, sum(v) AS total, max(v) AS top FROM (SELECT DISTINCT * FROM {REPEATED}) q JOIN {NULLED} e ON e.k IS NOT DISTINCT FROM q.k AND t >= q.start AND t < q.stop GROUP BY ALL) c ON c.k IS NOT DISTINCT FROM b.k AND c.start = b.start AND c.stop = b.stop", "start stop total")

# Paths


def nodes(s, d):
    return sig(s, d).select("k", "i", (F.col("t") / 1000).alias("x"), "y")


EDGES = "(SELECT *, coalesce(sum(length) OVER (PARTITION BY k ORDER BY edge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT k, i AS edge, x, y, nx - x AS dx, ny - y AS dy, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS length FROM (SELECT k, i, t / 1000 AS x, y, lead(t / 1000) OVER w AS nx, lead(y) OVER w AS ny FROM sig WINDOW w AS (PARTITION BY k ORDER BY i)) WHERE nx IS NOT NULL))"
query("path_edges", lambda s, d: P.path_edges(nodes(s, d), KEY), f"SELECT * FROM {EDGES}", "x y dx dy length before", 4)
query("path_tangents", lambda s, d: P.tangents(P.path_edges(nodes(s, d), KEY).filter("length > 0")).select("k", "edge", "tangent", "normal"), f"SELECT k, edge, a - floor(a / {TAU!r}) * {TAU!r} AS tangent, a - {math.pi / 2!r} - floor((a - {math.pi / 2!r}) / {TAU!r}) * {TAU!r} AS normal FROM (SELECT k, edge, atan2(dy, dx) AS a FROM {EDGES} WHERE length > 0)", "tangent normal", 5)
query("path_edge_to_path", lambda s, d: P.edge_to_path(P.path_edges(nodes(s, d), KEY).select("k", "edge", (F.col("length") / 4).alias("along")), P.path_edges(nodes(s, d), KEY), KEY), f"SELECT k, edge, length / 4 AS along, before + length / 4 AS s FROM {EDGES}", "along s", 4)
query("path_position", lambda s, d: P.path_to_edge(P.bin_path(P.path_edges(nodes(s, d), KEY), KEY, 200.0).select("k", F.col("stop").alias("s")).filter("s > 1"), P.path_edges(nodes(s, d), KEY), KEY, 5000.0).select("k", "s", "x", "y"), f"SELECT p.k, p.s, e.x + least(p.s - e.before, e.length) / e.length * e.dx AS x, e.y + least(p.s - e.before, e.length) / e.length * e.dy AS y FROM (SELECT k, l * (b + 1) / n AS s FROM (SELECT k, l, n, unnest(range(n)) AS b FROM (SELECT k, sum(length) AS l, CAST(greatest(1, round(sum(length) / 200)) AS BIGINT) AS n FROM {EDGES} GROUP BY k))) p ASOF JOIN (SELECT * FROM {EDGES} WHERE length > 0) e ON e.k = p.k AND p.s >= e.before WHERE p.s > 1", "s x y", 3)
query("path_bins", lambda s, d: P.bin_path(P.path_edges(nodes(s, d), KEY), KEY, 200.0), f"SELECT k, CAST(b AS INT) AS bin, l * b / n AS start, l * (b + 1) / n AS stop FROM (SELECT k, l, n, unnest(range(n)) AS b FROM (SELECT k, sum(length) AS l, CAST(greatest(1, round(sum(length) / 200)) AS BIGINT) AS n FROM {EDGES} GROUP BY k))", "start stop", 3)
query("path_gradient", lambda s, d: P.gradient(sig(s, d), KEY, "i", "y", 0.5).select("k", "i", "gradient"), "SELECT k, i, CASE WHEN p IS NULL THEN (n - y) / 0.5 WHEN n IS NULL THEN (y - p) / 0.5 ELSE n - p END AS gradient FROM (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS n FROM sig WINDOW w AS (PARTITION BY k ORDER BY i))", "gradient")
query("path_distance", lambda s, d: ev(s, d).select("event_id", P.path_distance(F.col("v"), F.col("t") / 86400).alias("open"), P.path_distance(F.col("v"), F.col("t") / 86400, F.lit(20.0)).alias("closed")), "SELECT event_id, t / 86400 - v AS open, t / 86400 - v + 10 - floor((t / 86400 - v + 10) / 20) * 20 - 10 AS closed FROM ev", "open closed")
query("path_map", lambda s, d: P.path_to_map(G.point_to_polyline(F.col("x"), F.col("y"), PATH), (0.0, 50.0, 40), (0.0, 0.1, 30), s.range(1)), f"SELECT ix, iy, any_value(x) AS x, any_value(y) AS y, min(dd) AS distance, arg_min(b * len + before, struct_pack(d := dd, e := edge)) AS s FROM (SELECT *, sqrt(pow(x - x0 - b * (x1 - x0), 2) + pow(y - y0 - b * (y1 - y0), 2)) AS dd FROM (SELECT *, greatest(0.0, least(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (len * len))) AS b FROM (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS len FROM (SELECT CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, (ix + 0.5) * 50 / 40 AS x, (iy + 0.5) * 0.1::DOUBLE / 30 AS y FROM range(40) a(ix), range(30) b(iy)) CROSS JOIN ({SIDES})))) GROUP BY ix, iy", "x y distance s", 5)
query("path_random", lambda s, d: P.random_on(P.path_edges(nodes(s, d), KEY), KEY, 200, 5000.0, 3).select("k", "id", "s", "x", "y"))
query("shape_circle", lambda s, d: line(s, d).select("l_orderkey", "l_linenumber", P.is_circle(F.col("l_quantity"), F.lit(20.0)).alias("circle"), P.radius(F.col("l_quantity"), F.lit(20.0)).alias("radius")), "SELECT l_orderkey, l_linenumber, l_quantity = 20 AS circle, CASE WHEN l_quantity = 20 THEN 10.0::DOUBLE END AS radius FROM lineitem")

# Signals


def grid(s, d):
    return line(s, d).groupBy("l_returnflag", F.col("l_linenumber").cast("int").alias("j"), F.col("l_quantity").cast("int").alias("i")).agg(F.avg("l_extendedprice").alias("y")).withColumnRenamed("l_returnflag", "k")


GRID = "(SELECT l_returnflag AS k, CAST(l_linenumber AS INT) AS j, CAST(l_quantity AS INT) AS i, avg(l_extendedprice) AS y FROM lineitem GROUP BY ALL)"
W2 = {n: ", ".join(f"({j - len(w) // 2}, {x!r}::DOUBLE)" for j, x in enumerate(w) if x) for n, w in (("g", SG.kernel_weights("gaussian", 1.5)), ("t", SG.kernel_weights("triangular", 2.0)))}
query("sig_smooth_2d", lambda s, d: SG.smooth_axes(grid(s, d), KEY, ["i", "j"], ["gaussian", "triangular"], [1.5, 2.0]).select("k", "i", "j", "smooth"), f"SELECT c.k, c.i, c.j, sum(g.w * h.w * n.y) / sum(g.w * h.w) AS smooth FROM {GRID} c CROSS JOIN (VALUES {W2['g']}) g(o, w) CROSS JOIN (VALUES {W2['t']}) h(o, w) JOIN {GRID} n ON n.k = c.k AND n.i = c.i + g.o AND n.j = c.j + h.o GROUP BY ALL", "smooth", 4)
query("xcorr_2d", lambda s, d: SG.cross_correlation_2d(grid(s, d), grid(s, d), KEY, (2, 1), "unbiased", True), f"WITH g AS (SELECT k, i, j, y - avg(y) OVER (PARTITION BY k) AS y FROM {GRID}) SELECT q.k, CAST(p.i - q.i AS INT) AS lag_i, CAST(p.j - q.j AS INT) AS lag_j, avg(p.y * q.y) AS c FROM g q JOIN g p ON p.k = q.k AND p.i - q.i BETWEEN -2 AND 2 AND p.j - q.j BETWEEN -1 AND 1 GROUP BY ALL", "c", 2)
query("xcorr_2d_pearson", lambda s, d: SG.cross_correlation_2d(grid(s, d), grid(s, d), KEY, (1, 1), "pearson"), f"SELECT q.k, CAST(p.i - q.i AS INT) AS lag_i, CAST(p.j - q.j AS INT) AS lag_j, corr(p.y, q.y) AS c FROM {GRID} q JOIN {GRID} p ON p.k = q.k AND p.i - q.i BETWEEN -1 AND 1 AND p.j - q.j BETWEEN -1 AND 1 GROUP BY ALL", "c", 6)
query("sig_local_integrate", lambda s, d: SG.local_integrate(sig(s, d), KEY, 4).select("k", "i", "total"), "SELECT k, i, sum(y) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS total FROM sig", "total", 4)
query("sig_extrema_gradient", lambda s, d: SG.gradient_extrema(sig(s, d), KEY), "WITH g AS (SELECT k, i, CASE WHEN p IS NULL THEN n - y WHEN n IS NULL THEN y - p ELSE (n - p) / 2 END AS y FROM (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS n FROM sig WINDOW w AS (PARTITION BY k ORDER BY i))) SELECT k, CASE WHEN i - pi = 1 THEN pi + py / (py - y) ELSE (i + pi) / 2 END AS position, CASE WHEN y > 0 THEN 'min' ELSE 'max' END AS kind FROM (SELECT *, lag(i) OVER w AS pi, lag(y) OVER w AS py FROM g WHERE y <> 0 WINDOW w AS (PARTITION BY k ORDER BY i)) WHERE sign(y) <> sign(py)", "position", 5)
query("sig_extrema_range", lambda s, d: SG.extrema(sig(s, d), KEY, "max", 60.0, 200.0), "SELECT k, (i0 + i1) / 2 AS position, y AS amplitude, 'max' AS kind FROM (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS n FROM (SELECT k, g, min(i) AS i0, max(i) AS i1, any_value(y) AS y FROM (SELECT *, sum(CASE WHEN y = p THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(y) OVER (PARTITION BY k ORDER BY i) AS p FROM sig)) GROUP BY k, g) WINDOW w AS (PARTITION BY k ORDER BY g)) WHERE y > p AND y > n AND y BETWEEN 60 AND 200", "position")
query("sig_interp_times", lambda s, d: SE.interpolated_times(sig(s, d).select("k", "i", "t"), "t", 60.0, 3), "SELECT k, i, t + j * 60.0::DOUBLE / 3 AS t FROM sig, range(3) r(j)", "t")
query("sig_roll", lambda s, d: SE.randomize(sig(s, d).select("k", "i", "y"), KEY, "i", ["y"], "roll", 5).groupBy("k").agg(F.count("y").alias("n"), F.sum("y").alias("total")), "SELECT k, count(y) AS n, sum(y) AS total FROM sig GROUP BY k", "total", 4)
query("sig_shuffle", lambda s, d: SE.randomize(sig(s, d).select("k", "i", "y"), KEY, "i", ["y"], "shuffle", 5).groupBy("k", "y").agg(F.count(F.lit(1)).alias("n")), "SELECT k, y, count(*) AS n FROM sig GROUP BY ALL")

# Statistics and angles

query("stat_pearson", lambda s, d: ST.fisher(pv(s, d).withColumn("p", 1 - F.col("p")), ["k", "g"], "p").withColumn("p", 1 - F.col("p")), f"SELECT k, g, 1 - sum(exp(j * ln(x) - lgamma(j + 1) - x)) AS p FROM (SELECT k, g, x, unnest(range(n)) AS j FROM (SELECT k, g, count(*) AS n, -sum(ln(1 - p)) AS x FROM {PV} GROUP BY ALL)) GROUP BY k, g", "p", 7)
query("stat_bootstrap_any", lambda s, d: ST.bootstrap_statistic(ev(s, d), KEY, F.sqrt(F.sum(F.col("w") * F.col("x") * F.col("x")) / F.sum("w")), "v", 100))
query("circ_uniformize", lambda s, d: C.rank(ang(s, d), KEY).select("event_id", (F.col("rank") - C.TWO_PI * F.floor(F.col("rank") / C.TWO_PI)).alias("u")), f"SELECT event_id, u - floor(u / {TAU!r}) * {TAU!r} AS u FROM (SELECT event_id, {TAU!r} * (rank() OVER (PARTITION BY k ORDER BY theta) + (count(*) OVER (PARTITION BY k, theta) - 1) / 2) / count(*) OVER (PARTITION BY k) AS u FROM ang)", "u")

# Clocks

query("clock_lag", lambda s, d: SE.clock_lag(ev(s, d).filter("k = 'click'"), bucketed_rank(ev(s, d).filter("k = 'click'"), [], ["t"], 3600.0).filter("_rank >= 3").select((1.0001 * F.col("t") + 7).alias("t")), 5), "WITH p AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS n FROM ev WHERE k = 'click'), a AS (SELECT n AS i, lead(t) OVER (ORDER BY n) - t AS d FROM p QUALIFY d IS NOT NULL), b AS (SELECT n - 3 AS i, (lead(t) OVER (ORDER BY n) - t) * 1.0001 AS d FROM p WHERE n >= 3 QUALIFY d IS NOT NULL) SELECT CAST(a.i - b.i AS INT) AS lag, corr(a.d, b.d) AS score, count(*) AS pairs FROM b JOIN a ON a.i - b.i BETWEEN -5 AND 5 GROUP BY ALL", "score")
query("clock_synchronize", lambda s, d: SE.synchronize(ev(s, d).filter("k = 'click'"), bucketed_rank(ev(s, d).filter("k = 'click'"), [], ["t"], 3600.0).filter("_rank >= 3").select((1.0001 * F.col("t") + 7).alias("t")), 5), "WITH p AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS n FROM ev WHERE k = 'click') SELECT 3 AS lag, avg(t - (1.0001 * t + 7)) AS shift, regr_slope(t, 1.0001 * t + 7) AS drift, regr_intercept(t, 1.0001 * t + 7) AS intercept, count(*) AS pairs FROM p WHERE n >= 3", "shift drift intercept", 4)
query("io_recording_times", lambda s, d: SE.recording_times(table(s, d, "nlx_event"), ["session_id"]), "SELECT session_id, min(timestamp) FILTER (lower(replace(eventstring, chr(0), ' ')) LIKE '%starting recording%') AS start_us, max(timestamp) FILTER (lower(replace(eventstring, chr(0), ' ')) LIKE '%stopping recording%') AS stop_us FROM nlx_event GROUP BY session_id")
query("io_sync_signal", lambda s, d: SE.sync_signal(B.parse_ttl(table(s, d, "nlx_event")), ["session_id"]), r"WITH v AS (SELECT DISTINCT session_id, CAST(regexp_extract(eventstring, 'board (\d+)', 1) AS INT) AS board, CAST(regexp_extract(eventstring, 'port (\d+)', 1) AS INT) AS port, bit FROM (SELECT *, CAST('0x' || regexp_extract(eventstring, '\(0x([0-9A-Fa-f]+)\)', 1) AS BIGINT) AS value FROM nlx_event WHERE regexp_matches(eventstring, 'TTL Input on (\S+) board (\d+) port (\d+) value \((0x[0-9A-Fa-f]+)\)')), range(32) b(bit) WHERE (value >> bit) & 1 = 1) SELECT session_id, count(*) AS n, CASE WHEN count(*) = 1 THEN min(board) END AS board, CASE WHEN count(*) = 1 THEN min(port) END AS port, CASE WHEN count(*) = 1 THEN CAST(min(bit) AS INT) END AS bit FROM v GROUP BY session_id")

# Filters and spectra in closed form: taps, tapers and Fourier sums as literals


def values(rows) -> str:
    return ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


def convolved(src: str, taps) -> str:
    """SQL of k, i, y: zero-phase convolution of src (k, i, y) with symmetric taps, odd reflection at both ends (the farthest reflected value goes on)."""
    half = len(taps) // 2
    return f"""(WITH s AS {src}, z AS (SELECT k, max(i) AS m FROM s GROUP BY k), o AS (SELECT k, m, unnest(range(-{half}, m + 1 + {half})) AS p FROM z),
w AS (SELECT k, p, CASE WHEN p < 0 THEN least(-p, m, {half}) WHEN p > m THEN m - least(p - m, m, {half}) ELSE p END AS q, CASE WHEN p < 0 THEN 0 WHEN p > m THEN m END AS e FROM o),
x AS (SELECT w.k, w.p, CASE WHEN w.e IS NULL THEN a.y ELSE 2 * b.y - a.y END AS y FROM w JOIN s a ON a.k = w.k AND a.i = w.q LEFT JOIN s b ON b.k = w.k AND b.i = w.e)
SELECT s.k, s.i, sum(h.w * x.y) AS y FROM s CROSS JOIN (VALUES {values([(j - half, float(t)) for j, t in enumerate(taps)])}) h(o, w) JOIN x ON x.k = s.k AND x.p = s.i + h.o GROUP BY s.k, s.i)"""


def oracle(name: str, sql: str, floats: str, digits: int = 6, fn=None) -> None:
    query(name, fn or QUERIES[name], sql, floats, digits)


SIG3 = "(SELECT k, i, y FROM sig)"
EMB3 = "(SELECT vec_id AS k, unnest(range(len(x))) AS i, unnest(x) AS y FROM emb)"
N = 64  # samples of an embedding
FILTERED = convolved(SIG3, K.fir((0.05, 0.2), 1.0))
oracle("fir_filter", f"SELECT f.k, f.i, sig.y, f.y AS filtered FROM {FILTERED} f JOIN sig ON sig.k = f.k AND sig.i = f.i", "filtered", 5)
oracle("decimate", f"SELECT k, CAST(i / 8 AS INT) AS i, y FROM {convolved(SIG3, K.fir(0.8 * 0.5 / 8, 1.0))} WHERE i % 8 = 0", "y", 5)
oracle("interpolate", f"SELECT k AS vec_id, CAST(i AS INT) AS i, y FROM {convolved(f'(SELECT k, i * 3 + j AS i, CASE WHEN j = 0 THEN y ELSE 0 END AS y FROM {EMB3} CROSS JOIN range(3) r(j))', 3 * K.fir(0.5 / 3 * 0.99, 1.0))}", "y")
BANDS = [convolved(EMB3, K.fir(b, 64.0, "10%")) for b in ((8.0, 14.0), (2.0, 6.0), (18.0, 26.0))]
oracle("contrast_bands", f"SELECT a.k AS vec_id, CAST(a.i AS INT) AS i, a.y * a.y - (b.y * b.y + c.y * c.y) / 2 AS contrast FROM {BANDS[0]} a JOIN {BANDS[1]} b ON a.k = b.k AND a.i = b.i JOIN {BANDS[2]} c ON a.k = c.k AND a.i = c.i", "contrast")
oracle("envelope", f"SELECT p.k AS vec_id, CAST(p.i AS INT) AS i, sqrt(any_value(p.y) ** 2 + sum(q.y * h.w) ** 2) AS envelope FROM {EMB3} p JOIN {EMB3} q ON q.k = p.k JOIN (VALUES {values([(d, 2 / N / math.tan(math.pi * d / N) if d % 2 else 0.0) for d in range(1 - N, N)])}) h(d, w) ON h.d = p.i - q.i GROUP BY p.k, p.i", "envelope")
oracle("resample", f"SELECT q.k AS vec_id, CAST(g.n AS INT) AS i, sum(q.y * g.w) AS y FROM {EMB3} q JOIN (VALUES {values([(n, m, 1.0 if (n * N) % 100 == 0 and n * N // 100 == m else 0.0 if (n * N) % 100 == 0 else math.sin(math.pi * (n * N / 100 - m)) / (N * math.tan(math.pi * (n * N / 100 - m) / N))) for n in range(100) for m in range(N)])}) g(n, m, w) ON g.m = q.i GROUP BY q.k, g.n", "y")


def transforms(src: str, n: int) -> str:
    """SQL of k, f (number of the frequency), t (taper), re, im: tapered Fourier sums of records (k, i, y) of n samples, without their mean."""
    taper = values([(t, i, float(w)) for t, row in enumerate(K.tapers(n, min(3.0, (n - 1) / 2), 5)) for i, w in enumerate(row)])
    return f"""(SELECT c.k, f, t, sum(w * y * cos({TAU!r} * ((f * c.i) % {n}) / {n})) AS re, -sum(w * y * sin({TAU!r} * ((f * c.i) % {n}) / {n})) AS im
FROM (SELECT k, i, y - avg(y) OVER (PARTITION BY k) AS y FROM {src}) c JOIN (VALUES {taper}) h(t, i, w) ON h.i = c.i CROSS JOIN range({n // 2 + 1}) r(f) GROUP BY c.k, f, t)"""


oracle("mtspectrum", f"SELECT k AS vec_id, f * 64.0::DOUBLE / {N} AS freq, 2 * avg(re * re + im * im) / 64 AS power FROM {transforms(EMB3, N)} GROUP BY ALL", "power")
WINDOWS = "(SELECT k || '/' || w AS k, j AS i, y FROM (SELECT k, w, i - w AS j, y FROM sig JOIN (SELECT k AS q, unnest(range(0, max(i) - 126, 64)) AS w FROM sig GROUP BY k) ON q = k AND i >= w AND i < w + 128))"
oracle("mtspectrogram", f"SELECT split_part(k, '/', 1) AS k, CAST(split_part(k, '/', 2) AS INT) AS w, f / 128::DOUBLE AS freq, 2 * avg(re * re + im * im) AS power FROM {transforms(WINDOWS, 128)} GROUP BY ALL", "power", 3)
turned = lambda df: df.select(*[c for c in df.columns if c != "phase"], F.cos("phase").alias("phase_cos"), F.sin("phase").alias("phase_sin"))
PAIRED = "SELECT a.k, a.f AS f, sum(a.re * b.re + a.im * b.im) AS re, sum(a.re * b.im - a.im * b.re) AS im, sqrt(sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im)) AS norms"
coherent = QUERIES["mtcoherence"]
oracle("mtcoherence", f"SELECT k AS vec_id, f * 64.0::DOUBLE / {N} AS freq, sqrt(re * re + im * im) / norms AS coherence, re / sqrt(re * re + im * im) AS phase_cos, im / sqrt(re * re + im * im) AS phase_sin FROM ({PAIRED} FROM {transforms(EMB3, N)} a JOIN {transforms(EMB3, N)} b ON b.k = a.k + 1 AND b.f = a.f AND b.t = a.t GROUP BY a.k, a.f)", "coherence phase_cos phase_sin", 5, lambda s, d: turned(coherent(s, d)))
SECOND = WINDOWS.replace("FROM sig JOIN", "FROM (SELECT k, i, y * (1 + i % 7) AS y FROM sig) sig JOIN")
query("mtcoherogram", lambda s, d: turned(K.coherogram(K.arrays(sig(s, d), KEY).join(K.arrays(sig(s, d).withColumn("y", F.col("y") * (1 + F.col("i") % 7)), KEY).withColumnRenamed("samples", "second"), KEY), KEY, "samples", "second", 1.0, 128, 64)), f"SELECT split_part(k, '/', 1) AS k, CAST(split_part(k, '/', 2) AS INT) AS w, f / 128::DOUBLE AS freq, sqrt(re * re + im * im) / norms AS coherence, re / sqrt(re * re + im * im) AS phase_cos, im / sqrt(re * re + im * im) AS phase_sin FROM ({PAIRED} FROM {transforms(WINDOWS, 128)} a JOIN {transforms(SECOND, 128)} b ON b.k = a.k AND b.f = a.f AND b.t = a.t GROUP BY a.k, a.f)", "coherence phase_cos phase_sin", 5)
LOW, HIGH = (10 / K.chi2_quantile(q, 10) for q in (0.975, 0.025))
query("mtspectrum_theory", lambda s, d: K.spectrum_error(emb(s, d), ["vec_id"], "x", 64.0, K.MultitaperOptions(error="theory")), f"SELECT vec_id, freq, power, {LOW!r} * power AS lower, {HIGH!r} * power AS upper FROM (SELECT k AS vec_id, f * 64.0::DOUBLE / {N} AS freq, 2 * avg(re * re + im * im) / 64 AS power FROM {transforms(EMB3, N)} GROUP BY ALL)", "power lower upper")
T = K.t_quantile(0.975, 4)
query("mtspectrum_jackknife", lambda s, d: K.spectrum_error(emb(s, d), ["vec_id"], "x", 64.0, K.MultitaperOptions(error="jackknife")), f"SELECT vec_id, freq, power, power * exp(-{T!r} * s) AS lower, power * exp({T!r} * s) AS upper FROM (SELECT vec_id, freq, any_value(power) AS power, sqrt(4.0::DOUBLE / 5 * sum(pow(lj - mj, 2))) AS s FROM (SELECT *, avg(lj) OVER (PARTITION BY vec_id, freq) AS mj FROM (SELECT k AS vec_id, f * 64.0::DOUBLE / {N} AS freq, 2 * avg(p) OVER (PARTITION BY k, f) / 64 AS power, ln(2 * (sum(p) OVER (PARTITION BY k, f) - p) / 4 / 64) AS lj FROM (SELECT k, f, re * re + im * im AS p FROM {transforms(EMB3, N)}))) GROUP BY vec_id, freq)", "power lower upper", 5)
query("mt_options", lambda s, d: K.frequencies(emb(s, d).select("vec_id", F.size("x").alias("n")), 64.0, K.MultitaperOptions(fpass=(5.0, 20.0))).select("vec_id", "freq"), "SELECT vec_id, f * 64.0::DOUBLE / 64 AS freq FROM emb, range(33) r(f) WHERE f BETWEEN 5 AND 20", "freq")
