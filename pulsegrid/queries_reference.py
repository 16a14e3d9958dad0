"""Queries of the event, interval, signal, statistics and geometry operators over the star-schema tables, with DuckDB SQL.

``events`` is the marked point process (key k = event_type, time t in seconds of 2024, mark v); segments are windows around
events; a key's values in time order are its signal; the time of day is an angle; embeddings are signals and distributions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import circular as C
from pulsegrid.functions import geometry as G
from pulsegrid.functions import stats as ST
from pulsegrid.operators import events as E
from pulsegrid.operators import kernels as K
from pulsegrid.operators import segments as S
from pulsegrid.operators import signals as SG
from pulsegrid.plans.joins import range_join
from pulsegrid.plans.ordered import bucketed_lag, bucketed_rank
from pulsegrid.session import table
from pulsegrid.sources import binary as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = ["k"]
TAU = 2 * math.pi


# Tables, in Spark and in SQL


def ev(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / F.lit(1e6)
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("k"), "user_id", F.col("value").alias("v"), t.alias("t"))


def seg(spark: SparkSession, d: str, rest: int, half: float) -> DataFrame:
    return ev(spark, d).filter(F.col("user_id") % 3 == rest).select("k", (F.col("t") - half).alias("start"), (F.col("t") + half).alias("stop"))


def sig(spark: SparkSession, d: str) -> DataFrame:
    return bucketed_rank(ev(spark, d).select("k", "event_id", "t", F.col("v").alias("y")), KEY, ["t", "event_id"], 3600.0, "i").select("k", "i", "t", "y")


def emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


TABLES = f"""
ev AS (SELECT event_id, event_type AS k, user_id, value AS v, (epoch_us(ts) - 1704067200000000) / 1e6 AS t FROM events),
a AS (SELECT k, t - 600 AS start, t + 600 AS stop FROM ev WHERE user_id % 3 = 0),
b AS (SELECT k, t - 450 AS start, t + 450 AS stop FROM ev WHERE user_id % 3 = 1),
c AS (SELECT k, t - 300 AS start, t + 300 AS stop FROM ev WHERE user_id % 3 = 2),
x AS (SELECT * FROM ev WHERE user_id % 2 = 0), r AS (SELECT * FROM ev WHERE user_id % 2 = 1),
sig AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t, event_id) - 1 AS i, t, v AS y FROM ev),
ang AS (SELECT k, event_id, {TAU!r} * (t - floor(t / 86400) * 86400) / 86400 AS theta FROM ev),
emb AS (SELECT vec_id, [CAST(e AS DOUBLE) FOR e IN embedding] AS x FROM embeddings)"""


def query(name: str, spark_fn: Callable, sql: str | None = None, floats: str = "", digits: int = 6) -> None:
    """Register a query; the named float columns are rounded on both sides."""
    cols = floats.split()

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = spark_fn(spark, d)
        return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols}) if cols else df

    QUERIES[name] = run
    if sql:
        rounded = "REPLACE (" + ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols) + ")" if cols else ""
        ORACLES[name] = f"WITH {TABLES}, q AS ({sql}) SELECT * {rounded} FROM q"


def M(src: str, gap: float = 0, op: str = ">") -> str:
    """SQL of merged segments of a table."""
    w = "PARTITION BY k ORDER BY start, stop"
    return f"""(SELECT k, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(h) OVER ({w} ROWS UNBOUNDED PRECEDING) AS g FROM
(SELECT *, CASE WHEN pm IS NULL OR start {op} pm THEN 1 ELSE 0 END AS h FROM (SELECT *, max(stop) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} AS pm FROM {src}))) GROUP BY k, g)"""


def INV(src: str) -> str:
    """SQL of the complement of merged segments."""
    return f"""(SELECT * FROM (SELECT k, coalesce(lag(stop) OVER (PARTITION BY k ORDER BY start), '-infinity'::DOUBLE) AS start, start AS stop FROM {M(src)} UNION ALL SELECT k, max(stop), 'infinity'::DOUBLE FROM {src} GROUP BY k) WHERE start < stop)"""


def AND(p: str, q: str) -> str:
    return f"(SELECT p.k, greatest(p.start, q.start) AS start, least(p.stop, q.stop) AS stop FROM {p} p JOIN {q} q ON p.k = q.k AND p.start < q.stop AND q.start < p.stop)"


def A(s, d):
    return seg(s, d, 0, 600.0)


def Bq(s, d):
    return seg(s, d, 1, 450.0)


def Cq(s, d):
    return seg(s, d, 2, 300.0)


SS = "start stop"
ABC = "(SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)"

# Segments

query("seg_union", lambda s, d: S.union([A(s, d), Bq(s, d), Cq(s, d)], KEY), f"SELECT * FROM {M(ABC)}", SS)
query("seg_intersection", lambda s, d: S.intersection([A(s, d), Bq(s, d)], KEY), f"SELECT * FROM {M(AND(M('a'), M('b')))}", SS)
query("seg_intersection3", lambda s, d: S.intersection([A(s, d), Bq(s, d), Cq(s, d)], KEY), f"SELECT * FROM {M(AND(AND(M('a'), M('b')), M('c')))}", SS)
query("seg_exclusive", lambda s, d: S.exclusive([A(s, d), Bq(s, d), Cq(s, d)], KEY), f"SELECT * FROM {M(AND(AND(M('a'), INV('b')), INV('c')))}", SS)
query("seg_xor", lambda s, d: S.difference([A(s, d), Bq(s, d)], KEY), f"SELECT * FROM {M('(SELECT * FROM ' + AND(M('a'), INV('b')) + ' UNION ALL SELECT * FROM ' + AND(M('b'), INV('a')) + ')')}", SS)
# Operators on one set of segments: the windows of all events
every = lambda s, d: ev(s, d).select("k", (F.col("t") - 600.0).alias("start"), (F.col("t") + 600.0).alias("stop"))
EVERY = "(SELECT k, t - 600 AS start, t + 600 AS stop FROM ev)"
query("seg_merge", lambda s, d: S.merge(every(s, d), KEY), f"SELECT * FROM {M(EVERY)}", SS)
query("seg_merge_nonstrict", lambda s, d: S.merge(every(s, d), KEY, strict=False), f"SELECT * FROM {M(EVERY, op='>=')}", SS)
query("seg_join_gap", lambda s, d: S.join_gaps(every(s, d), KEY, 900.0), f"SELECT * FROM {M(EVERY, 900)}", SS)
query("seg_invert", lambda s, d: S.invert(every(s, d), KEY), f"SELECT * FROM {INV(EVERY)}", SS)
query("seg_span", lambda s, d: S.span(every(s, d), KEY), f"SELECT k, min(start) AS start, max(stop) AS stop FROM {EVERY} GROUP BY k", SS)
query("seg_has_overlap", lambda s, d: S.has_overlap(every(s, d), KEY), f"SELECT k, bool_or(n < stop) AS has_overlap FROM (SELECT *, lead(start) OVER (PARTITION BY k ORDER BY start, stop) AS n FROM {EVERY}) GROUP BY k")
query("seg_intervals", lambda s, d: S.intervals(S.merge(every(s, d), KEY), KEY), f"SELECT *, lead(start) OVER (PARTITION BY k ORDER BY start) - stop AS interval FROM {M(EVERY)}", SS + " interval")
query("seg_scale", lambda s, d: S.scale(every(s, d), 3.0), f"SELECT k, start - 0.5 * 2 * (stop - start) AS start, stop + 0.5 * 2 * (stop - start) AS stop FROM {EVERY}", SS)
query("seg_offset", lambda s, d: S.offset(every(s, d), 12.5), f"SELECT k, start + 12.5 AS start, stop + 12.5 AS stop FROM {EVERY}", SS)
query("seg_split_tumbling", lambda s, d: S.split(S.merge(every(s, d), KEY), 500.0), f"SELECT k, start + 500 * j AS start, start + 500 * j + 500 AS stop FROM (SELECT *, unnest(range(CAST(floor((stop - start) / 500 + 1e-7) AS BIGINT))) AS j FROM {M(EVERY)})", SS)
query("seg_split_sliding", lambda s, d: S.split(S.merge(every(s, d), KEY), 400.0, 0.25), f"SELECT k, start + 300 * j AS start, start + 300 * j + 400 AS stop FROM (SELECT *, unnest(range(CAST(floor((stop - start - 100) / 300 + 1e-7) AS BIGINT))) AS j FROM {M(EVERY)})", SS)
query("seg_contains_semi", lambda s, d: S.contains(ev(s, d), Bq(s, d), KEY, 900.0), "SELECT * FROM ev WHERE EXISTS (SELECT 1 FROM b WHERE b.k = ev.k AND t >= start AND t < stop)", "t")
query("seg_contains_anti", lambda s, d: S.contains(ev(s, d), Bq(s, d), KEY, 900.0, anti=True), "SELECT * FROM ev WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = ev.k AND t >= start AND t < stop)", "t")
query("seg_count_index", lambda s, d: S.count_in(ev(s, d), S.merge(Bq(s, d), KEY), KEY, 1000.0, ("t", "event_id")), f"""SELECT m.k, m.start, m.stop, count(e.i) AS n, coalesce(min(e.i), -1) AS first, coalesce(max(e.i), -1) AS last FROM {M('b')} m
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, event_id) - 1 AS i FROM ev) e ON m.k = e.k AND e.t >= m.start AND e.t < m.stop GROUP BY ALL""", SS)
query("seg_depth", lambda s, d: S.depth(ev(s, d), A(s, d), KEY, "event_id"), "SELECT ev.k, event_id, count(a.start) AS depth FROM ev LEFT JOIN a ON a.k = ev.k AND t >= start AND t < stop GROUP BY ALL")
query("seg_overlap_pairs", lambda s, d: S.overlap(S.merge(A(s, d), KEY), S.merge(Bq(s, d), KEY), KEY, 1500.0), f"""SELECT p.k, p.start, p.stop, q.start AS start_b, q.stop AS stop_b, least(p.stop, q.stop) - greatest(p.start, q.start) AS overlap,
(least(p.stop, q.stop) - greatest(p.start, q.start)) / (p.stop - p.start) AS rel_a, (least(p.stop, q.stop) - greatest(p.start, q.start)) / (q.stop - q.start) AS rel_b FROM {M('a')} p JOIN {M('b')} q ON p.k = q.k AND p.start < q.stop AND q.start < p.stop""", "start stop start_b stop_b overlap rel_a rel_b")
query("seg_apply_aggregates", lambda s, d: S.apply_aggregates(ev(s, d), S.merge(Bq(s, d), KEY), KEY, 1000.0, n=F.count("v"), top=F.max("v"), mean=F.avg("v")), f"SELECT m.k, m.start, m.stop, count(v) AS n, max(v) AS top, avg(v) AS mean FROM {M('b')} m JOIN ev ON m.k = ev.k AND t >= start AND t < stop GROUP BY ALL", SS + " mean")
query("seg_from_logical", lambda s, d: S.from_logical(sig(s, d), KEY, "i", F.col("y") > 60), "SELECT k, min(i) AS start, max(i) AS stop FROM (SELECT *, i - row_number() OVER (PARTITION BY k ORDER BY i) AS g FROM sig WHERE y > 60) GROUP BY k, g")
query("seg_from_logical_interpolated", lambda s, d: S.from_logical(sig(s, d), KEY, "i", F.col("y") > 60, "t", True), """SELECT k, min_by(coalesce((p + t) / 2, t), i) AS start, max_by(coalesce((n + t) / 2, t), i) AS stop FROM (SELECT *, i - row_number() OVER (PARTITION BY k ORDER BY i) AS g FROM
(SELECT *, lag(t) OVER w AS p, lead(t) OVER w AS n FROM sig WINDOW w AS (PARTITION BY k ORDER BY i)) WHERE y > 60) GROUP BY k, g""", SS, 7)
query("seg_from_indices", lambda s, d: S.from_indices(sig(s, d).filter("y < 20"), KEY, "i"), "SELECT k, min(i) AS start, max(i) AS stop FROM (SELECT *, i - row_number() OVER (PARTITION BY k ORDER BY i) AS g FROM sig WHERE y < 20) GROUP BY k, g")
query("seg_from_duration", lambda s, d: ev(s, d).select("k", *S.from_duration(F.col("t"), F.col("v"), 0.25)), "SELECT k, t - 0.25 * v AS start, t + 0.75 * v AS stop FROM ev", SS)
query("seg_from_vector", lambda s, d: S.from_vector(ev(s, d), KEY, "t", "t"), "SELECT k, t AS start, n AS stop FROM (SELECT k, t, lead(t) OVER (PARTITION BY k ORDER BY t) AS n FROM ev) WHERE n IS NOT NULL", SS)
for g1 in (False, True):
    for g2 in (False, True):
        on = "first_on" if g1 else "last_on"
        off = "last_off" if g2 else "first_off"
        query(f"seg_from_onoff_{int(g1)}{int(g2)}", lambda s, d, g1=g1, g2=g2: S.from_onoff(ev(s, d).filter("user_id % 2 = 0"), ev(s, d).filter("user_id % 2 = 1"), KEY, g1, g2), f"""SELECT k, t AS start, nt AS stop FROM (SELECT *, lead(t) OVER w AS nt, lead(o) OVER w AS no FROM (SELECT *, coalesce(p = 1, true) AS first_on, coalesce(n = 1, true) AS last_on, coalesce(p = 0, true) AS first_off, coalesce(n = 0, true) AS last_off FROM
(SELECT *, user_id % 2 AS o, lag(user_id % 2) OVER v AS p, lead(user_id % 2) OVER v AS n FROM ev WINDOW v AS (PARTITION BY k ORDER BY t, user_id % 2))) WHERE CASE WHEN o = 0 THEN {on} ELSE {off} END WINDOW w AS (PARTITION BY k ORDER BY t, o)) WHERE o = 0 AND no = 1""", SS)
query("seg_partition_block", lambda s, d: S.partition(ev(s, d).select("k", "event_id"), KEY, ["event_id"], size=50), "SELECT k, event_id, CAST(floor((row_number() OVER (PARTITION BY k ORDER BY event_id) - 1) / 50) AS BIGINT) AS part FROM ev")
query("seg_partition_sequence", lambda s, d: S.partition(ev(s, d).select("k", "event_id"), KEY, ["event_id"], nparts=7, method="sequence"), "SELECT k, event_id, (row_number() OVER (PARTITION BY k ORDER BY event_id) - 1) % 7 AS part FROM ev")
query("seg_partition_ntile", lambda s, d: S.partition(ev(s, d).select("k", "event_id"), KEY, ["event_id"], nparts=7), "SELECT k, event_id, CAST(ntile(7) OVER (PARTITION BY k ORDER BY event_id) - 1 AS BIGINT) AS part FROM ev")
query("seg_uniform_random", lambda s, d: S.uniform_random(S.merge(A(s, d), KEY).select("start", "stop"), 1000, 7))

# Events


def X(s, d):
    return ev(s, d).filter("user_id % 2 = 0")


def R(s, d):
    return ev(s, d).filter("user_id % 2 = 1")


query("ev_split_labels", lambda s, d: ev(s, d).groupBy("k").agg(F.count("t").alias("n"), F.min("t").alias("first"), F.max("t").alias("last")), "SELECT k, count(t) AS n, min(t) AS first, max(t) AS last FROM ev GROUP BY k", "first last")
query("ev_label_times", lambda s, d: E.split_labels(ev(s, d).select("k", F.col("event_id").alias("t")), "k"), "SELECT k, list(event_id ORDER BY event_id) AS times FROM ev GROUP BY k")
query("ev_rate", lambda s, d: E.rate(ev(s, d), KEY), "SELECT k, count(*) / (max(t) - min(t) + (max(t) - min(t)) / (count(*) - 1)) AS rate FROM ev GROUP BY k", "rate", 9)
query("ev_rate_segments", lambda s, d: E.rate(ev(s, d), KEY, A(s, d), 1500.0), f"SELECT m.k, sum(n) / sum(stop - start) AS rate FROM (SELECT m.*, (SELECT count(*) FROM ev WHERE ev.k = m.k AND t >= m.start AND t < m.stop) AS n FROM {M('a')} m) m GROUP BY k", "rate", 9)
query("ev_rate_separate", lambda s, d: E.rate(ev(s, d), KEY, A(s, d), 1500.0, True), f"SELECT m.k, m.start, m.stop, count(t) / (m.stop - m.start) AS rate FROM {M('a')} m LEFT JOIN ev ON ev.k = m.k AND t >= m.start AND t < m.stop GROUP BY m.k, m.start, m.stop", "start stop rate", 9)
for kind, value in (("count", "count(t)"), ("binary", "CAST(count(t) > 0 AS INT)"), ("rate", "count(t) / (b.stop - b.start)")):
    query(f"ev_bin_{kind}", lambda s, d, kind=kind: E.bin_events(ev(s, d), Bq(s, d).distinct(), KEY, 900.0, kind), f"SELECT b.k, b.start, b.stop, {value} AS value FROM (SELECT DISTINCT * FROM b) b LEFT JOIN ev ON ev.k = b.k AND t >= b.start AND t < b.stop GROUP BY b.k, b.start, b.stop", SS + (" value" if kind == "rate" else ""), 6)
query("ev_regular_bins", lambda s, d: E.regular_bins(ev(s, d), KEY, 0.0, 3600.0), "SELECT k, CAST(floor(t / 3600) AS BIGINT) AS bin, count(*) AS n FROM ev GROUP BY ALL")
EXTREMES = "CASE WHEN pre IS NOT NULL AND post IS NOT NULL THEN CASE WHEN abs(post) <= abs(pre) THEN post ELSE pre END END AS smallest, CASE WHEN pre IS NOT NULL AND post IS NOT NULL THEN CASE WHEN abs(post) > abs(pre) THEN post ELSE pre END END AS largest"
query("ev_intervals", lambda s, d: E.intervals(ev(s, d), KEY, ("t", "event_id")).select("event_id", "pre", "post", "smallest", "largest"), f"SELECT event_id, pre, post, {EXTREMES} FROM (SELECT event_id, lag(t) OVER w - t AS pre, lead(t) OVER w - t AS post FROM ev WINDOW w AS (PARTITION BY k ORDER BY t, event_id))", "pre post smallest largest")
query("ev_cross_intervals", lambda s, d: E.cross_intervals(X(s, d), R(s, d), KEY).select("event_id", "pre", "post", "smallest", "largest"), f"SELECT event_id, pre, post, {EXTREMES} FROM (SELECT p.event_id, p.t0 - p.t AS pre, n.t1 - n.t AS post FROM (SELECT x.event_id, x.t, r.t AS t0 FROM x ASOF LEFT JOIN r ON x.k = r.k AND x.t >= r.t) p JOIN (SELECT x.event_id, x.t, r.t AS t1 FROM x ASOF LEFT JOIN r ON x.k = r.k AND x.t <= r.t) n USING (event_id))", "pre post smallest largest")
query("ev_filter_intervals", lambda s, d: E.filter_intervals(ev(s, d), KEY, 600.0, ("t", "event_id")).select("event_id"), "SELECT event_id FROM (SELECT *, t - lag(t) OVER (PARTITION BY k ORDER BY t, event_id) AS p FROM ev) WHERE p IS NULL OR p >= 600")


def bursts_sql(mark: bool = False) -> str:
    near = "coalesce(p BETWEEN 60 AND 900" + (" AND v <= pv" if mark else "") + ", false)"
    return f"""(SELECT *, CASE WHEN NOT i AND o THEN 1 WHEN i AND o THEN 2 WHEN i THEN 3 ELSE 0 END AS burst FROM (SELECT *, coalesce(lead(i) OVER w, false) AS o FROM (SELECT *, {near} AS i FROM
(SELECT *, t - lag(t) OVER w AS p, lag(v) OVER w AS pv FROM ev WINDOW w AS (PARTITION BY k ORDER BY t, event_id))) WINDOW w AS (PARTITION BY k ORDER BY t, event_id)))"""


def bursts_(s, d, mark=None):
    return E.bursts(ev(s, d), KEY, 60.0, 900.0, mark, order=("t", "event_id"))


SIZED = f"(SELECT *, count(*) FILTER (burst > 0) OVER (PARTITION BY k, g) AS n FROM (SELECT *, sum(CASE WHEN burst = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM {bursts_sql()}))"
query("ev_bursts", lambda s, d: bursts_(s, d).select("event_id", "burst"), f"SELECT event_id, burst FROM {bursts_sql()}")
query("ev_bursts_marks", lambda s, d: bursts_(s, d, "v").select("event_id", "burst"), f"SELECT event_id, burst FROM {bursts_sql(True)}")
query("ev_burst_length", lambda s, d: E.burst_length(bursts_(s, d), KEY, (3, 4), ("t", "event_id")).select("event_id", "burst"), f"SELECT event_id, CASE WHEN burst > 0 AND n BETWEEN 3 AND 4 THEN burst ELSE 0 END AS burst FROM {SIZED}")
query("ev_burst_length_scalar", lambda s, d: E.burst_length(bursts_(s, d), KEY, 3, ("t", "event_id")).select("event_id", "burst"), f"SELECT event_id, CASE WHEN burst > 0 AND n < 3 THEN burst ELSE 0 END AS burst FROM {SIZED}")
for method, where in E.BURST_FILTERS.items():
    query(f"ev_filter_bursts_{method}", lambda s, d, method=method: E.filter_bursts(bursts_(s, d), method).select("event_id"), f"SELECT event_id FROM {bursts_sql()} WHERE {where}")
query("ev_count_until", lambda s, d: E.count_until(X(s, d), R(s, d), KEY, "event_id"), "SELECT r.k, r.event_id, count(x.t) AS n FROM r LEFT JOIN x ON x.k = r.k AND x.t <= r.t GROUP BY ALL")
query("ev_csi", lambda s, d: E.complex_spike_index(ev(s, d), KEY, "v", 60.0, 900.0), """SELECT k, CAST(floor(100 * sum(CASE WHEN pre IS NULL OR post IS NULL OR abs(dt) > 900 THEN 0 ELSE CASE WHEN ((dt < 0 AND da >= 0) OR (dt > 0 AND da < 0)) AND abs(dt) >= 60 THEN 1 ELSE 0 END - CASE WHEN (dt > 0 AND da >= 0) OR (dt < 0 AND da < 0) OR abs(dt) < 60 THEN 1 ELSE 0 END END) / count(*)) AS BIGINT) AS csi FROM
(SELECT *, CASE WHEN post <= abs(pre) THEN post ELSE pre END AS dt, CASE WHEN post <= abs(pre) THEN an ELSE ap END AS da FROM (SELECT k, lag(t) OVER w - t AS pre, lead(t) OVER w - t AS post, lag(v) OVER w - v AS ap, lead(v) OVER w - v AS an FROM ev WINDOW w AS (PARTITION BY k ORDER BY t))) GROUP BY k""")
LAGS = "SELECT r.event_id AS ref, x.event_id, x.t - r.t AS lag FROM r JOIN x ON x.k = r.k AND x.t - r.t BETWEEN -600 AND 600"
lags = lambda df: df.select(F.col("event_id").alias("ref"), F.col("event_id_r").alias("event_id"), "lag")
query("ev_correlation", lambda s, d: lags(E.correlation(X(s, d), R(s, d), KEY, -600.0, 600.0)), LAGS, "lag")
NONSTRICT = M("a", op=">=")
query("ev_correlation_segments", lambda s, d: lags(E.correlation(X(s, d), R(s, d), KEY, -600.0, 600.0, A(s, d), 1500.0)), f"SELECT r.event_id AS ref, x.event_id, x.t - r.t AS lag FROM r JOIN {NONSTRICT} m ON m.k = r.k AND r.t BETWEEN m.start AND m.stop JOIN x ON x.k = r.k AND x.t - r.t BETWEEN -600 AND 600 AND x.t BETWEEN m.start AND m.stop", "lag")
query("ev_correlation_strict", lambda s, d: lags(E.correlation(X(s, d), R(s, d), KEY, -600.0, 600.0, A(s, d), 1500.0, unbiased="strict")), f"SELECT r.event_id AS ref, x.event_id, x.t - r.t AS lag FROM r JOIN {NONSTRICT} m ON m.k = r.k AND r.t BETWEEN m.start AND m.stop AND r.t - 600 >= m.start AND r.t + 600 <= m.stop JOIN x ON x.k = r.k AND x.t - r.t BETWEEN -600 AND 600", "lag")
query("ev_correlation_relaxed", lambda s, d: lags(E.correlation(X(s, d), R(s, d), KEY, -600.0, 600.0, A(s, d), 1500.0, unbiased="relaxed")), f"SELECT r.event_id AS ref, x.event_id, x.t - r.t AS lag FROM r JOIN {NONSTRICT} m ON m.k = r.k AND r.t BETWEEN m.start AND m.stop JOIN x ON x.k = r.k AND x.t - r.t BETWEEN -600 AND 600", "lag")
query("ev_joint_correlation", lambda s, d: E.joint_correlation(X(s, d), R(s, d), ev(s, d).filter("user_id % 5 = 0").select("k", "t", "v"), KEY, -600.0, 600.0).select(F.col("event_id").alias("ref"), F.col("event_id_r").alias("event_id"), "lag", "x"), """SELECT l.*, n.x FROM (SELECT r.event_id AS ref, x.event_id, x.t - r.t AS lag FROM r JOIN x ON x.k = r.k AND x.t - r.t BETWEEN -600 AND 600) l JOIN
(SELECT p.event_id AS ref, CASE WHEN f.st IS NULL OR p.t - p.st <= f.st - f.t THEN p.v0 ELSE f.v1 END AS x FROM (SELECT r.event_id, r.t, e.t AS st, e.v AS v0 FROM r ASOF LEFT JOIN (SELECT * FROM ev WHERE user_id % 5 = 0) e ON r.k = e.k AND r.t >= e.t) p JOIN (SELECT r.event_id, r.t, e.t AS st, e.v AS v1 FROM r ASOF LEFT JOIN (SELECT * FROM ev WHERE user_id % 5 = 0) e ON r.k = e.k AND r.t <= e.t) f USING (event_id)) n USING (ref)""", "lag")
PETH = """SELECT g.k, g.bin, {} AS value FROM (SELECT *, ne / T AS p1, nr / T AS p0 FROM (SELECT k, max(t1) - min(t0) AS T, count(*) FILTER (user_id % 2 = 0 AND t < t1) AS ne, count(*) FILTER (user_id % 2 = 1 AND t < t1) AS nr, count(*) FILTER (user_id % 2 = 1) AS nv FROM (SELECT *, min(t) OVER (PARTITION BY k) AS t0, max(t) OVER (PARTITION BY k) AS t1 FROM ev) GROUP BY k)) s JOIN
(SELECT k, CAST(b AS INT) AS bin FROM (SELECT DISTINCT k FROM ev), range(12) t(b)) g USING (k) LEFT JOIN (SELECT k, CAST(least(floor((lag + 600) / 100), 11) AS INT) AS bin, count(*) AS m FROM (SELECT r.k, x.t - r.t AS lag FROM r JOIN x ON x.k = r.k AND x.t - r.t BETWEEN -600 AND 600) GROUP BY ALL) h ON h.k = g.k AND h.bin = g.bin"""
N = "coalesce(m, 0)::DOUBLE"
CROSS = f"({N} / (100 * T) - p1 * p0)"
FORMULAS = {"none": N, "coef": f"{N} / nv", "rate": f"{N} / (nv * 100)", "product density": f"{N} / (100 * T)", "cross covariance": CROSS, "standard cross covariance": f"sqrt(100 * T / (p1 * p0)) * {CROSS}", "zscore": f"{CROSS} / (p1 * p0 / (100 * T))"}
for norm, formula in FORMULAS.items():
    query(f"peth_{norm.replace(' ', '_')}", lambda s, d, norm=norm: E.peri_event_histogram(X(s, d), R(s, d), KEY, -600.0, 600.0, 12, norm), PETH.format(formula), "value", 4 if norm == "zscore" else 9)
query("ev_density", lambda s, d: E.density(ev(s, d), KEY, 0.0, 86400.0 * 30, 301, 7200.0), f"SELECT k, i, coalesce(sum(exp(-0.5 * pow((8640.0 * i - t) / 7200, 2))) FILTER (abs(8640.0 * i - t) <= 8 * 7200), 0) / (count(*) * 7200 * {math.sqrt(TAU)!r}) AS density FROM ev, (SELECT CAST(b AS INT) AS i FROM range(301) t(b)) GROUP BY ALL", "density", 12)
query("ev_peri_density", lambda s, d: E.peri_event_density(X(s, d), R(s, d), KEY, -600.0, 600.0, 25, 60.0), f"SELECT k, i, sum(exp(-0.5 * pow((50.0 * i - 600 - lag) / 60, 2))) / (any_value(nt) * 60 * {math.sqrt(TAU)!r}) AS rate FROM (SELECT r.k, x.t - r.t AS lag, count(*) OVER () FROM r JOIN x ON x.k = r.k AND x.t - r.t BETWEEN -600 AND 600) JOIN (SELECT k, count(*) AS nt FROM r GROUP BY k) USING (k), (SELECT CAST(b AS INT) AS i FROM range(25) t(b)) GROUP BY ALL", "rate", 9)
EPOCHS = "(SELECT k, 86400.0 * n AS start, 86400.0 * n + 60000 AS stop FROM (SELECT DISTINCT k FROM ev), range(30) t(n))"


def epochs(s, d):
    return ev(s, d).select("k").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(29)))).select("k", (86400.0 * F.col("n")).alias("start"), (86400.0 * F.col("n") + 60000).alias("stop"))


def tiles(t: str) -> str:
    return M(AND(M(f"(SELECT k, t - 120 AS start, t + 120 AS stop FROM {t})"), EPOCHS))


def share(p: str, q: str) -> str:
    return f"(SELECT k, avg(CAST(EXISTS (SELECT 1 FROM {tiles(q)} w WHERE w.k = {p}.k AND t >= w.start AND t < w.stop) AS INT)) AS f FROM {p} WHERE EXISTS (SELECT 1 FROM {EPOCHS} e WHERE e.k = {p}.k AND t >= e.start AND t < e.stop) GROUP BY k)"


query("ev_sttc", lambda s, d: E.tiling_coefficient(X(s, d), R(s, d), epochs(s, d), KEY, 120.0), f"SELECT k, 0.5 * ((pa.f - tb.f) / (1 - pa.f * tb.f) + (pb.f - ta.f) / (1 - pb.f * ta.f)) AS sttc FROM {share('x', 'r')} pa JOIN {share('r', 'x')} pb USING (k) JOIN (SELECT k, sum(stop - start) / (30 * 60000) AS f FROM {tiles('x')} GROUP BY k) ta USING (k) JOIN (SELECT k, sum(stop - start) / (30 * 60000) AS f FROM {tiles('r')} GROUP BY k) tb USING (k)", "sttc", 9)
query("ev_shift_circular", lambda s, d: E.shift(ev(s, d).select("k", "event_id", "t"), epochs(s, d), KEY, 100000.0, 60000.0), "SELECT k, event_id, u - floor(u / 60000) * 60000 + floor(u / 60000) * 86400 AS t FROM (SELECT *, w - floor(w / 1800000) * 1800000 AS u FROM (SELECT *, t - floor(t / 86400) * 86400 + floor(t / 86400) * 60000 + 100000 AS w FROM ev WHERE t - floor(t / 86400) * 86400 < 60000 AND t < 30 * 86400))", "t", 6)

# Signals

for kind, value, sql in (
    ("zscore", 2.0, "avg(y) + 2 * stddev_pop(y)"), ("median", 1.5, "median(y) + 1.5 * (quantile_cont(y, 0.75) - median(y))"), ("percentile", 90.0, "quantile_cont(y, 0.9)"), ("raw", 5.0, "5.0::DOUBLE"),
):
    query(f"sig_threshold_{kind}", lambda s, d, kind=kind, value=value: SG.threshold(sig(s, d), KEY, kind, value), f"SELECT k, {sql} AS threshold FROM sig GROUP BY k", "threshold")
for kind, center in (("median mad", "median(y)"), ("mean mad", "avg(y)")):
    query(f"sig_threshold_{kind.replace(' ', '_')}", lambda s, d, kind=kind: SG.threshold(sig(s, d), KEY, kind, 2.0), f"SELECT k, any_value(c) + 2 * median(abs(y - c)) / {SG.NORMAL_MAD!r} AS threshold FROM (SELECT *, {center} OVER (PARTITION BY k) AS c FROM sig) GROUP BY k", "threshold")
query("sig_mountains", lambda s, d: SG.mountains(sig(s, d), KEY, 40.0, 100.0, 300.0, 60.0), "SELECT * FROM " + M("(SELECT k, min(t) AS start, max(t) AS stop FROM (SELECT *, max(t) OVER (PARTITION BY k, g) AS z FROM (SELECT *, i - row_number() OVER (PARTITION BY k ORDER BY i) AS g FROM sig WHERE y > 40)) GROUP BY k, g HAVING max(y) FILTER (t < z) > 100)", 300) + " WHERE stop - start >= 60", SS)
query("sig_extrema", lambda s, d: SG.extrema(sig(s, d), KEY), """SELECT k, (i0 + i1) / 2 AS position, y AS amplitude, CASE WHEN y > p THEN 'max' ELSE 'min' END AS kind FROM (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS n FROM (SELECT k, g, min(i) AS i0, max(i) AS i1, any_value(y) AS y FROM
(SELECT *, sum(CASE WHEN y = p THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(y) OVER (PARTITION BY k ORDER BY i) AS p FROM sig)) GROUP BY k, g) WINDOW w AS (PARTITION BY k ORDER BY g)) WHERE (y > p AND y > n) OR (y < p AND y < n)""", "position")
query("sig_zero_crossings", lambda s, d: SG.zero_crossings(sig(s, d).withColumn("y", F.col("y") - 50), KEY), "SELECT k, CASE WHEN i - pi = 1 THEN pi + py / (py - y) ELSE (i + pi) / 2 END AS position, CASE WHEN y > 0 THEN 'rising' ELSE 'falling' END AS direction FROM (SELECT *, lag(i) OVER w AS pi, lag(y) OVER w AS py FROM (SELECT k, i, y - 50 AS y FROM sig) WHERE y <> 0 WINDOW w AS (PARTITION BY k ORDER BY i)) WHERE sign(y) <> sign(py)", "position")
ART = "SELECT s.*, EXISTS (SELECT 1 FROM ev e WHERE e.user_id % 50 = 0 AND e.k = s.k AND s.t >= e.t - 300 AND s.t < e.t + 300) AS bad FROM sig s"
artefacts = lambda s, d: ev(s, d).filter("user_id % 50 = 0").select("k", "t")
query("sig_artefact_fill", lambda s, d: SG.blank_artefacts(sig(s, d), artefacts(s, d), KEY, 300.0, 300.0, 0.0), f"SELECT k, i, t, CASE WHEN bad THEN 0 ELSE y END AS y FROM ({ART})", "t")
query("sig_artefact_linear", lambda s, d: SG.blank_artefacts(sig(s, d), artefacts(s, d), KEY, 300.0, 300.0, linear=True), f"""SELECT k, i, t, coalesce(g, y0 + (y1 - y0) * (t - t0) / (t1 - t0), y0, y1) AS y FROM (SELECT *, last_value(g IGNORE NULLS) OVER p AS y0, last_value(CASE WHEN g IS NOT NULL THEN t END IGNORE NULLS) OVER p AS t0, first_value(g IGNORE NULLS) OVER n AS y1, first_value(CASE WHEN g IS NOT NULL THEN t END IGNORE NULLS) OVER n AS t1 FROM
(SELECT *, CASE WHEN NOT bad THEN y END AS g FROM ({ART})) WINDOW p AS (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", "t y")
query("sig_windows", lambda s, d: SG.windows(sig(s, d), KEY, 64, 48).groupBy("k", "w").agg(F.count("y").alias("n"), F.avg("y").alias("mean")), "SELECT k, w, count(y) AS n, avg(y) AS mean FROM sig, range(100000) g(w) WHERE i >= w * 48 AND i < w * 48 + 64 AND w * 48 + 64 <= (SELECT max(i) + 1 FROM sig s WHERE s.k = sig.k) AND w <= i / 48 AND w >= (i - 64) / 48 GROUP BY ALL", "mean", 9)
query("sig_trigger_windows", lambda s, d: SG.trigger_windows(sig(s, d), sig(s, d).filter("i % 37 = 0").withColumn("id", F.col("i")).select("k", "i", "id"), KEY, 5, "id"), "SELECT g.k, g.i AS trigger, s.i - g.i AS lag, s.y FROM sig g JOIN sig s ON s.k = g.k AND s.i BETWEEN g.i - 5 AND g.i + 5 JOIN (SELECT k, max(i) AS m FROM sig GROUP BY k) z ON z.k = g.k WHERE g.i % 37 = 0 AND g.i >= 5 AND g.i + 5 <= m")
query("sig_triggered_average", lambda s, d: SG.triggered_average(sig(s, d), ev(s, d).filter("user_id % 10 = 0").select("k", "t"), KEY, -300.0, 300.0, 60.0), """SELECT k, lag, avg(CASE WHEN t1 = t0 THEN y0 ELSE y0 + (y1 - y0) * (t - t0) / (t1 - t0) END) AS mean FROM (SELECT b.*, s.t AS t1, s.y AS y1 FROM (SELECT p.*, s.t AS t0, s.y AS y0 FROM (SELECT k, CAST(l AS INT) AS lag, t - 300.0 + l * 60.0 AS t FROM ev, range(10) g(l) WHERE user_id % 10 = 0) p ASOF LEFT JOIN sig s ON p.k = s.k AND p.t >= s.t) b ASOF LEFT JOIN sig s ON b.k = s.k AND b.t <= s.t) GROUP BY ALL""", "mean", 4)
query("sig_rolling_median", lambda s, d: SG.rolling_median(sig(s, d), KEY, 7).select("k", "i", "m"), "SELECT k, i, quantile_cont(y, 0.5) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m FROM sig", "m", 4)
query("sig_sliding_rms", lambda s, d: SG.sliding_rms(sig(s, d), KEY, 7).select("k", "i", "rms"), "SELECT k, i, sqrt(avg(y * y) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)) AS rms FROM sig", "rms", 5)
for kernel in ("gaussian", "epanechnikov", "uniform", "triangular"):
    weights = SG.kernel_weights(kernel, 3.0)
    half = len(weights) // 2
    values = ", ".join(f"({j - half}, {w!r}::DOUBLE)" for j, w in enumerate(weights))
    query(f"sig_smooth_{kernel}", lambda s, d, kernel=kernel: SG.smooth(sig(s, d), KEY, kernel, 3.0).select("k", "i", "smooth"), f"SELECT c.k, c.i, sum(w * n.y) / sum(w) AS smooth FROM sig c CROSS JOIN (VALUES {values}) h(o, w) JOIN sig n ON n.k = c.k AND n.i = c.i + o GROUP BY ALL", "smooth", 5)
query("sig_upsample", lambda s, d: SG.upsample(sig(s, d).select("k", "i", "y"), 3), "SELECT k, i * 3 + j AS i, CASE WHEN j = 0 THEN y ELSE 0 END AS y FROM sig, range(3) t(j)")
query("sig_downsample", lambda s, d: SG.downsample(sig(s, d).select("k", "i", "y"), 4), "SELECT k, i, y FROM sig WHERE i % 4 = 0")
for scale, expr in (("none", "sum(p.y * q.y)"), ("unbiased", "sum(p.y * q.y) / count(*)"), ("biased", "sum(p.y * q.y) / any_value(n)"), ("coeff", "sum(p.y * q.y) / any_value(sq)"), ("pearson", "corr(p.y, q.y)")):
    query(f"xcorr_{scale}", lambda s, d, scale=scale: SG.cross_correlation(sig(s, d), sig(s, d), KEY, 10, scale), f"SELECT q.k, CAST(p.i - q.i AS INT) AS lag, {expr} AS c FROM sig q JOIN sig p ON p.k = q.k AND p.i - q.i BETWEEN -10 AND 10 JOIN (SELECT k, count(*) AS n, sum(y * y) AS sq FROM sig GROUP BY k) z ON z.k = q.k GROUP BY ALL", "c", 4 if scale == "none" else 6)

# Statistics


def line(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_extendedprice")


query("stat_bin2d", lambda s, d: line(s, d).select(ST.bin_index(F.col("l_quantity"), 1.0, 51.0, 10).alias("bx"), ST.bin_index_edges(F.col("l_discount"), [0.0, 0.015, 0.035, 0.075, 0.1]).alias("by")).filter("bx is not null and by is not null").groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(floor((l_quantity - 1) / 5) AS INT) AS bx, CASE WHEN l_discount < 0.015 THEN 0 WHEN l_discount < 0.035 THEN 1 WHEN l_discount < 0.075 THEN 2 ELSE 3 END AS by, count(*) AS n FROM lineitem WHERE l_quantity >= 1 AND l_quantity < 51 AND l_discount >= 0 AND l_discount < 0.1 GROUP BY ALL")
query("stat_group_map", lambda s, d: line(s, d).join(F.broadcast(line(s, d).groupBy("l_returnflag").agg(F.avg("l_quantity").alias("_m"))), "l_returnflag").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_quantity") - F.col("_m")).alias("centered")), "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag) AS centered FROM lineitem", "centered")
query("stat_dense", lambda s, d: ST.dense(E.regular_bins(ev(s, d), KEY, 0.0, 86400.0).withColumn("bin", F.col("bin").cast("int")), KEY, {"bin": 31}, "n"), "SELECT g.k, CAST(b AS INT) AS bin, count(ev.t) AS n FROM (SELECT DISTINCT k FROM ev) g CROSS JOIN range(31) t(b) LEFT JOIN ev ON ev.k = g.k AND floor(ev.t / 86400) = b GROUP BY ALL")
query("stat_monte_carlo", lambda s, d: ev(s, d).groupBy("k").agg(*[ST.monte_carlo_pvalue("v", F.lit(120.0), t, 50.0).alias(t) for t in ("right", "left", "both")]), 'SELECT k, (count(*) FILTER (v >= 120) + 1) / (count(v) + 1) AS "right", (count(*) FILTER (v <= 120) + 1) / (count(v) + 1) AS "left", (count(*) FILTER (abs(v - 50) >= 70) + 1) / (count(v) + 1) AS "both" FROM ev GROUP BY k')
# Fisher's sum has as many terms as a group has values.
PV = "(SELECT k, user_id % 20 AS g, (floor(v) % 97 + 1) / 98 AS p FROM ev)"
pv = lambda s, d: ev(s, d).select("k", (F.col("user_id") % 20).alias("g"), ((F.floor("v") % 97 + 1) / 98).alias("p"))
query("stat_combine_p", lambda s, d: pv(s, d).groupBy("k", "g").agg(*[ST.combine_pvalues("p", m).alias(m) for m in ("nichols", "friston", "tippett")]), f"SELECT k, g, max(p) AS nichols, pow(max(p), count(*)) AS friston, 1 - pow(1 - min(p), count(*)) AS tippett FROM {PV} GROUP BY ALL", "nichols friston tippett", 9)
query("stat_fisher", lambda s, d: ST.fisher(pv(s, d), ["k", "g"], "p"), f"SELECT k, g, sum(exp(j * ln(x) - lgamma(j + 1) - x)) AS p FROM (SELECT k, g, x, unnest(range(n)) AS j FROM (SELECT k, g, count(*) AS n, -sum(ln(p)) AS x FROM {PV} GROUP BY ALL)) GROUP BY k, g", "p", 7)
query("stat_format_p", lambda s, d: pv(s, d).select("p").distinct().select(F.round("p", 6).alias("p"), ST.stars(F.col("p")).alias("stars"), ST.exact(F.col("p")).alias("exact"), ST.relative(F.col("p")).alias("relative")), f"SELECT DISTINCT round(p, 6) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars, printf('p=%.3f', p) AS exact, CASE WHEN p < 0.001 THEN 'p<0.001' WHEN p < 0.01 THEN 'p<0.01' WHEN p < 0.05 THEN 'p<0.05' ELSE 'p≥0.05' END AS relative FROM {PV}")
query("stat_mode", lambda s, d: ST.mode_kde(ev(s, d), KEY, "v", 101), """SELECT k, arg_max(gx, struct_pack(d := d, g := -g)) AS mode FROM (SELECT k, g, gx, round(sum(c * exp(-0.5 * pow((gx - vv) / h, 2))), 6) AS d FROM (SELECT q.k, g, vv, c, sd * pow(n, -0.2) AS h, lo + (hi - lo) * g / 100 AS gx FROM (SELECT k, round(v, 2) AS vv, count(*) AS c FROM ev GROUP BY ALL) q JOIN (SELECT k, count(v) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM ev GROUP BY k) s USING (k), range(101) t(g)) GROUP BY ALL) GROUP BY k""", "mode", 4)
query("stat_beta", lambda s, d: table(s, d, "part").select("p_partkey", *ST.beta_parameters(F.col("p_size") / 51.0, F.lit(4.0))), "SELECT p_partkey, (p_size / 51.0::DOUBLE) * 2 + 1 AS alpha, (1 - p_size / 51.0::DOUBLE) * 2 + 1 AS beta FROM part", "alpha beta")
query("stat_spatial_information", lambda s, d: ST.spatial_information(E.regular_bins(ev(s, d), KEY, 0.0, 86400.0).select("k", (F.col("n") / 24.0).alias("rate"), (F.col("bin") % 5 + 1).cast("double").alias("occ")), KEY, "rate", "occ"), "SELECT k, sum(r * o / tn * log2(r / (tn / tt))) AS information FROM (SELECT *, sum(r * o) OVER (PARTITION BY k) AS tn, sum(o) OVER (PARTITION BY k) AS tt FROM (SELECT k, count(*) / 24.0::DOUBLE AS r, (floor(t / 86400) % 5 + 1)::DOUBLE AS o FROM ev GROUP BY k, floor(t / 86400))) GROUP BY k", "information", 9)


def dists(s, d):
    p = emb(s, d).select("vec_id", F.transform("x", lambda v: F.abs(v)).alias("x")).withColumn("n", F.aggregate("x", F.lit(0.0), lambda a, v: a + v))
    p = p.select("vec_id", F.transform("x", lambda v: v / F.col("n")).alias("p"))
    return p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")


DIST = "(SELECT a.vec_id, a.p, b.p AS q FROM (SELECT vec_id, [abs(v) / list_sum([abs(w) FOR w IN x]) FOR v IN x] AS p FROM emb) a JOIN (SELECT vec_id, [abs(v) / list_sum([abs(w) FOR w IN x]) FOR v IN x] AS p FROM emb) b ON b.vec_id = a.vec_id + 1)"
BC = "list_sum([sqrt(p[j] * q[j]) FOR j IN range(1, len(p) + 1)])"
query("dist_bhattacharyya", lambda s, d: dists(s, d).select("vec_id", ST.bhattacharyya(F.col("p"), F.col("q")).alias("bc"), ST.bhattacharyya_distance(F.col("p"), F.col("q")).alias("bd"), ST.hellinger(F.col("p"), F.col("q")).alias("h")), f"SELECT vec_id, {BC} AS bc, -ln({BC}) AS bd, sqrt(1 - {BC}) AS h FROM {DIST}", "bc bd h")
query("dist_weighted", lambda s, d: dists(s, d).select("vec_id", ST.weighted_distance(F.col("p"), F.col("q")).alias("w")), f"SELECT vec_id, sqrt(list_sum([list_sum([p[i] * q[j] * (i - j) * (i - j) FOR j IN range(1, len(q) + 1)]) FOR i IN range(1, len(p) + 1)])) AS w FROM {DIST}", "w")
query("stat_bootstrap", lambda s, d: ST.bootstrap_ci(ev(s, d), KEY, "v", 100))

# Angles


def ang(s, d):
    return ev(s, d).select("k", "event_id", (TAU * (F.col("t") - F.floor(F.col("t") / 86400) * 86400) / 86400).alias("theta"))


query("circ_wrap", lambda s, d: ang(s, d).select("event_id", C.wrap(F.col("theta") * 3, -math.pi, math.pi).alias("w"), C.in_range(F.col("theta"), 5.5, 1.0).alias("night")), f"SELECT event_id, theta * 3 + {math.pi!r} - floor((theta * 3 + {math.pi!r}) / {TAU!r}) * {TAU!r} - {math.pi!r} AS w, theta >= 5.5 OR theta <= 1 AS night FROM ang", "w")
query("circ_diff", lambda s, d: bucketed_lag(ang(s, d), KEY, ["event_id"], ["theta"], 65536.0).select("event_id", C.difference(F.col("prev_theta"), F.col("theta"), True).alias("directed"), C.difference(F.col("prev_theta"), F.col("theta")).alias("undirected")), f"SELECT event_id, w AS directed, abs(w) AS undirected FROM (SELECT event_id, x + {math.pi!r} - floor((x + {math.pi!r}) / {TAU!r}) * {TAU!r} - {math.pi!r} AS w FROM (SELECT event_id, theta - lag(theta) OVER (PARTITION BY k ORDER BY event_id) AS x FROM ang))", "directed undirected")
query("circ_moments", lambda s, d: C.moments(ang(s, d), KEY), f"""SELECT k, n, m - floor(m / {TAU!r}) * {TAU!r} AS mean, r, dispersion, c2 AS re2, s2 AS im2, sqrt(-2 * ln(r)) AS std, asin(least(1.0, 1.959963984540054 * sqrt(dispersion / n))) AS ci, ray AS rayleigh_s, exp(-ray / 2) AS rayleigh_p FROM (SELECT *, (1 - 1 / (2 * n)) * 2 * n * r * r + n * pow(r, 4) / 2 AS ray, (1 - sqrt(c2 * c2 + s2 * s2)) / (2 * r * r) AS dispersion FROM (SELECT *, sqrt(c * c + s * s) AS r, atan2(s, c) AS m FROM
(SELECT k, count(*) AS n, avg(cos(theta)) AS c, avg(sin(theta)) AS s, avg(cos(2 * theta)) AS c2, avg(sin(2 * theta)) AS s2 FROM ang GROUP BY k)))""", "mean r dispersion re2 im2 std ci rayleigh_s rayleigh_p")
query("circ_kuiper", lambda s, d: C.kuiper(ang(s, d), KEY), f"SELECT k, v, (8 * v * v - 2) * exp(-2 * v * v) AS p FROM (SELECT k, (max(u) - min(u) + 1 / any_value(n)) * (sqrt(any_value(n)) + 0.155 + 0.24 / sqrt(any_value(n))) AS v FROM (SELECT k, n, theta / {TAU!r} - (row_number() OVER (PARTITION BY k ORDER BY theta) - 1) / n AS u FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM ang)) GROUP BY k)", "v p")
query("circ_rank", lambda s, d: C.rank(ang(s, d), KEY).select("event_id", "rank"), f"SELECT event_id, {TAU!r} * (rank() OVER (PARTITION BY k ORDER BY theta) + (count(*) OVER (PARTITION BY k, theta) - 1) / 2) / count(*) OVER (PARTITION BY k) AS rank FROM ang", "rank")
query("circ_interval", lambda s, d: C.interval(ang(s, d), KEY), f"SELECT k, {TAU!r} - max(g) AS interval FROM (SELECT k, coalesce(lead(theta) OVER (PARTITION BY k ORDER BY theta), min(theta) OVER (PARTITION BY k) + {TAU!r}) - theta AS g FROM ang) GROUP BY k", "interval")
query("circ_hist", lambda s, d: C.histogram(ang(s, d), KEY), f"SELECT k, CAST(floor(theta / ({TAU!r} / 24) + 0.5) % 24 AS INT) AS bin, count(*) AS n FROM ang GROUP BY ALL")
query("circ_kde", lambda s, d: C.kde(ang(s, d), KEY), f"SELECT k, CAST(b AS INT) AS bin, avg(exp(5 * cos(theta - {TAU!r} * b / 24)) / ({TAU!r} * 27.239871823604442)) AS density FROM ang, range(24) t(b) GROUP BY ALL", "density")
query("circ_median", lambda s, d: C.median(ang(s, d), KEY), f"SELECT k, arg_min(a, struct_pack(c := c, a := a)) AS median FROM (SELECT p.k, p.theta AS a, round(avg(abs(p.theta - q.theta + {math.pi!r} - floor((p.theta - q.theta + {math.pi!r}) / {TAU!r}) * {TAU!r} - {math.pi!r})), 9) AS c FROM ang p JOIN ang q USING (k) GROUP BY ALL) GROUP BY k", "median", 5)
query("circ_regression", lambda s, d: K.circular_regression(ang(s, d).join(ev(s, d).select("event_id", "v"), "event_id"), KEY, "v", "theta", [j / 100 for j in range(-20, 21)]))

# Geometry

HEX = [(30.0, 0.02), (40.0, 0.04), (40.0, 0.08), (30.0, 0.1), (12.0, 0.08), (12.0, 0.03)]
PATH = [(0.0, 0.0), (10.0, 0.05), (30.0, 0.02), (50.0, 0.1)]
xy = lambda s, d: line(s, d).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
XY = "(SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount AS y FROM lineitem)"
query("geo_polar", lambda s, d: xy(s, d).select("l_orderkey", "l_linenumber", *G.cart2pol(F.col("x"), F.col("y"))), f"SELECT l_orderkey, l_linenumber, atan2(y, x) AS theta, sqrt(x * x + y * y) AS rho FROM {XY}", "theta rho")
query("geo_affine", lambda s, d: xy(s, d).select("l_orderkey", "l_linenumber", *G.Transform().scale((2.0, 3.0)).rotate(0.5, (1.0, 1.0)).translate((4.0, -2.0)).apply(F.col("x"), F.col("y"))), f"SELECT l_orderkey, l_linenumber, cos(0.5) * (2 * x - 1) - sin(0.5) * (3 * y - 1) + 5 AS x, sin(0.5) * (2 * x - 1) + cos(0.5) * (3 * y - 1) - 1 AS y FROM {XY}", "x y")
WIND = " + ".join(f"CASE WHEN y >= {y0} AND y < {y1} AND ({x1} - {x0}) * (y - {y0}) - (x - {x0}) * ({y1} - {y0}) > 0 THEN 1 WHEN y < {y0} AND y >= {y1} AND ({x1} - {x0}) * (y - {y0}) - (x - {x0}) * ({y1} - {y0}) < 0 THEN -1 ELSE 0 END" for x0, y0, x1, y1 in [tuple(f"{v!r}::DOUBLE" for v in e) for e in G.edges(HEX)])
query("geo_in_polygon", lambda s, d: xy(s, d).select("l_orderkey", "l_linenumber", G.in_polygon(F.col("x"), F.col("y"), HEX).alias("inside")), f"SELECT l_orderkey, l_linenumber, ({WIND}) <> 0 AS inside FROM {XY}")
query("geo_box", lambda s, d: xy(s, d).select("l_orderkey", "l_linenumber", G.Box("ellipse", (25.0, 0.05), (20.0, 0.06)).contains(F.col("x"), F.col("y")).alias("ellipse"), G.Box("rectangle", (25.0, 0.05), (19.0, 0.05)).contains(F.col("x"), F.col("y")).alias("rectangle")), f"SELECT l_orderkey, l_linenumber, pow((x - 25) / 10, 2) + pow((y - 0.05::DOUBLE) / 0.03::DOUBLE, 2) <= 1 AS ellipse, abs(x - 25) <= 9.5 AND abs(y - 0.05::DOUBLE) <= 0.025::DOUBLE AS rectangle FROM {XY}")
query("geo_polygon_area", lambda s, d: G.polygon_area(sig(s, d).select("k", "i", F.col("y").alias("x"), (F.col("i") % 13).cast("double").alias("y")), KEY, "i"), "SELECT k, sum(x * ny - nx * y) / 2 AS area FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM (SELECT k, i, y AS x, (i % 13)::DOUBLE AS y FROM sig) WINDOW w AS (PARTITION BY k ORDER BY i)) GROUP BY k", "area", 4)
query("geo_path_length", lambda s, d: G.path_length(sig(s, d).select("k", "i", F.col("i").cast("double").alias("x"), "y"), KEY, "i"), "SELECT k, sum(sqrt(1 + dy * dy)) AS length FROM (SELECT k, lead(y) OVER (PARTITION BY k ORDER BY i) - y AS dy FROM sig) GROUP BY k", "length", 4)
query("geo_bounding_box", lambda s, d: xy(s, d).join(line(s, d).select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber"]).groupBy("l_returnflag").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")), "SELECT l_returnflag, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_discount) AS y0, max(l_discount) AS y1 FROM lineitem GROUP BY ALL")
SIDES = " UNION ALL ".join(f"SELECT {i} AS edge, {x0}::DOUBLE AS x0, {y0}::DOUBLE AS y0, {x1}::DOUBLE AS x1, {y1}::DOUBLE AS y1, {sum(math.hypot(c - a, e - b) for a, b, c, e in G.edges(PATH, False)[:i])!r}::DOUBLE AS before" for i, (x0, y0, x1, y1) in enumerate(G.edges(PATH, False)))
query("geo_point_to_polyline", lambda s, d: xy(s, d).withColumn("n", G.point_to_polyline(F.col("x"), F.col("y"), PATH)).select("l_orderkey", "l_linenumber", F.abs("n.distance").alias("distance"), "n.along_path").distinct(), f"""SELECT l_orderkey, l_linenumber, min(dd) AS distance, arg_min(b * len + before, struct_pack(d := dd, e := edge)) AS along_path FROM (SELECT *, sqrt(pow(x - x0 - b * (x1 - x0), 2) + pow(y - y0 - b * (y1 - y0), 2)) AS dd FROM (SELECT *, greatest(0.0, least(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (len * len))) AS b FROM (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS len FROM (SELECT DISTINCT * FROM {XY}) CROSS JOIN ({SIDES})))) GROUP BY l_orderkey, l_linenumber, x, y""", "distance along_path", 5)
query("geo_shortest_paths", lambda s, d: G.shortest_paths(table(s, d, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").cast("int").alias("r")).withColumn("b", F.pmod(F.col("a") * 2 + 1, F.lit(25)).cast("int")).select("a", "b", (F.col("r") + 1.0).alias("length")), s.range(1).select(F.lit(0).alias("node"))).select("node", "distance"), """SELECT node, min(distance) AS distance FROM (WITH RECURSIVE l AS (SELECT n_nationkey AS a, CAST((n_nationkey * 2 + 1) % 25 AS INT) AS b, n_regionkey + 1.0::DOUBLE AS length FROM nation), g AS (SELECT * FROM l UNION ALL SELECT b, a, length FROM l),
p(node, distance, hops) AS (SELECT 0, 0.0::DOUBLE, 0 UNION ALL SELECT * FROM (SELECT g.b, min(p.distance + g.length), any_value(p.hops) + 1 FROM p JOIN g ON p.node = g.a WHERE p.hops < 24 GROUP BY g.b)) SELECT * FROM p) GROUP BY node""", "distance")

# Utilities

query("util_in_range", lambda s, d: ev(s, d).filter(ST.in_range(F.col("v"), 20.0, 80.0) & ~ST.in_range(F.col("v"), 60.0, 40.0)).select("event_id"), "SELECT event_id FROM ev WHERE v BETWEEN 20 AND 80 AND NOT (v >= 60 OR v <= 40)")
query("util_natural_sort", lambda s, d: table(s, d, "customer").select("c_custkey", ST.natural_key(F.concat(F.lit("c0"), F.col("c_custkey").cast("string"), F.lit("_b"))).alias("key")), "SELECT c_custkey, 'c' || lpad(CAST(length(CAST(c_custkey AS VARCHAR)) AS VARCHAR), 10, '0') || ':' || c_custkey || '_b' AS key FROM customer")
query("util_map_zip", lambda s, d: table(s, d, "nation").select("n_nationkey", F.map_zip_with(F.create_map(F.lit("a"), "n_nationkey"), F.create_map(F.lit("a"), F.col("n_regionkey"), F.lit("b"), F.lit(1)), lambda k, x, y: F.coalesce(x, F.lit(-1)) + F.coalesce(y, F.lit(-1))).alias("m")).select("n_nationkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b")), "SELECT n_nationkey, CAST(n_nationkey + n_regionkey AS INT) AS a, 0 AS b FROM nation")
query("util_range_join_left", lambda s, d: range_join(ev(s, d), S.merge(Cq(s, d), KEY), KEY, 700.0, how="left").select("event_id", "start", "stop"), f"SELECT event_id, m.start, m.stop FROM ev LEFT JOIN {M('c')} m ON m.k = ev.k AND t >= m.start AND t < m.stop", SS)
query("io_ttl_pulses", lambda s, d: B.ttl_pulses(table(s, d, "nlx_event"), ["session_id"], 6), """SELECT session_id, port, timestamp AS start_us, nt AS stop_us FROM (SELECT *, lead(timestamp) OVER w AS nt FROM (SELECT *, lag(o, 1, false) OVER w AS p FROM (SELECT session_id, rec_id, timestamp, CAST(regexp_extract(eventstring, 'port (\\d+)', 1) AS INT) AS port, (CAST('0x' || regexp_extract(eventstring, '\\(0x([0-9A-Fa-f]+)\\)', 1) AS INT) & 64) <> 0 AS o FROM nlx_event WHERE timestamp IS NOT NULL AND regexp_matches(eventstring, 'TTL Input on (\\S+) board (\\d+) port (\\d+) value \\((0x[0-9A-Fa-f]+)\\)'))
WINDOW w AS (PARTITION BY session_id, port ORDER BY timestamp, rec_id)) WHERE o <> p WINDOW w AS (PARTITION BY session_id, port ORDER BY timestamp, rec_id)) WHERE o AND nt - timestamp > 50000""")
query("io_expand_samples", lambda s, d: B.expand_samples(table(s, d, "nlx_csc"), 1.0, False, 2047).groupBy("session_id", "channelnumber").agg(F.count("y").alias("n"), F.sum(F.col("y").cast("long")).alias("total")), "SELECT session_id, channelnumber, count(v) FILTER (abs(v) < 2047) AS n, CAST(sum(v) FILTER (abs(v) < 2047) AS BIGINT) AS total FROM (SELECT session_id, channelnumber, unnest([CAST(x AS INT) FOR x IN signal[1:numvalidsamples]]) AS v FROM nlx_csc WHERE samplefreq > 0) GROUP BY ALL")

# Kernels (rows only)

query("fir_filter", lambda s, d: K.filter_signal(sig(s, d), KEY, K.fir((0.05, 0.2), 1.0), 512))
query("envelope", lambda s, d: K.envelope(emb(s, d), ["vec_id"], "x", 1.0))
query("contrast_bands", lambda s, d: K.contrast_bands(emb(s, d), ["vec_id"], "x", 64.0, (8.0, 14.0), [(2.0, 6.0), (18.0, 26.0)]))
query("decimate", lambda s, d: K.decimate(K.arrays(sig(s, d), KEY), KEY, "samples", 8))
query("interpolate", lambda s, d: K.interpolate(emb(s, d), ["vec_id"], "x", 3))
query("resample", lambda s, d: K.resample(emb(s, d), ["vec_id"], "x", 100))
query("mtspectrum", lambda s, d: K.spectrum(emb(s, d), ["vec_id"], "x", 64.0))
query("mtspectrogram", lambda s, d: K.spectrogram(K.arrays(sig(s, d), KEY), KEY, "samples", 1.0, 128, 64))
query("mtcoherence", lambda s, d: K.coherence(emb(s, d).join(emb(s, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id"), ["vec_id"], "x", "y", 64.0))
query("radon_fit_line", lambda s, d: K.fit_line(emb(s, d).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("x", r * 8 + 1, 8)).alias("image")), ["vec_id"]))
