"""Queries of the data-quality operators in the core (units, spikes, intervals, regular grid)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.islands import periods_and_gaps
from pulsegrid.operators.outliers import coordinate_outliers, signal_outliers
from pulsegrid.operators.quantities import bit_volts
from pulsegrid.operators.regrid import counter_increments, distribute, mark_uncovered
from pulsegrid.plans.ordered import scan
from pulsegrid.session import table

CONTINUOUS = ("CSC", "NCS")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Sub-channel values that are not recorded in volts per bit, in picovolts per bit, signed by InputInverted."""
    found = bit_volts(table(spark, d, "nlx_header")).filter(~F.col("native"))
    return found.select("header_id", "sub_channel", F.round("pv_per_bit").try_cast("long").alias("pv_per_bit"))


def p1_all(spark: SparkSession, d: str) -> DataFrame:
    """Every readable sub-channel value in picovolts per bit, with the unit it was recorded in."""
    return bit_volts(table(spark, d, "nlx_header")).select("header_id", "sub_channel", "unit", F.round("pv_per_bit").try_cast("long").alias("pv_per_bit"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Implausible coordinates and signal records."""
    coordinates = coordinate_outliers(table(spark, d, "mwl_diode"), table(spark, d, "recordings"))
    signals = signal_outliers(table(spark, d, "nlx_csc"), channel_headers(spark, d))
    return coordinates.unionByName(signals)


def channel_headers(spark: SparkSession, d: str) -> DataFrame:
    """One row per continuous channel: session_id, channelnumber, samplingfrequency, admaxvalue (of its first loaded header that has them)."""
    h = table(spark, d, "nlx_header").filter(F.upper("filetype").isin(*CONTINUOUS) & F.col("channelnumber").isNotNull())
    rate = F.when(F.col("samplingfrequency") > 0, F.col("samplingfrequency"))
    return h.groupBy("session_id", "channelnumber").agg(F.min_by(rate, F.when(rate.isNotNull(), F.col("header_id"))).alias("rate"), F.min_by("admaxvalue", F.when(F.col("admaxvalue").isNotNull(), F.col("header_id"))).alias("admax"))


START, STOP = ("start", "begin", "onset", "on"), ("stop", "end", "offset", "off")


def epoch_markers(events: DataFrame) -> DataFrame:
    """Records that start or stop an epoch: session_id, epoch, is_start, label (null if not written), t.

    A marker has the word epoch, one number, one starting or stopping word and at most one more word, its label.
    """
    words = F.regexp_extract_all(F.lower(F.translate("eventstring", "\0", " ")), F.lit(r"[\p{L}]+|\d+"), 0)
    e = events.filter(F.col("timestamp").isNotNull() & F.lower("eventstring").contains("epoch")).select("session_id", F.col("timestamp").alias("t"), words.alias("w"))
    digits = F.filter("w", lambda x: x.rlike(r"^\d+$"))
    verbs = F.filter("w", lambda x: x.isin(*START, *STOP))
    rest = F.filter("w", lambda x: ~x.rlike(r"^\d+$") & ~x.isin("epoch", "of", *START, *STOP))
    e = e.withColumns({"n": digits, "v": verbs, "r": rest}).filter("size(n) = 1 and size(v) = 1 and size(r) <= 1 and array_contains(w, 'epoch')")
    return e.select("session_id", F.expr("try_cast(n[0] as bigint)").alias("epoch"), F.col("v")[0].isin(*START).alias("is_start"), F.try_element_at("r", F.lit(1)).alias("label"), "t").filter("epoch is not null")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Epochs per recording and label as continuous periods and the gaps between them."""
    m = epoch_markers(table(spark, d, "nlx_event"))
    labelled = F.when(F.col("is_start") & F.col("label").isNotNull(), F.col("t"))
    epochs = m.groupBy("session_id", "epoch").agg(
        F.min_by("label", labelled).alias("label"), F.min(F.when(F.col("is_start"), F.col("t"))).alias("start_us"), F.max(F.when(~F.col("is_start"), F.col("t"))).alias("stop_us")
    )
    return periods_and_gaps(epochs.filter("label is not null"), ["session_id", "label"], "start_us", "stop_us")


def channel_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every continuous channel on its regular grid: session_id, channelnumber, slot, amount (valid samples), covered, filled.

    The channel's counter is the number of valid samples delivered so far, read at the end of each record, in slots since the
    channel's first record; it starts anew where the acquisition does (records counted again from 0 are a reset). Each increment
    is spread over the slots that its record's time overlaps; a slot that a record covers for the most part is filled.
    """
    keys = ["session_id", "channelnumber"]
    records = table(spark, d, "nlx_csc").filter("timestamp is not null").select(*keys, "timestamp", "rec_id", F.coalesce("numvalidsamples", F.lit(0)).alias("valid"))
    origin = records.groupBy(*keys).agg(F.min("timestamp").alias("t0"))
    rate = channel_headers(spark, d).filter("rate is not null").select(*keys, "rate")
    at = (F.col("timestamp") - F.col("t0")) * F.col("rate") / F.lit(512e6)
    timed = records.join(origin.join(rate, keys), keys).select(*keys, "rec_id", "valid", at.alias("begin"), (at + 1).alias("end"))
    readings = scan(timed, keys, ["begin", "rec_id"], 4096, counter=("sum", "valid"))
    cells = distribute(counter_increments(readings, keys, "end", "counter", 4096, max_span=F.lit(1.0), begins="begin"), keys, F.lit(0), F.lit(1))
    return mark_uncovered(cells, keys, first=0).withColumnRenamed("cell", "slot")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Slots of a continuous channel's regular series that no record fills."""
    return channel_grid(spark, d).filter("not filled").select("session_id", "channelnumber", "slot")


def p5_series(spark: SparkSession, d: str) -> DataFrame:
    """The regular series of every continuous channel: valid samples by proportional overlap, share covered, null and 0 where nothing is."""
    return channel_grid(spark, d).select("session_id", "channelnumber", "slot", F.round("amount", 6).alias("amount"), F.round("covered", 6).alias("covered"))


P1_SQL = r"""
WITH h AS (SELECT header_id, admaxvalue, headertext AS raw,
       CASE WHEN regexp_matches(adbitvolts, '\d') THEN adbitvolts ELSE nullif(trim(regexp_extract(headertext, '(?im)^-ADBitVolts[ \t]+([^\r\n]*)', 1)), '') END AS txt,
       CASE WHEN regexp_matches(inputrange, '\d') THEN inputrange ELSE nullif(trim(regexp_extract(headertext, '(?im)^-InputRange[ \t]+([^\r\n]*)', 1)), '') END AS ranges,
       coalesce(nullif(regexp_extract(headertext, '(?im)^-ADBitVoltsUnits[ \t]+([^\r\n]*)', 1), ''), nullif(regexp_extract(headertext, '(?im)^#[^\r\n]*\bin ((?:milli|micro|nano)?volts?)', 1), '')) AS noted,
       coalesce(lower(trim(inputinverted)), '') IN ('true', 't', 'yes', 'y', '1', 'on', 'inverted') AS inverted FROM nlx_header),
parts AS (SELECT *, CASE WHEN txt LIKE '%;%' THEN string_split(txt, ';') ELSE regexp_extract_all(txt, '[0-9]+(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?') END AS p,
       CASE WHEN txt LIKE '%;%' THEN NULL ELSE nullif(trim(regexp_extract(txt, '[0-9]\s*([a-zA-Zµμ][^0-9]*)$', 1)), '') END AS last_unit FROM h WHERE regexp_matches(txt, '\d')),
e AS (SELECT *, unnest(p) AS q, generate_subscripts(p, 1) - 1 AS sub_channel FROM parts),
v AS (SELECT *, CAST(replace(regexp_extract(q, '[0-9]+(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?'), ',', '.') AS DOUBLE) AS num,
       lower(coalesce(last_unit, nullif(trim(regexp_extract(q, '[0-9]\s*([a-df-zA-DF-Zµμ].*)$', 1)), ''), noted)) AS unit,
       CAST(list_extract(regexp_extract_all(ranges, '[0-9]+'), CASE WHEN len(regexp_extract_all(ranges, '[0-9]+')) = 1 THEN 1 ELSE sub_channel + 1 END) AS DOUBLE) AS span FROM e),
u AS (SELECT *, CASE WHEN unit LIKE 'milli%' OR unit LIKE 'mv%' THEN 3 WHEN unit LIKE 'micro%' OR unit LIKE 'uv%' OR unit LIKE 'µv%' OR unit LIKE 'μv%' THEN 6 WHEN unit LIKE 'nano%' OR unit LIKE 'nv%' THEN 9 WHEN unit IS NOT NULL THEN 0
       ELSE coalesce(3 * least(3, greatest(0, CAST(round(log10(num * admaxvalue / (coalesce(span, 1200) * 1e-6)) / 3) AS INT))), 0) END AS down FROM v)
SELECT CAST(header_id AS BIGINT) AS header_id, CAST(sub_channel AS INT) AS sub_channel, CAST(round(num * pow(10, 12 - down)) AS BIGINT) * CASE WHEN inverted THEN -1 ELSE 1 END AS pv_per_bit FROM u WHERE down > 0
"""

P4_SQL = r"""
WITH w AS (SELECT session_id, timestamp AS t, regexp_extract_all(lower(replace(eventstring, chr(0), ' ')), '[a-z]+|[0-9]+') AS w FROM nlx_event WHERE timestamp IS NOT NULL AND lower(eventstring) LIKE '%epoch%'),
m AS (SELECT session_id, t, [x FOR x IN w IF regexp_matches(x, '^[0-9]+$')] AS n, [x FOR x IN w IF x IN ('start', 'begin', 'onset', 'on', 'stop', 'end', 'offset', 'off')] AS v,
      [x FOR x IN w IF regexp_matches(x, '^[a-z]') AND x NOT IN ('epoch', 'of', 'start', 'begin', 'onset', 'on', 'stop', 'end', 'offset', 'off')] AS r FROM w),
k AS (SELECT session_id, t, CAST(n[1] AS BIGINT) AS epoch, v[1] IN ('start', 'begin', 'onset', 'on') AS s, r[1] AS label FROM m WHERE len(n) = 1 AND len(v) = 1 AND len(r) <= 1),
e AS (SELECT session_id, arg_min(label, t) FILTER (s AND label IS NOT NULL) AS label, min(t) FILTER (s) AS a, max(t) FILTER (NOT s) AS z FROM k GROUP BY session_id, epoch HAVING min(t) FILTER (s) <= max(t) FILTER (NOT s)),
p AS (SELECT *, max(z) OVER (PARTITION BY session_id, label ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pz FROM e WHERE label IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN pz IS NULL OR a > pz THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, label ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS i FROM p)
SELECT session_id, label, 'period' AS kind, min(a) AS start_us, max(z) AS stop_us FROM g GROUP BY session_id, label, i
UNION ALL SELECT session_id, label, 'gap', pz, a FROM p WHERE a > pz
"""

P5_SQL = """
WITH h AS (SELECT session_id, channelnumber, max(samplingfrequency) AS f FROM nlx_header WHERE filetype IN ('CSC', 'NCS') AND samplingfrequency > 0 GROUP BY ALL),
s AS (SELECT DISTINCT c.session_id, c.channelnumber, CAST(floor((timestamp - min(timestamp) OVER (PARTITION BY c.session_id, c.channelnumber)) * f / 512e6 + 0.5) AS BIGINT) AS slot FROM nlx_csc c JOIN h USING (session_id, channelnumber) WHERE timestamp IS NOT NULL),
g AS (SELECT session_id, channelnumber, unnest(generate_series(0, max(slot))) AS slot FROM s GROUP BY session_id, channelnumber)
SELECT CAST(session_id AS BIGINT) AS session_id, channelnumber, slot FROM g ANTI JOIN s USING (session_id, channelnumber, slot)
"""

P5_SERIES_SQL = """
WITH h AS (SELECT session_id, channelnumber, arg_min(samplingfrequency, header_id) AS f FROM nlx_header WHERE upper(filetype) IN ('CSC', 'NCS') AND samplingfrequency > 0 GROUP BY ALL),
s AS (SELECT c.session_id, c.channelnumber, coalesce(numvalidsamples, 0) AS v, (timestamp - min(timestamp) OVER (PARTITION BY c.session_id, c.channelnumber)) * f / 512e6 AS a FROM nlx_csc c JOIN h USING (session_id, channelnumber) WHERE timestamp IS NOT NULL),
e AS (SELECT session_id, channelnumber, unnest([CAST(floor(a) AS BIGINT), CAST(floor(a) AS BIGINT) + 1]) AS slot, a, v FROM s),
p AS (SELECT *, least(a + 1, slot + 1) - greatest(a, slot) AS part FROM e),
c AS (SELECT session_id, channelnumber, slot, sum(v * part) AS amount, sum(part) AS covered, max(CASE WHEN a <= slot THEN part >= 0.5 ELSE part > 0.5 END) AS filled FROM p WHERE part > 0 GROUP BY ALL),
g AS (SELECT session_id, channelnumber, unnest(generate_series(0, max(slot) FILTER (filled))) AS slot FROM c GROUP BY session_id, channelnumber)
SELECT CAST(session_id AS BIGINT) AS session_id, channelnumber, slot, round(amount, 6) AS amount, round(coalesce(covered, 0), 6) AS covered FROM g LEFT JOIN c USING (session_id, channelnumber, slot)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_all, p3_found, p4_found, p5_found, p5_series)}
ORACLES: dict[str, str] = {"p1_found": P1_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL, "p5_series": P5_SERIES_SQL}
