"""Units, spikes, intervals and grids against brute force, with nulls, repeats, ties, empty tables and clashing columns."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.units import UnitError, convert, parse_quantities, parse_unit
from pulsegrid.operators.islands import periods_and_gaps
from pulsegrid.operators.outliers import NORMAL, SIGMAS, coordinate_outliers, hampel, signal_away, signal_outliers
from pulsegrid.operators.quantities import bit_volts
from pulsegrid.operators.regrid import counter_increments, distribute, mark_uncovered
from pulsegrid.plans.ordered import bucketed_lag, bucketed_rank, chunk_with_halo


def test_unit_grammar():
    assert parse_unit("kg m^2/s^3").exponents == parse_unit("W").exponents
    assert parse_unit("μV per bit") == parse_unit("uV/bit") == parse_unit("microvolts/bit")
    assert convert(Fraction(20), "degC", "K") == Fraction(29315, 100)
    assert convert(Fraction(1), "nV", "pV/bit") == 1000 and convert(Fraction(1), "m", "s") is None
    for bad in ("", "foo", "V/", "(V", "V^"):
        with pytest.raises(UnitError):
            parse_unit(bad)


def test_quantity_lists():
    assert parse_quantities("1,5 2e-1 3 uV") == [(Fraction(3, 2), "uV"), (Fraction(1, 5), "uV"), (Fraction(3), "uV")]
    assert parse_quantities("1 uV; 2 nV") == [(Fraction(1), "uV"), (Fraction(2), "nV")]
    assert parse_quantities("1 n/a 3")[1] == (None, None) and parse_quantities(None) == [] and parse_quantities(" \0") == []


def test_bit_volts(spark):
    schema = "header_id long, adbitvolts string, headertext string, admaxvalue int, inputrange string, inputinverted string, unit string"
    rows = [
        (1, "0.061 uV", None, 32767, "2000", "True", "x"), (2, "0.000000061", "", 32767, "2000", "", "x"), (3, None, "-ADBitVolts 61.0\r\n-ADBitVoltsUnits nV", 32767, None, None, "x"),
        (4, "n/a", None, None, None, None, None), (5, "6.1E-2 3.05e-2", "## note: bit values are given in microvolts", 32767, "2000 1000", "no", None), (6, "61 ? 30", None, 32767, "2000 1500 1000", "yes", None), (7, "61", None, None, None, "0", None),
    ]
    got = {(r.header_id, r.sub_channel): (int(r.pv_per_bit), r.native) for r in bit_volts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 0): (-61000, False), (2, 0): (61000, True), (3, 0): (61000, False), (5, 0): (61000, False), (5, 1): (30500, False), (6, 0): (-61000, False), (6, 2): (-30000, False), (7, 0): (61 * 10**12, True)}
    assert bit_volts(spark.createDataFrame([], schema)).count() == 0


def test_ordered_plans(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), int(t)) for k, t in zip(rng.choice([1, 1, 1, 2, 3], 800), rng.integers(0, 500, 800))]
    df = spark.createDataFrame(rows, "k int, t int").withColumn("id", F.monotonically_increasing_id())
    got = bucketed_lag(bucketed_rank(df, ["k"], ["t", "id"], 20), ["k"], ["t", "id"], ["id"], 20).collect()
    for k in (1, 2, 3):
        own = sorted((r for r in got if r.k == k), key=lambda r: (r.t, r.id))
        assert [r._rank for r in own] == list(range(len(own))) and [r.prev_id for r in own] == [None, *[r.id for r in own[:-1]]]
    chunks = chunk_with_halo(spark.range(10).select(F.col("id").alias("_rank")), "_rank", 4, 2).groupBy("_chunk").agg(F.array_sort(F.collect_list("_rank")).alias("r")).collect()
    assert {c._chunk: c.r for c in chunks if c._chunk < 3} == {0: [0, 1, 2, 3, 4, 5], 1: [2, 3, 4, 5, 6, 7, 8, 9], 2: [6, 7, 8, 9]}


def brute_islands(rows):
    out = []
    for k in {r[0] for r in rows}:
        own = sorted((a, z) for q, a, z in rows if q == k and a is not None and z is not None and z >= a)
        merged = []
        for a, z in own:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        out += [(k, "period", a, z) for a, z in merged] + [(k, "gap", p[1], q[0]) for p, q in zip(merged, merged[1:])]
    return sorted(out, key=str)


def test_islands(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if rng.random() < 0.6 else str(rng.integers(5)), int(a), int(a + d)) for a, d in zip(rng.integers(0, 3000, 600), rng.integers(0, 9, 600))]
    rows += [("hot", 0, 1500), ("n", None, 5), ("n", 5, None), ("n", 9, 3), (None, 1, 2), (None, 2, 3), *rows[:20]]
    df = spark.createDataFrame(rows, "k string, start long, stop long").withColumn("island", F.lit("clash"))
    got = sorted(((r.k, r.kind, r.start, r.stop) for r in periods_and_gaps(df.repartition(7), ["k"]).collect()), key=str)
    assert got == brute_islands(rows)
    assert periods_and_gaps(df.limit(0), ["k"]).count() == 0


def test_grid(spark):
    readings = spark.createDataFrame([(1, 0, 10.0), (1, 10, 20.0), (1, 25, 5.0), (1, 40, 5.0), (1, None, 7.0), (2, 3, 1.0)], "k int, t int, c double")
    inc = counter_increments(readings, ["k"], "t", "c", 16)
    assert sorted((r.t0, r.t1, r.amount, r.reset) for r in inc.collect()) == [(0, 10, 10.0, False), (10, 25, 5.0, True), (25, 40, 0.0, False)]
    cells = distribute(inc, ["k"], F.lit(0), F.lit(10))
    got = {r.cell: (round(r.amount, 6), round(r.covered, 6)) for r in cells.collect()}
    assert got == {0: (10.0, 1.0), 1: (3.333333, 1.0), 2: (1.666667, 1.0), 3: (0.0, 1.0)}
    short = distribute(counter_increments(readings, ["k"], "t", "c", 16, max_span=F.lit(5)), ["k"], F.lit(0), F.lit(5))
    marked = {r.cell: r.covered for r in mark_uncovered(short.filter("k = 1"), ["k"], block=2, first=0).collect()}  # every increment fills its cell
    assert [c for c in sorted(marked) if marked[c] == 0] == [0, 2, 3, 5, 6]
    assert mark_uncovered(short.limit(0), ["k"]).count() == 0


def test_increments_with_a_known_beginning(spark):
    """Uneven readings that overlap: each is spread over its own time; halves go to the cell that they begin before."""
    readings = spark.createDataFrame([(1, 0.0, 1.0, 8), (1, 1.25, 2.25, 16), (1, 2.5, 3.5, 20), (1, 5.5, 6.5, 2)], "k int, a double, z double, c long")
    inc = counter_increments(readings, ["k"], "z", "c", 16, max_span=F.lit(1.0), begins="a")
    assert sorted((r.t0, r.amount, r.reset) for r in inc.collect()) == [(0.0, 8.0, False), (1.25, 8.0, False), (2.5, 4.0, False), (5.5, 2.0, True)]
    got = {r.cell: (r.amount, r.covered, r.filled) for r in mark_uncovered(distribute(inc, ["k"], F.lit(0), F.lit(1)), ["k"], first=0).collect()}
    assert got == {0: (8.0, 1.0, True), 1: (6.0, 0.75, True), 2: (4.0, 0.75, False), 3: (2.0, 0.5, True), 4: (None, 0.0, False), 5: (1.0, 0.5, False), 6: (1.0, 0.5, True)}


def test_hampel():
    x = np.array([0, 10, 20, 30, 40, 50, 400, 70, 80, 90, 100, 110, 120, 130.0])
    assert np.flatnonzero(hampel(x, 5.0)).tolist() == [6]  # a path that moves has a spread of its own
    flat = np.array([5.0] * 8 + [9.0] + [5.0] * 8)
    assert np.flatnonzero(hampel(flat, 3.0)).tolist() == [8] and not hampel(flat, 4.0).any()  # at rest the floor decides
    assert not hampel(np.array([1.0]), 1.0).any() and len(hampel(np.array([]), 1.0)) == 0


DIODE = "rec_id long, session_id long, timestamp long, xfront short, yfront short, t string"


def test_coordinates(spark):
    rng = np.random.default_rng(2)
    x = np.clip(300 + np.cumsum(rng.integers(-6, 7, 2000)), 60, 580)
    case = set()
    x[500:503] += 200
    case |= {500, 501, 502}
    x[900:] = np.clip(x[900:] + 150, 0, 639)  # a move that lasts
    x[1200:1260] = x[1200]
    case |= set(range(1200, 1260))
    x[1500], x[1600] = -1, 5000
    case |= {1500, 1600}
    rows = [(i, 1, 333 * i, int(v), 100 + i % 3, "c") for i, v in enumerate(x)]
    rows += [(5000, 1, None, 9999, 5, None), (5001, 1, 333 * 501, int(x[501]), 100, None), (5002, 1, 77, None, None, None), (5003, 9, 77, 30000, 3, None)]
    rec = spark.createDataFrame([(1, 640, 480), (2, None, None)], "session_id long, frame_w int, frame_h int")
    got = {(r.rec_id, r.field) for r in coordinate_outliers(spark.createDataFrame(rows, DIODE), rec).collect()}
    first = 1200
    while x[first - 1] == x[first]:
        first -= 1
    last = 1259
    while x[last + 1] == x[last]:
        last += 1
    assert got == {(i, "xfront") for i in case | set(range(first, last + 1))} | {(5001, "xfront")}
    assert coordinate_outliers(spark.createDataFrame([], DIODE), rec).count() == 0


def test_stuck_across_chunks(spark, monkeypatch):
    from pulsegrid.operators import outliers

    monkeypatch.setattr(outliers, "CHUNK", 64)
    monkeypatch.setattr(outliers, "HALO", 16)
    rng = np.random.default_rng(3)
    x = 200 + np.abs(np.arange(600) % 100 - 50) + rng.integers(0, 3, 600)
    x[100:300] = 111
    rows = [(i, 1, 333 * i, int(v), None, "c") for i, v in enumerate(x)]
    rec = spark.createDataFrame([(1, 640, 480)], "session_id long, frame_w int, frame_h int")
    got = {r.rec_id for r in coordinate_outliers(spark.createDataFrame(rows, DIODE), rec).collect()}
    assert set(range(100, 300)) <= got and len(got - set(range(95, 305))) == 0


def test_signals(spark):
    rng = np.random.default_rng(4)
    base = [(i, 1, 3, 8, [int(v) for v in rng.integers(-9, 10, 8)], None) for i in range(20)]
    odd = [(20, 1, 3, 8, [1, 2, 3, 500, 2, 1, 0, 1], None), (21, 1, 3, 8, [5] * 8, 7), (22, 1, 3, 8, [-2047] + [1, 2, 3, 4, 5, 6, 7], 1), (23, 1, 3, 3, [1, 2, 3, 9000, 9000, 0, 0, 0], 1), (24, 1, 3, 0, [9000] * 8, 1), (25, 1, 3, None, None, 1)]
    df = spark.createDataFrame(base + odd, "rec_id long, session_id long, channelnumber int, numvalidsamples int, signal array<smallint>, timestamp long")
    ch = spark.createDataFrame([(1, 3, 2047)], "session_id long, channelnumber int, admax int")
    assert {r.rec_id for r in signal_outliers(df, ch).collect()} == {20, 21, 22}
    assert signal_outliers(df.limit(0), ch).count() == 0


def test_signal_away():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 20, 21, 64):
        x = rng.integers(-9, 10, (5, n)).astype(np.int32)
        x[:, n // 3 : n // 3 + 3] += 900
        width = min(21, n - 1 + n % 2)
        for row, got in zip(x, signal_away(x)):
            want = 0.0
            for i, v in enumerate(row):
                a = min(max(i - width // 2, 0), n - width)
                median = np.median(row[a : a + width])
                mad = NORMAL * np.median(np.abs(row[a : a + width] - median))
                want = max(want, abs(median), mad, abs(v - median) if abs(v - median) > SIGMAS * mad else 0)
            assert got == pytest.approx(want)


def test_signals_off_their_path(spark):
    """A sample is held against the record's own path: its rolling median, and its rolling MAD."""
    rng = np.random.default_rng(6)
    noise = lambda n=200: rng.integers(-9, 10, n)
    records = {i: noise() for i in range(30)}  # usual spread 5.5, so the floor is 55
    records[100] = noise() - 35
    records[100][90:93] = 35  # within 55 of zero, 70 off the path
    records[101] = noise()
    records[101][:4] = 90  # at the edge of the record
    records[102] = noise()
    records[102][50:90] = 90  # the median follows it
    records[103] = noise()
    records[103][50:90] = [90, -90] * 20  # the MAD does
    records[104] = (50 * np.sin(np.arange(200) / 9)).astype(int)  # a wave within the floor
    records[105] = np.array([60, 30, 0, -30, -60] * 40)  # its own spread is wide: no few samples are off it
    rows = [(i, 1, 3, len(v), [int(k) for k in v]) for i, v in records.items()] + [(200, 1, 3, 4, [1, None, 2, 900]), (201, 1, 3, 2, [None, None])]
    df = spark.createDataFrame(rows, "rec_id long, session_id long, channelnumber int, numvalidsamples int, signal array<smallint>")
    ch = spark.createDataFrame([(1, 3, 2047)], "session_id long, channelnumber int, admax int")
    assert {r.rec_id for r in signal_outliers(df, ch).collect()} == {100, 101, 102, 103, 200}
