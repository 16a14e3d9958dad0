"""Implausible readings: physical bounds, a Hampel filter against each source's own path, and stuck values.

Series are cut by position into chunks with a halo (``plans.ordered``), so a long recording is spread over tasks; within a
chunk a vectorised kernel takes the rolling median. Stuck stretches that cross chunks are joined by their boundary runs.
Signal records are filtered where they lie; only a row of facts a record is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.plans.ordered import bucketed_rank, chunk_with_halo
from pulsegrid.session import frozen

#: Half width of the rolling window, in readings: over twice the longest excursion, so an excursion never is the median.
HALF = 6
#: Longest excursion that returns, the factor over the ordinary change, the least stuck stretch, the factor over the longest ordinary stretch.
LONGEST, FACTOR, STUCK, TWICE = 5, 10.0, 30, 2.0
#: Hampel filter: times the rolling median absolute deviation, scaled to a normal spread. The floor for resting sources is FACTOR ordinary changes.
SIGMAS, NORMAL = 2.0, 1.4826
#: Half width of the rolling window of a signal, in samples, and records that the kernel takes at once.
SIGNAL_HALF, BLOCK = 10, 16

FACTS = "session_id long, field string, kind string, chunk long, part long, value double, n long, t0 long, t1 long"
FIELDS = ("xfront", "yfront")
CHUNK, HALO, BUCKET = 8192, 256, 1 << 17


def rolling_median(x: np.ndarray, half: int) -> np.ndarray:
    """Centred rolling median; at the ends the window shrinks to what is there."""
    n = len(x)
    out = np.empty(n)
    if n > 2 * half:
        out[half : n - half] = np.median(sliding_window_view(x, 2 * half + 1), axis=1)
    for i in {*range(min(half, n)), *range(max(0, n - half), n)}:
        out[i] = np.median(x[max(0, i - half) : i + half + 1])
    return out


def hampel(x: np.ndarray, floor: float, half: int = HALF) -> np.ndarray:
    """Mask of the readings that differ from the rolling median by over SIGMAS scaled rolling MADs, and by over ``floor``.

    A resting source has a MAD of 0, and a wholly smooth path a small one, so the floor says what is ordinary there. The MAD is
    taken only where the floor is passed.
    """
    median = rolling_median(x, half)
    off = np.abs(x - median) > floor
    for i in np.flatnonzero(off):
        mad = np.median(np.abs(x[max(0, i - half) : i + half + 1] - median[i]))
        off[i] = abs(x[i] - median[i]) > SIGMAS * NORMAL * mad
    return off


def excursions(x: np.ndarray, floor: float) -> np.ndarray:
    """Mask of the readings that the Hampel filter finds off the path, for at most LONGEST readings with the path on both sides."""
    off = hampel(x, floor)
    edge = np.diff(np.concatenate([[0], off.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        if b - a > LONGEST or a == 0 or b == len(x):
            off[a:b] = False
    return off


def _chunk_facts(pdf: pd.DataFrame) -> pd.DataFrame:
    """What one chunk knows: its excursions, its run lengths, its long runs and the runs at its edges."""
    pdf = pdf.sort_values("_rank")
    session, chunk = int(pdf["session_id"].iloc[0]), int(pdf["_chunk"].iloc[0])
    rows: list[tuple] = []
    for field in FIELDS:
        valid = pdf[field].notna().to_numpy()
        x, t, core = pdf[field].to_numpy(float)[valid], pdf["t"].to_numpy(np.int64)[valid], pdf["_core"].to_numpy(bool)[valid]
        usual = pdf[f"usual_{field}"].iloc[0]
        if len(x) == 0:
            continue
        if pd.notna(usual):
            for i in np.flatnonzero(excursions(x, FACTOR * float(usual)) & core):
                rows.append((session, field, "away", chunk, 0, x[i], 1, t[i], t[i]))
        x, t = x[core], t[core]
        if len(x) == 0:
            continue
        heads = np.concatenate([[0], np.flatnonzero(np.diff(x) != 0) + 1])
        tails = np.concatenate([heads[1:], [len(x)]])
        last = len(heads) - 1
        for k in sorted({0, last, *np.flatnonzero(tails - heads >= STUCK).tolist()}):
            a, b = heads[k], tails[k]
            kind, part = ("edge", (1 if k == 0 else 2) if last else 0) if k in (0, last) else ("run", k)
            rows.append((session, field, kind, chunk, part, x[a], b - a, t[a], t[b - 1]))
        rows += [(session, field, "length", chunk, 0, None, n, None, None) for n in np.unique((tails - heads)[1:-1])]
    out = pd.DataFrame(rows, columns=["session_id", "field", "kind", "chunk", "part", "value", "n", "t0", "t1"])
    return out.astype({c: "Int64" for c in ("n", "t0", "t1")})


def ordinary_change(bucketed: DataFrame, share: float = 0.97) -> DataFrame:
    """Per recording and field the mean change between successive readings of a time bucket, up to the ``share`` quantile.

    Changes are counted by size first, so only the distinct sizes of a field meet in one window.
    """
    within = Window.partitionBy("session_id", "_bucket").orderBy("t")
    steps = bucketed.select("session_id", *[F.abs(F.col(f) - F.lag(f).over(within)).cast("long").alias(f) for f in FIELDS])
    long = steps.select("session_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("change")) for f in FIELDS])).alias("s"))
    sizes = long.filter("s.change is not null").groupBy("session_id", "s.field", "s.change").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("session_id", "field")
    ranked = sizes.withColumns({"_upto": F.sum("n").over(by.orderBy("change")), "_all": F.sum("n").over(by)})
    kept = F.when(F.col("_upto") - F.col("n") < F.col("_all") * share, F.col("n"))
    mean = F.sum(kept * F.col("change")) / F.sum(kept)
    usual = ranked.groupBy("session_id", "field").agg(mean.alias("usual"))
    return usual.groupBy("session_id").agg(*[F.max(F.when(F.col("field") == f, F.col("usual"))).alias(f"usual_{f}") for f in FIELDS])


def _stuck(facts: DataFrame) -> DataFrame:
    """Stretches of one value longer than twice the longest ordinary stretch: session_id, field, value, t0, t1.

    Ordinary lengths form the lower cluster of a field's run lengths: stuck ones begin at the first length of at least
    STUCK that is over TWICE the next smaller one. Only distinct lengths, and two runs a chunk, meet in one window.
    """
    by = Window.partitionBy("session_id", "field").orderBy("chunk", "part")
    fresh = F.when((F.lag("value").over(by) == F.col("value")) & (F.col("part") != 2), 0).otherwise(1)
    edges = facts.filter("kind = 'edge'").withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(by))
    joined = edges.groupBy("session_id", "field", "run", "value").agg(F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    runs = joined.select("session_id", "field", "value", "n", "t0", "t1").unionByName(facts.filter("kind = 'run'").select("session_id", "field", "value", "n", "t0", "t1"))
    lengths = runs.select("session_id", "field", "n").unionByName(facts.filter("kind = 'length'").select("session_id", "field", "n")).distinct()
    ordered = Window.partitionBy("session_id", "field").orderBy("n")
    jumps = lengths.withColumn("_less", F.lag("n", 1, 1).over(ordered)).filter((F.col("n") >= STUCK) & (F.col("n") > TWICE * F.col("_less")))
    cuts = jumps.groupBy("session_id", "field").agg(F.min("n").alias("_cut"))
    return runs.join(cuts, ["session_id", "field"]).filter("n >= _cut").select("session_id", "field", "value", "t0", "t1")


def coordinate_outliers(diode: DataFrame, recordings: DataFrame) -> DataFrame:
    """Implausible coordinates: rec_id, field; every delivery of a reading is a row of its own.

    A reading outside the camera frame; one that leaves the recording's path by over FACTOR times its ordinary change for at
    most LONGEST readings; one in a stretch of a single value that is stuck. Null timestamps and null coordinates take no
    part; readings delivered twice count once in windows and lengths; a recording without a known frame has no bounds. The
    path of a reading is what lies within HALO records. Empty inputs give no rows; other columns are ignored.
    """
    frames = recordings.groupBy("session_id").agg(F.max("frame_w").alias("w_xfront"), F.max("frame_h").alias("w_yfront"))
    base = diode.filter("timestamp is not null and session_id is not null").select("rec_id", "session_id", F.col("timestamp").alias("t"), *FIELDS)
    base = base.join(frames, "session_id", "left")
    inside = {f: F.coalesce((F.col(f) >= 0) & (F.col(f) < F.col(f"w_{f}")), F.lit(True)) for f in FIELDS}
    outside = base.select("rec_id", F.explode(F.array_compact(F.array(*[F.when(~inside[f], F.lit(f)) for f in FIELDS]))).alias("field"))
    valid = base.select("session_id", "t", *[F.when(inside[f], F.col(f)).alias(f) for f in FIELDS]).distinct()
    bucketed = valid.withColumn("_bucket", F.floor(F.col("t") / BUCKET))
    ranked = bucketed_rank(valid, ["session_id"], ["t", *FIELDS], BUCKET)
    ranked = ranked.join(ordinary_change(bucketed), "session_id", "left")
    chunks = chunk_with_halo(ranked, "_rank", CHUNK, HALO)
    facts = frozen(chunks.groupBy("session_id", "_chunk").applyInPandas(_chunk_facts, FACTS))
    flagged = facts.filter("kind = 'away'").select("session_id", "field", "value", "t0", "t1").unionByName(_stuck(facts))
    spans = flagged.withColumn("_b", F.explode(F.sequence(F.floor(F.col("t0") / BUCKET), F.floor(F.col("t1") / BUCKET))))
    values = F.when(F.col("field") == FIELDS[0], F.col(FIELDS[0])).otherwise(F.col(FIELDS[1]))
    rows = base.drop("w_xfront", "w_yfront").withColumn("_b", F.floor(F.col("t") / BUCKET))
    hits = rows.join(spans, ["session_id", "_b"]).filter((F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t1")) & (values == F.col("value"))).select("rec_id", "field")
    return outside.unionByName(hits).distinct()


def middle(stack: np.ndarray) -> np.ndarray:
    """Median over the first axis, of odd length, which is sorted in place (odd-even transposition, on whole slices)."""
    for r in range(n := len(stack)):
        low, high = stack[r % 2 : n - 1 : 2], stack[r % 2 + 1 :: 2]
        least = np.minimum(low, high)
        np.maximum(low, high, out=high)
        low[:] = least
    return stack[n // 2]


def signal_away(x: np.ndarray, half: int = SIGNAL_HALF) -> np.ndarray:
    """How far each record (a row of samples) is off its path: a Hampel filter whose floor is still to come.

    The largest distance from the rolling median among samples that are over SIGMAS scaled rolling MADs away. At the ends the
    nearest whole window counts. Where more than half of a window is off, its median or its scaled MAD is, so these count too.
    """
    n = x.shape[1]
    width = min(2 * half + 1, n - 1 + n % 2)
    stack = np.moveaxis(sliding_window_view(x, width, axis=1), -1, 0)
    median = middle(stack.copy())
    mad = NORMAL * middle(np.abs(stack - median))
    at = np.clip(np.arange(n) - width // 2, 0, n - width)
    off = np.abs(x - median[:, at])
    off[off <= SIGMAS * mad[:, at]] = 0
    return np.max([off.max(axis=1), np.abs(median).max(axis=1), mad.max(axis=1)], axis=0)


def _signal_facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per record the number of samples, their range and spread, and how far they are off their path; records of one length at once."""
    for pdf in batches:
        samples = [v[~pd.isna(v)].astype(np.int32) for v in pdf.pop("_v")]
        lengths = np.array([len(v) for v in samples], dtype=np.int64)
        facts = np.zeros((len(samples), 4))
        for n in np.unique(lengths[lengths > 0]):
            own = np.flatnonzero(lengths == n)
            for i in (own[k : k + BLOCK] for k in range(0, len(own), BLOCK)):
                x = np.stack([samples[k] for k in i])
                mean = x.sum(axis=1, dtype=np.int64) / n
                variance = (x.astype(np.int64) ** 2).sum(axis=1) / n - mean * mean
                facts[i] = np.stack([x.min(axis=1), x.max(axis=1), np.sqrt(np.maximum(variance, 0.0)), signal_away(x)], axis=1)
        out = pdf.assign(_n=lengths, _lo=facts[:, 0], _hi=facts[:, 1], _spread=facts[:, 2], _away=facts[:, 3])
        yield out[lengths > 0]


def signal_outliers(records: DataFrame, channels: DataFrame) -> DataFrame:
    """Implausible signal records: rec_id, field ``signal``.

    Among the first ``numvalidsamples`` samples: one reaches ADMaxValue in either sign, or all (of at least two) are equal,
    or the Hampel filter finds one off its path (``signal_away``), by over FACTOR times the channel's usual spread, the floor.
    The usual spread is the median of the channel's record standard deviations (an exact percentile of pre-rounded values, so
    its state is bounded by the distinct spreads). Null timestamps take part; null samples are left out; records without valid
    samples, or null arrays, give none; repeated records count each.
    """
    n = F.least(F.greatest(F.coalesce("numvalidsamples", F.lit(0)), F.lit(0)), F.size("signal"))
    rows = records.select("rec_id", "session_id", "channelnumber", F.slice("signal", 1, n).alias("_v")).filter("size(_v) > 0")
    kinds = ", ".join(f"{c} {t}" for c, t in rows.drop("_v").dtypes)
    rows = frozen(rows.mapInPandas(_signal_facts, f"{kinds}, _n long, _lo double, _hi double, _spread double, _away double"))
    rows = rows.withColumn("_spread", F.round("_spread", 3))
    usual = rows.filter("_n > 1 and _hi > _lo").groupBy("session_id", "channelnumber").agg(F.percentile("_spread", 0.5).alias("_usual"))
    known = rows.join(usual, ["session_id", "channelnumber"], "left").join(channels.select("session_id", "channelnumber", "admax"), ["session_id", "channelnumber"], "left")
    full = F.greatest(F.abs("_lo"), F.abs("_hi")) >= F.col("admax")
    bad = F.coalesce(full, F.lit(False)) | ((F.col("_n") > 1) & (F.col("_lo") == F.col("_hi"))) | F.coalesce(F.col("_away") > FACTOR * F.col("_usual"), F.lit(False))
    return known.filter(bad).select("rec_id", F.lit("signal").alias("field"))
