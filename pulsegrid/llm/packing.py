"""Filling containers of fixed capacity with whole items, with every window of containers at the corpus' mixture of sources.

The plan of containers depends only on how many items of each size there are, so it is made on that histogram (at most as many
counts as the capacity has tokens, whatever the number of items or sources) and applied to the items by their position:

1. Every (size, source) is a queue. The j-th item of a queue of n has the virtual time (j + 1/2) / n; items of one size are
   taken in order of virtual time, so the queues are served round-robin in proportion to their lengths.
2. Best fit, largest sizes first, on ranges of equal containers: a range of containers with the same free space takes the same
   items, so one entry of the plan stands for any number of containers.
3. Containers are dealt to windows by deficit round-robin: in each round every window takes one container of a run of similar
   ones, the one that its deficits call for (tokens of each source it has less or more than its share); deficits carry on over
   the rounds. Windows are dealt in groups of at most about GROUP items, each an even sample of the containers.
4. Deficits carry on over windows and groups: the sums of earlier groups' deficits (a prefix sum over one row per group and
   source) come into a group, and its windows follow in the order that keeps the running deficit smallest.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.plans.ordered import POSITIONS, scan

GOLDEN = 0.6180339887498949
#: Most capacities in one call.
PACKS = 1000
#: Containers in a window, on average.
WINDOW = 64
#: Items whose windows are dealt by one task, about.
GROUP = 1 << 17


def deal(tokens: np.ndarray, target: np.ndarray, windows: int) -> np.ndarray:
    """Window of each container by deficit round-robin, from its tokens of each source; containers of similar content follow each other."""
    over = tokens - target * tokens.sum(axis=1, keepdims=True)  # tokens above the container's share
    far = (over**2).sum(axis=1)
    rounds = [np.arange(i, min(i + windows, len(over))) for i in range(0, len(over), windows)]
    out, carried = np.zeros(len(over), dtype=np.int64), np.zeros((windows, tokens.shape[1]))
    for own in sorted(rounds, key=lambda r: -far[r].mean()):  # the rounds that can upset the least come last
        served = np.zeros(windows)
        for i in own[np.argsort(-far[own], kind="stable")]:
            w = int(np.argmin(carried @ over[i] + served))
            out[i], served[w] = w, np.inf
            carried[w] += over[i]
    return out


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """Plan for ``counts`` items of each size: entries (size, first position, items, first container, items per container)
    and the final ranges of equal containers (first, number)."""
    free: dict[int, list[list[int]]] = {}
    spaces: list[int] = []
    plan, opened = [], 0

    def put(space: int, first: int, n: int) -> None:
        if n:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append([first, n])

    for size in sorted(counts, reverse=True):
        done, left = 0, counts[size]
        while left:
            at = bisect_left(spaces, size)
            if at < len(spaces):
                space = spaces[at]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space]
                    spaces.pop(at)
            else:
                each = capacity // size
                space, first, n = capacity, opened, -(-left // each)
                opened += n
            each = space // size
            full = min(n, left // each)
            if full:
                plan.append((size, done, full * each, first, each))
                put(space - each * size, first, full)
                done, left = done + full * each, left - full * each
            if full < n:
                if left and left < each:
                    plan.append((size, done, left, first + full, left))
                    put(space - left * size, first + full, 1)
                    put(space, first + full + 1, n - full - 1)
                    done, left = done + left, 0
                else:
                    put(space, first + full, n - full)
    return plan, sorted((first, n) for ranges in free.values() for first, n in ranges)


def in_order(over: np.ndarray, carried: np.ndarray) -> np.ndarray:
    """Order of windows (tokens over their share, by source) that keeps the running deficit, ``carried`` at first, small: each next one cancels most of it."""
    left, order, running = np.ones(len(over), dtype=bool), [], carried.astype(float).copy()
    square = (over**2).sum(axis=1)
    for _ in range(len(over)):
        cost = np.where(left, 2 * over @ running + square, np.inf)
        w = int(cost.argmin())
        order.append(w)
        left[w] = False
        running += over[w]
    return np.array(order, dtype=np.int64)


def pack(items: DataFrame, capacities: DataFrame, window: int = WINDOW) -> DataFrame:
    """Put items (doc_id, source, size) into containers of each capacity (pack_name, capacity_tokens).

    Gives pack_name, window_no, container, doc_id, part, first_token, n_tokens. An item larger than the capacity is cut into
    full containers and a rest (parts 0, 1, ...), any other stays whole. Items of null or zero size have nothing to place and
    give no row; null sources share a queue; capacities must be positive (others are ignored). Repeated items are placed each.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    sized = items.filter("size > 0").select("doc_id", source.alias("_source"), F.col("size").cast("long").alias("_size"))
    caps = capacities.filter("capacity_tokens > 0").select("pack_name", "capacity_tokens").distinct().limit(PACKS + 1).collect()
    if len(caps) > PACKS:
        raise ValueError(f"more than {PACKS} capacities")
    packs = F.array(*[F.struct(F.lit(c.pack_name).alias("name"), F.lit(c.capacity_tokens).cast("long").alias("cap")) for c in caps]) if caps else F.array().cast("array<struct<name:string,cap:bigint>>")
    cut = sized.withColumn("_pack", F.explode(packs)).select("*", F.col("_pack.name").alias("pack_name"), F.col("_pack.cap").alias("_cap")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_size") / F.col("_cap")) - 1)).alias("part"))
    cut = cut.select("pack_name", "_cap", "doc_id", "_source", "part", F.least("_cap", F.col("_size") - F.col("part") * F.col("_cap")).alias("n_tokens"))
    queues = cut.groupBy("pack_name", "_cap", "n_tokens", "_source").agg(F.count(F.lit(1)).alias("_queue"))
    histogram = queues.groupBy("pack_name", "_cap", "n_tokens").agg(F.sum("_queue").alias("n")).collect()  # at most the capacity's number of rows a pack

    spark, plans, groups_of = items.sparkSession, [], []
    for name, capacity in sorted({(r["pack_name"], r["_cap"]) for r in histogram}, key=str):
        counts = {r["n_tokens"]: r["n"] for r in histogram if r["pack_name"] == name}
        plan, ranges = best_fit(counts, capacity)
        by_size: dict[int, list] = {}
        for size, first, n, container, each in plan:
            by_size.setdefault(size, []).append((first, n, container, each))
        groups = max(1, round(sum(counts.values()) / GROUP))
        groups_of.append((name, groups, max(1, round(sum(n for _, n in ranges) / window / groups)), float(sum(size * n for size, n in counts.items()))))
        plans += [(name, size, counts[size], groups, entries) for size, entries in by_size.items()]
    # small or not, Spark knows the size of a local relation and broadcasts it only if it is below the session's threshold
    steps = spark.createDataFrame(plans, "pack_name string, n_tokens long, _count long, _groups long, _plan array<struct<first:long,n:long,container:long,each:long>>")
    grouped = spark.createDataFrame(groups_of, "pack_name string, _g long, _each long, _all double")

    # the position in a queue, then among all queues of the size by virtual time; both in buckets of expected positions
    spot = F.pmod(F.xxhash64("doc_id", "part"), F.lit(1 << 40)) / float(1 << 40)
    queued = cut.join(queues, ["pack_name", "_cap", "n_tokens", "_source"]).withColumn("_spot", spot * F.col("_queue"))
    queued = scan(queued, ["pack_name", "n_tokens", "_source"], ["_spot", "doc_id", "part"], POSITIONS, _j=("rank", None))
    timed = queued.join(steps, ["pack_name", "n_tokens"]).withColumn("_time", (F.col("_j") + 0.5) / F.col("_queue") * F.col("_count"))
    placed = scan(timed, ["pack_name", "n_tokens"], ["_time", "_source", "doc_id", "part"], POSITIONS, _at=("rank", None))
    entry = F.get(F.filter("_plan", lambda e: (e["first"] <= F.col("_at")) & (F.col("_at") < e["first"] + e["n"])), 0)
    placed = placed.withColumn("_e", entry).withColumn("container", F.col("_e.container") + F.floor((F.col("_at") - F.col("_e.first")) / F.col("_e.each")))
    # multiples of the golden ratio lie evenly on the unit interval, and so do those of any range of containers
    even = F.col("container") * GOLDEN - F.floor(F.col("container") * GOLDEN)
    placed = placed.withColumn("_group", F.floor(even * F.col("_groups")).cast("long"))
    placed = placed.select("pack_name", "_group", "_source", "container", "doc_id", F.col("part").cast("int").alias("part"), (F.col("part") * F.col("_cap")).alias("first_token"), "n_tokens")

    # per group: its windows, the sources' target shares, and the deficits that earlier groups leave
    totals = queues.groupBy("pack_name", "_source").agg(F.sum(F.col("n_tokens") * F.col("_queue")).alias("_tokens")).join(grouped, "pack_name")
    shares = totals.select("pack_name", "_source", "_g", "_each", (F.col("_tokens") / F.col("_all")).alias("_share"))
    if any(g > 1 for _, g, _, _ in groups_of):
        by_group = placed.groupBy("pack_name", "_group", "_source").agg(F.sum("n_tokens").cast("double").alias("_own"))
        whole = by_group.groupBy("pack_name", "_group").agg(F.sum("_own").alias("_sum"))
        cells = shares.withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_g") - 1))).join(whole, ["pack_name", "_group"]).join(by_group, ["pack_name", "_group", "_source"], "left")
        earlier = Window.partitionBy("pack_name", "_source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # one row per group
        carry = F.coalesce(F.sum(F.coalesce("_own", F.lit(0.0)) - F.col("_share") * F.col("_sum")).over(earlier), F.lit(0.0))
        cells = cells.withColumn("_carry", carry)
    else:
        cells = shares.withColumns({"_group": F.lit(0).cast("long"), "_carry": F.lit(0.0)})
    cells = cells.select(F.col("pack_name").alias("_p"), F.col("_group").alias("_g"), F.col("_source").alias("_s"), "_share", "_each", "_carry")

    def windows_of(pdf: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pdf.assign(window_no=0)[names_out]
        each, place = int(targets["_each"].iloc[0]), {s: i for i, s in enumerate(targets["_s"])}
        target = targets["_share"].to_numpy()
        containers, at = np.unique(pdf["container"], return_inverse=True)
        tokens = np.zeros((len(containers), len(target)))
        np.add.at(tokens, (at, pdf["_source"].map(place).to_numpy()), pdf["n_tokens"].to_numpy())
        dealt = deal(tokens, target, each)
        sums = np.zeros((each, len(target)))
        np.add.at(sums, dealt, tokens - target * tokens.sum(axis=1, keepdims=True))
        rank = np.empty(each, dtype=np.int64)
        rank[in_order(sums, targets["_carry"].to_numpy())] = np.arange(each)
        return pdf.assign(window_no=pdf["_group"] * each + rank[dealt][at])[names_out]

    names_out = ["pack_name", "window_no", "container", "doc_id", "part", "first_token", "n_tokens"]
    kinds = dict(placed.withColumn("window_no", F.col("_group")).dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in names_out)
    return placed.groupBy("pack_name", "_group").cogroup(cells.groupBy("_p", "_g")).applyInPandas(windows_of, out)
