"""Nearest pairing, tokens, packing and garbled text against brute force, round trips and planted cases."""

import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import garble
from pulsegrid.llm.nearest import nearest_in_time
from pulsegrid.llm.packing import best_fit, pack
from pulsegrid.llm.tokens import PATTERN, Encoder, encode, merge_queue, ranks


def test_nearest(spark):
    rng = np.random.default_rng(0)
    left = [(i, int(rng.choice([1, 1, 1, 2])), int(t)) for i, t in enumerate(rng.integers(0, 3000, 300))] + [(900, 1, None), (901, None, 5), (902, 7, 5), (903, 1, left_t := 50), (904, 1, left_t)]
    right = [(1000 + i, int(rng.choice([1, 1, 1, 2])), int(t)) for i, t in enumerate(rng.integers(0, 3000, 250))] + [(5000, 1, None)] + [(6000 + i, 1, 1234) for i in range(50)]
    l, r = spark.createDataFrame(left, "rec_id long, k int, t long").withColumn("distance", F.lit("clash")), spark.createDataFrame(right, "rec_id long, k int, t long").withColumn("_tick", F.lit(1))
    got = {x.rec_id: (x.target_id, x.distance) for x in nearest_in_time(l, r, ["k"], "t", "rec_id", "t", "rec_id", 12).collect()}
    want = {}
    for i, k, t in left:
        near = min(((abs(u - t), j) for j, q, u in right if q == k and t is not None and u is not None), default=None)
        if near and near[0] <= 12:
            want[i] = (near[1], near[0])
    assert got == want
    assert nearest_in_time(l.limit(0), r, ["k"], "t", "rec_id", "t", "rec_id", 12).count() == nearest_in_time(l, r.limit(0), ["k"], "t", "rec_id", "t", "rec_id", 12).count() == 0


TEXTS = ["", None, " ", "a", "Hello world, it's 2024!", " 　  \n\n  b", "žluťoučký kůň 🎉🎉", "x" * 700, "=-" * 200, "áe", "  double  spaces\r\n", "it's it's", "日本語" * 30]


def test_tokens(spark):
    tiktoken = pytest.importorskip("tiktoken")
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(), special_tokens={})
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    want = {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.ids for r in encode(df).collect()} == want  # with the dictionary of frequent words
    few = Encoder(dictionary=3).fit(df)  # most words folded on the spot
    rows = df.select("doc_id", few.ids(F.col("text")).alias("i"), few.sizes(F.col("text")).alias("n"), few.text(few.ids(F.col("text"))).alias("t")).collect()
    assert all(r.i == want[r.doc_id] and r.n == len(r.i) and r.t == (TEXTS[r.doc_id] or "") for r in rows)
    assert encode(df.limit(0)).count() == 0
    blob = "".join(np.random.default_rng(9).choice(list("abcxyz0.-é"), 3000)) + "q" * 20000  # beyond LONG: by the merge queue
    long = df.unionByName(spark.createDataFrame([(99, blob + " end", "x")], df.schema))
    want[99] = reference.encode_ordinary(blob + " end")
    assert {r.doc_id: r.ids for r in encode(long).collect()} == want


def test_merge_queue():
    """The queue gives what merging the leftmost pair of the lowest rank again and again gives."""
    rank, rng = ranks(), np.random.default_rng(8)
    for n in (1, 2, 5, 40, 300):
        word = "".join(rng.choice(list("aabeth é"), n)).encode()
        pieces = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min(((rank[pieces[i] + pieces[i + 1]], i) for i in range(len(pieces) - 1) if pieces[i] + pieces[i + 1] in rank), default=None)
            if best is None:
                break
            pieces[best[1] : best[1] + 2] = [pieces[best[1]] + pieces[best[1] + 1]]
        assert merge_queue(word, rank) == [rank[p] for p in pieces]


def test_best_fit():
    rng = np.random.default_rng(1)
    sizes = np.minimum(512, rng.lognormal(5, 0.8, 5000).astype(int) + 1)
    counts = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
    plan, ranges = best_fit(counts, 512)
    fill: dict[int, int] = {}
    for size, first, n, container, each in plan:
        for i in range(n):
            fill[container + i // each] = fill.get(container + i // each, 0) + size
    assert max(fill.values()) <= 512 and sum(fill.values()) == sizes.sum() and len(fill) == sum(n for _, n in ranges)
    assert len(fill) <= max(-(-sizes.sum() // 512), (sizes > 256).sum()) * 1.01 + 1


def test_fit_keeps_the_maps_out_of_the_plans(spark):
    """The driver keeps the text of every SQL plan; with the literal rank map in it, one of a fit had over two million characters."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    encoder = Encoder().fit(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    bus.waitUntilEmpty()
    kept = store.executionsList(before, 100)
    assert kept.size() and max(len(kept.apply(i).physicalPlanDescription()) for i in range(kept.size())) < 100_000
    assert {"Hello", "a", " spaces"} <= set(encoder.frequent) and encoder.longest == 700
    assert all(ids == merge_queue(w.encode(), ranks()) for w, ids in encoder.frequent.items())


def test_pack_groups(spark, monkeypatch):
    """With several groups every window stays near the corpus' mixture, and the running deficit carries over windows and groups."""
    from pulsegrid.llm import packing

    monkeypatch.setattr(packing, "GROUP", 4000)
    rng = np.random.default_rng(7)
    rows = [(i, "abcde"[int(k)], int(n)) for i, (k, n) in enumerate(zip(rng.choice(5, 20000, p=[0.5, 0.2, 0.15, 0.1, 0.05]), rng.integers(1, 90, 20000)))]
    items = spark.createDataFrame(rows, "doc_id long, source string, size int")
    p = pack(items, spark.createDataFrame([("s", 200)], "pack_name string, capacity_tokens int"), 32).toPandas()
    assert len(p) == 20000 and p.groupby("container").n_tokens.sum().max() <= 200 and p.groupby("container").window_no.nunique().max() == 1
    p = p.assign(source=p.doc_id.map({i: s for i, s, _ in rows}))
    target = p.groupby("source").n_tokens.sum() / p.n_tokens.sum()
    by_window = p.pivot_table(index="window_no", columns="source", values="n_tokens", aggfunc="sum", fill_value=0).sort_index()
    assert ((by_window.div(by_window.sum(axis=1), axis=0) - target).abs() < 0.02).all().all()
    running = (by_window - by_window.sum(axis=1).to_frame().to_numpy() * target.to_numpy()).cumsum().abs().to_numpy()
    assert running.max() < by_window.sum(axis=1).mean()  # of 20 windows a group never owes one


def test_pack(spark):
    rng = np.random.default_rng(2)
    rows = [(i, ["a", "b", None][i % 3], int(s)) for i, s in enumerate(rng.integers(1, 90, 3000))] + [(5000 + i, "a", 15) for i in range(1500)] + [(9000, "b", 950), (9001, "b", None), (9002, "b", 0)]
    out = pack(spark.createDataFrame(rows, "doc_id long, source string, size int"), spark.createDataFrame([("s", 100), ("l", 400), ("none", 0)], "pack_name string, capacity_tokens int"), 16).toPandas()
    sizes = {i: s for i, _, s in rows if s}
    for name, cap in (("s", 100), ("l", 400)):
        p = out[out.pack_name == name]
        assert p.groupby("container").n_tokens.sum().max() <= cap
        assert p.groupby("doc_id").n_tokens.sum().to_dict() == sizes
        assert set(p[p.doc_id.map(sizes) <= cap].part) == {0} and not p.duplicated(["doc_id", "part"]).any()
        assert p.container.nunique() <= -(-sum(sizes.values()) // cap) * 1.02 + 1
        big = p.sort_values(["doc_id", "part"])
        assert (big.groupby("doc_id").n_tokens.cumsum() - big.n_tokens == big.first_token).all()
        p = p.assign(source=p.doc_id.map({i: s or "" for i, s, _ in rows}))
        target = p.groupby("source").n_tokens.sum() / p.n_tokens.sum()
        by_window = p.pivot_table(index="window_no", columns="source", values="n_tokens", aggfunc="sum", fill_value=0)
        assert ((by_window.div(by_window.sum(axis=1), axis=0) - target).abs() < 1 / 16).all().all()  # one container of a window
    assert pack(spark.createDataFrame([], "doc_id long, source string, size int"), spark.createDataFrame([("s", 100)], "pack_name string, capacity_tokens int")).count() == 0


SENTENCES = ["Über die Brücken müsste der Ausschuss gründlich prüfen.", "Die Bürger für größere Häfen hören täglich schöne Töne.", "Größere Zuschüsse für Schülerbusse wären möglich.", "Natürlich weiß jeder, dass die Gebühren fällig sind.", "Wir können die Förderung nicht schon wieder ändern.", "Das Schild trägt die Zeichen Ã, Ð und Å ganz zu Recht."]


def test_garble(spark):
    rng = np.random.default_rng(3)
    rows, garbled = [], {}
    for i in range(1500):
        s = " ".join(rng.choice(SENTENCES, 3))
        t = s
        if i % 17 == 0:
            t = s.encode().decode("latin-1") if i % 2 else s.encode("cp1252", "replace").decode("mac_roman")
        elif i % 29 == 0:
            t = s.encode().decode("cp1252", "replace").replace("�", "")
        if t != s and "Ð" not in s:
            garbled[i] = s
        elif t != s:
            continue
        rows.append((i, t, "src", "de"))
    rows += [(9000, None, "src", "de"), (9001, "", None, None), (9002, "plain ascii", None, None), (9003, "Verlust� hier", "src", "de"), (9004, "Gröẞe á é " * 3000, "src", "DE ")]
    out = {r.doc_id: r for r in garble.examine(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    found = {i for i, r in out.items() if r.found}
    assert set(garbled) <= found and found - set(garbled) == {9003}
    ok = [out[i].restored == s for i, s in garbled.items() if i % 17 == 0]
    assert sum(ok) > 0.95 * len(ok)
    assert out[9000].restored is None and out[9001].restored == ""


def test_free_ciphers(spark):
    """Swaps of code pages that no list names are learned, found and restored: cp1250 read as cp852, cp1251 read as koi8-r."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("source = 'stenogram' and lower(substr(lang, 1, 2)) in ('cs', 'bg') and text is not null").collect()
    swaps, rng, rows, garbled = {"cs": ("cp1250", "cp852"), "bg": ("cp1251", "koi8-r")}, np.random.default_rng(5), [], {}
    for r in docs:
        right, wrong = swaps[r.lang.lower()[:2]]
        t = r.text
        if rng.random() < 0.15 and "Ã" not in t and "Ð" not in t:
            try:
                t = t.encode(right).decode(wrong)
            except UnicodeError:
                t = r.text
        if sum(a != b for a, b in zip(t, r.text)) > 4:
            garbled[r.doc_id] = r.text
        rows.append((r.doc_id, t, r.source, r.lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    model = garble.fit(df)
    own = model.tables["stenogram", "cs", garble.FREE]
    assert {own[x.encode("cp1250").decode("cp852")] for x in "ěščřž"} == set("ěščřž")
    out = {r.doc_id: r for r in garble.examine(df, model).filter("found").collect()}
    assert len(garbled) > 50 and len(garbled.keys() & out.keys()) >= 0.9 * len(garbled)
    assert sum(out[i].restored == t for i, t in garbled.items() if i in out) >= 0.9 * len(garbled)


def test_letters_move(spark):
    """A symbol that the text contradicts leaves its code page's letter: here the page's letters for two symbols are exchanged."""
    rng, rows, garbled = np.random.default_rng(6), [], {}
    table = garble._single_table("mac_roman", "cp1252")
    wrong = {letter: symbol for symbol, letter in table.items()}
    wrong["ü"], wrong["ö"] = wrong["ö"], wrong["ü"]
    for i in range(1500):
        s = " ".join(rng.choice(SENTENCES[:5], 3))
        rows.append((i, "".join(wrong.get(c, c) for c in s) if i % 8 == 0 else s, "src", "de"))
        if i % 8 == 0:
            garbled[i] = s
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    model = garble.fit(df)
    learned = model.table("src", "de", garble.FREE)
    assert learned[wrong["ü"]] == "ü" and learned[wrong["ö"]] == "ö" and table[wrong["ü"]] == "ö"
    out = {r.doc_id: r for r in garble.examine(df, model).filter("found").collect()}
    assert set(out) == set(garbled) and sum(out[i].restored == t for i, t in garbled.items()) >= 0.9 * len(garbled)


def test_nothing_else_imports_this():
    import pathlib

    root = pathlib.Path(__file__).parents[2] / "pulsegrid"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "pulsegrid.llm" in p.read_text()] and sys.version_info >= (3, 10)
