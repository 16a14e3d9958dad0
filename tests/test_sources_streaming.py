"""Binary record files made here, and the streaming operators over files."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pulsegrid.sources import binary as B
from pulsegrid.sources import logs as L
from pulsegrid.streaming import events as ST


def write(path, layout, rows, header=b""):
    a = np.zeros(len(rows), np.dtype([(n, t, s) for n, t, s in layout]))
    for i, r in enumerate(rows):
        for k, v in r.items():
            a[i][k] = v
    path.write_bytes(header + a.tobytes())


def test_records(spark, tmp_path):
    B.register(spark)
    head = b"######## Header\r\n-SamplingFrequency 500\r\n-ADBitVolts 0.00000006\r\n".ljust(B.HEADER_BYTES, b"\0")
    write(tmp_path / "a.ncs", B.NLX_RECORDS["continuous"], [{"timestamp": 1000 * i, "channelnumber": 3, "samplefreq": 500, "numvalidsamples": 512 - i, "signal": np.arange(512)} for i in range(10)], head)
    df = spark.read.format("records").option("recordsPerPartition", 4).load(str(tmp_path / "a.ncs"))
    assert df.rdd.getNumPartitions() == 3 and df.agg(F.sum("timestamp"), F.sum(F.element_at("signal", 512))).first()[:] == (45000, 5110)
    cut = spark.read.format("records").option("start", 2000).option("stop", 4000).load(str(tmp_path / "a.ncs"))
    assert [r.record for r in cut.select("record").orderBy("record").collect()] == [2, 3, 4]
    assert B.expand_samples(df).count() == sum(512 - i for i in range(10)) and B.nlx_header(str(tmp_path / "a.ncs"))["SamplingFrequency"] == "500"
    write(tmp_path / "e.nev", B.NLX_RECORDS["event"], [{"timestamp": 5, "eventstring": b"TTL Input on X1_0 board 0 port 1 value (0x0080)."}, {"timestamp": 9, "eventstring": b"other"}], head)
    ttl = B.parse_ttl(spark.read.format("records").load(str(tmp_path / "e.nev"))).first()
    assert (ttl.board_name, ttl.port, ttl.value) == ("X1_0", 1, 128)


def test_text_header_records(spark, tmp_path):
    B.register(spark)
    head = b"%%BEGINHEADER\n% Program: x\n% Fields: timestamp,8,4,1\txfront,2,2,1\tyfront,2,2,1\n%%ENDHEADER\n"
    write(tmp_path / "a.p", [("timestamp", "<u4", ()), ("xfront", "<i2", ()), ("yfront", "<i2", ())], [{"timestamp": i, "xfront": i, "yfront": -i} for i in range(5)], head)
    rows = spark.read.format("records").load(str(tmp_path / "a.p")).select("timestamp", "yfront").orderBy("timestamp").collect()
    assert [tuple(r) for r in rows] == [(i, -i) for i in range(5)]


def test_pushed_range_and_storage(spark, tmp_path):
    B.register(spark)
    head = b"-NumADChannels 2\r\n-SamplesPerRecord 3\r\n-InputInverted True\r\n-ADBitVolts 0.5 0.25\r\n".ljust(B.HEADER_BYTES, b"\0")
    write(tmp_path / "a.ncs", B.NLX_RECORDS["continuous"], [{"timestamp": 1000 * i, "numvalidsamples": 512, "signal": np.arange(512)} for i in range(10)], head)
    df = spark.read.format("records").load(str(tmp_path / "a.ncs")).filter("timestamp >= 2000 and timestamp < 5000 and numvalidsamples = 512")
    plan = df._jdf.queryExecution().toString()
    assert [r.timestamp for r in df.select("timestamp").orderBy("timestamp").collect()] == [2000, 3000, 4000] and df.rdd.getNumPartitions() == 1 and "numvalidsamples" in plan
    rows = B.records_from_storage(spark, str(tmp_path / "*.ncs"), B.NLX_RECORDS["continuous"])
    assert rows.agg(F.sum("timestamp"), F.sum(F.element_at("signal", -1))).first()[:] == (45000, 5110)
    write(tmp_path / "b.dat", [("seconds", "<i4", ()), ("nanoseconds", "<i4", ()), ("dt", "<i4", ()), ("data", "<i2", (3, 2))], [{"seconds": 7, "data": [[1, 2], [3, 4], [5, 6]]}], head)
    assert spark.read.format("records").option("record", "buffer").load(str(tmp_path / "b.dat")).select("seconds", "data").first()[:] == (7, [[1, 2], [3, 4], [5, 6]])
    assert B.typed_header(B.nlx_header(str(tmp_path / "a.ncs"))) == {"NumADChannels": 2, "SamplesPerRecord": 3, "InputInverted": True, "ADBitVolts": [0.5, 0.25]}
    assert B.filter_bits(B.filter_code([0, 3, 5])) == [0, 3, 5]


def test_written_records(spark, tmp_path):
    B.register(spark)
    d = spark.range(1000).select(F.col("id").alias("timestamp"), (F.col("id") % 7).cast("short").alias("x"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("name"))
    out = str(tmp_path / "out")
    for _ in range(2):  # the second time appends
        d.repartitionByRange(3, "timestamp").sortWithinPartitions("timestamp").write.format("records").option("fields", "timestamp,8,4,1\tx,2,2,1\tname,1,8,1").mode("append").save(out)
    got = spark.read.format("records").load(out)
    assert got.count() == 2000 and got.filter("name = 'e999'").select("timestamp", "x").distinct().collect() == [(999, 5)]
    assert B.mwl_layout(B.mwl_fields([("a", "<i2", (32, 4)), ("b", "S80", ()), ("c", "<f8", (5,))])) == [("a", "<i2", (32, 4)), ("b", "S80", ()), ("c", "<f8", (5,))]


def test_interleaved(spark, tmp_path):
    d = spark.createDataFrame([(c, i, 10 * c + i) for c in (1, 2) for i in range(4)], "channel int, i int, y int")
    B.write_interleaved(d, str(tmp_path / "x"), [1, 2])
    assert np.concatenate([np.fromfile(f, "<i2") for f in B.files_of(str(tmp_path / "x"))]).tolist() == [10, 20, 11, 21, 12, 22, 13, 23]


def test_logs(spark, tmp_path):
    (tmp_path / "log.txt").write_text("-* NOTICE *- 10:00:00.1 - 500 - Cam::Go() - started\n-* ERROR *- 10:00:01 - 900 - Data Source Name: CSC7 overflow at Timestamp: 1200\n-* ERROR *- 10:00:02 - 1500 - VT1 lost\nodd line\n", encoding="latin-1")
    log = L.read_log(spark, str(tmp_path / "log.txt"))
    assert sorted((r.kind, r.timestamp, r.source, r.message) for r in log.collect())[-1] == ("NOTICE", 500, "Cam::Go()", "started") and log.count() == 3
    assert sorted((r.about, r.timestamp) for r in L.errors(log).collect()) == [("CSC7", 1200), ("VT1", 1500)]
    assert [r.about for r in L.errors(log, 1000, 1500).collect()] == ["CSC7"]
    (tmp_path / "lost.txt").write_bytes(b"-DataSectionsLost 1\r\n".ljust(B.HEADER_BYTES, b"\0") + b"100, 200, 3, RecordsLost\n\0")
    assert [tuple(r)[1:] for r in L.read_lost_records(spark, str(tmp_path / "lost.txt")).collect()] == [(100, 200, 3)]


def test_streams(spark, tmp_path):
    t = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({"k": ["a", "a", "a", "b"], "ts": [t, t + pd.Timedelta("30s"), t + pd.Timedelta("10min"), t + pd.Timedelta("2h")], "us": [0, 30, 600, 7200], "on": [True, False, True, False]})
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k string, ts timestamp, us long, on boolean").parquet(str(tmp_path / "in"))

    def result(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sorted((r.k, r.n) for r in result(ST.bin_events(stream(), "ts", ["k"], "5 minutes", "1 minute"), "bins")) == [("a", 1), ("a", 2)]
    assert sorted((r.k, r.n) for r in result(ST.sessions(stream(), "ts", ["k"], "5 minutes", "1 minute"), "sessions")) == [("a", 1), ("a", 2)]
    assert [(r.key, (r.stop - r.start).seconds) for r in result(ST.pulses(stream(), "k", "ts", "on", "1 minute"), "pulses")] == [("a", 30)]


def test_late_edges(spark, tmp_path):
    """An edge that arrives a batch late, but within the watermark, closes its pulse at the right time."""
    t = pd.Timestamp("2024-01-01")
    for n, batch in enumerate(([(0, True), (50, False)], [(20, False), (40, True)], [(7200, True)])):
        rows = pd.DataFrame({"k": "a", "ts": [t + pd.Timedelta(f"{s}s") for s, _ in batch], "on": [f for _, f in batch]})
        spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    import shutil

    (tmp_path / "in").mkdir()
    for n in range(3):
        for f in (tmp_path / f"in{n}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{n}.parquet")
    stream = spark.readStream.schema("k string, ts timestamp, on boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ST.pulses(stream, "k", "ts", "on", "1 minute").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((int((r.start - t).total_seconds()), int((r.stop - t).total_seconds())) for r in spark.table("late").collect()) == [(0, 20), (40, 50)]
