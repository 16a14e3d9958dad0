"""Sources and sinks for binary record files of acquisition systems, through Spark's Python data source API.

A file is a text header and fixed-size records; record ranges are the partitions. A closed time range (options, or filters on
``timestamp`` that Spark pushes down) is cut out by bisecting the records' timestamps, and blocks of records become Arrow batches.
``format("records")`` maps files that driver and executors see under one path; ``records_from_storage`` decodes files of any
storage Spark reads. Writing makes one file a task, with the text header in front.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from pulsegrid.plans.ordered import scan

HEADER_BYTES = 16384

# Record layouts of the vendors' files, as (name, numpy type, shape).
NLX_RECORDS = {
    "continuous": [("timestamp", "<u8", ()), ("channelnumber", "<u4", ()), ("samplefreq", "<u4", ()), ("numvalidsamples", "<u4", ()), ("signal", "<i2", (512,))],
    "event": [("nstx", "<i2", ()), ("npkt_id", "<i2", ()), ("npkt_data_size", "<i2", ()), ("timestamp", "<u8", ()), ("nevent_id", "<i2", ()), ("nttl", "<i2", ()), ("ncrc", "<i2", ()), ("ndummy1", "<i2", ()), ("ndummy2", "<i2", ()), ("extra", "<i4", (8,)), ("eventstring", "S128", ())],
    "spike": [("timestamp", "<u8", ()), ("scnumber", "<u4", ()), ("cellnumber", "<u4", ()), ("params", "<u4", (8,)), ("waveform", "<i2", (32, 4))],
    "video": [("swstx", "<u2", ()), ("swid", "<u2", ()), ("swdata_size", "<u2", ()), ("timestamp", "<u8", ()), ("points", "<u4", (400,)), ("sncrc", "<i2", ()), ("x", "<i4", ()), ("y", "<i4", ()), ("angle", "<i4", ()), ("targets", "<i4", (50,))],
}
EXTENSIONS = {".ncs": "continuous", ".nev": "event", ".nse": "spike", ".nst": "spike", ".ntt": "spike", ".nvt": "video"}
SPIKE_CHANNELS = {".nse": 1, ".nst": 2, ".ntt": 4}
MWL_RECORDS = {
    "position": [("timestamp", "<u4", ()), ("xfront", "<i2", ()), ("yfront", "<i2", ()), ("xback", "<i2", ()), ("yback", "<i2", ())],
    "event": [("timestamp", "<u4", ()), ("string", "S80", ())],
}
MWL_CODES = {1: "i1", 2: "<i2", 3: "<i4", 4: "<f4", 5: "<f8", 8: "<u4", 9: "u1", 10: "<u2", 11: "<i8", 12: "<u8"}
SQL_TYPES = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "i8": "bigint", "u8": "bigint", "f4": "float", "f8": "double"}


def schema_of(layout: list[tuple]) -> str:
    def kind(t: str, shape: tuple) -> str:
        base = "string" if "S" in t else SQL_TYPES[t.lstrip("<")]
        for _ in shape:
            base = f"array<{base}>"
        return base

    return ", ".join(f"{n} {kind(t, s)}" for n, t, s in layout)


def nlx_header(path: str) -> dict[str, str]:
    """The ``-Key value`` lines of a file's header; comment lines are left out."""
    with open(path, "rb") as f:
        text = f.read(HEADER_BYTES).split(b"\0")[0].decode("cp1252", "replace")
    return {m[1]: m[2].strip() for m in re.finditer(r"(?m)^\s*-(\w+)[ \t]*(.*?)\r?$", text)}


def mwl_header(path: str) -> tuple[dict[str, str], int]:
    """The ``% key: value`` lines between the header marks, and where the records begin."""
    with open(path, "rb") as f:
        raw = f.read(1 << 20)
    end = raw.index(b"%%ENDHEADER")
    start = raw.index(b"\n", end) + 1
    return {m[1].strip(): m[2].strip() for m in re.finditer(r"(?m)^%\s*([^:%\n]+):[ \t]*(.*?)\r?$", raw[:end].decode("latin-1"))}, start


def mwl_layout(fields: str) -> list[tuple]:
    """A schema string ``name,code,size,shape`` (tab-separated fields) as a layout; code 1 of a longer size is text, the shape a number or [n m ...]."""
    out = []
    for f in re.split(r"[\t;]+", fields.strip()):
        name, code, size, shape = ([p.strip() for p in f.split(",", 3)] + ["1", "1", "1"])[:4]
        dims = tuple(int(n) for n in re.findall(r"\d+", shape))
        out.append((name, f"S{size}", ()) if code == "1" and int(size) > 1 else (name, MWL_CODES[int(code)], () if dims in ((), (1,)) else dims))
    return out


def mwl_fields(layout: list[tuple]) -> str:
    """The schema string of a layout."""
    codes = {t: c for c, t in MWL_CODES.items()}
    text = lambda shape: "1" if not shape else str(shape[0]) if len(shape) == 1 else "[" + " ".join(map(str, shape)) + "]"
    return "\t".join(f"{n},1,{t[1:]},1" if t.startswith("S") else f"{n},{codes[t]},{np.dtype(t).itemsize},{text(shape)}" for n, t, shape in layout)


def filter_code(bits: Sequence[int]) -> int:
    """Cut-off switches of an amplifier as one number; ``filter_bits`` takes it apart."""
    return sum(1 << b for b in set(bits))


def filter_bits(code: int) -> list[int]:
    return [b for b in range(code.bit_length()) if code >> b & 1]


def typed_header(header: dict[str, str]) -> dict[str, object]:
    """Header values as what they look like: booleans, whole numbers, numbers, lists of numbers, else text."""

    def value(text: str) -> object:
        word = text.strip()
        if word.lower() in ("true", "false", "yes", "no"):
            return word.lower() in ("true", "yes")
        parts = word.split()
        try:
            numbers = [int(p) if re.fullmatch(r"[+-]?\d+", p) else float(p) for p in parts]
        except ValueError:
            return word
        return numbers[0] if len(numbers) == 1 else numbers or word

    return {k: value(v) for k, v in header.items()}


def layout_of(path: str, options: dict) -> tuple[list[tuple], int]:
    ext = os.path.splitext(path)[1].lower()
    if options.get("record") == "buffer":  # blocks of several channels, their numbers stated in the header
        header = nlx_header(path)
        size = (int(header["SamplesPerRecord"]), int(header["NumADChannels"]))
        return [("seconds", "<i4", ()), ("nanoseconds", "<i4", ()), ("dt", "<i4", ()), ("data", "<i2", size)], HEADER_BYTES
    if ext in EXTENSIONS:
        kind = options.get("record", EXTENSIONS[ext])
        layout = NLX_RECORDS[kind]
        if kind == "spike":
            layout = [*layout[:-1], ("waveform", "<i2", (int(options.get("samples", 32)), SPIKE_CHANNELS.get(ext, 4)))]
        return layout, HEADER_BYTES
    header, start = mwl_header(path)
    return (mwl_layout(header["Fields"]) if "Fields" in header else MWL_RECORDS[options.get("record", "position")]), start


class Records(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


def files_of(path: str) -> list[str]:
    return sorted(f for f in (glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path)) if not os.path.basename(f).startswith(("_", ".")))


def arrow_column(block: np.ndarray, name: str) -> pa.Array:
    """One field of a block of records as an Arrow array."""
    x = block[name]
    if x.dtype.kind == "S":
        return pa.array([v.split(b"\0")[0].decode("latin-1").rstrip() for v in x], pa.string())
    wider = {"u1": "<i2", "u2": "<i4", "u4": "<i8", "u8": "<i8"}.get(x.dtype.str[1:])
    flat = pa.array(np.ascontiguousarray(x.astype(wider) if wider else x).reshape(-1))
    for n in reversed(x.shape[1:]):
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n, dtype=np.int32)), flat)
    return flat


class RecordReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.names, dict(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on ``timestamp`` narrow the range of records; Spark filters by the rest."""
        for f in filters:
            if getattr(f, "attribute", None) != ("timestamp",) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            lo = {GreaterThan: f.value + 1, GreaterThanOrEqual: f.value, EqualTo: f.value}.get(type(f))
            hi = {LessThan: f.value - 1, LessThanOrEqual: f.value, EqualTo: f.value}.get(type(f))
            if lo is not None:
                self.options["start"] = max(int(lo), int(self.options.get("start", lo)))
            if hi is not None:
                self.options["stop"] = min(int(hi), int(self.options.get("stop", hi)))

    def partitions(self) -> list[Records]:
        size, out = int(self.options.get("recordsperpartition", 1 << 16)), []
        lo, hi = (self.options.get(k) for k in ("start", "stop"))
        for path in files_of(self.options["path"]):
            data = open_records(path, self.options)
            a, z = 0, len(data)
            if (lo is not None or hi is not None) and z:  # closed range of the raw clock; records are in order of time
                t = data["timestamp"]
                a = int(np.searchsorted(t, max(0, int(lo)), "left")) if lo is not None else 0
                z = (int(np.searchsorted(t, int(hi), "right")) if int(hi) >= 0 else 0) if hi is not None else z
            out += [Records(path, i, min(size, z - i)) for i in range(a, z, size)]
        return out or [Records("", 0, 0)]

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        data = open_records(part.path, self.options)
        for first in range(part.first, part.first + part.count, 4096):
            block = np.array(data[first : min(first + 4096, part.first + part.count)])
            made = {"file": lambda b=block: pa.array([os.path.basename(part.path)] * len(b), pa.string()), "record": lambda b=block, i=first: pa.array(np.arange(i, i + len(b), dtype=np.int64))}
            yield pa.RecordBatch.from_arrays([made[n]() if n in made else arrow_column(block, n) for n in self.names], self.names)


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class RecordWriter(DataSourceWriter):
    """One file of fixed records a task, in a folder that all tasks share; a file gets its name when the whole job is done."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.folder, self.overwrite, self.names = options["path"], overwrite, schema.names
        kinds = {"tinyint": "i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8"}
        self.layout = mwl_layout(options["fields"]) if "fields" in options else [(f.name, kinds[f.dataType.simpleString()], ()) for f in schema]
        self.head = b"" if options.get("header", "true") == "false" else f"%%BEGINHEADER\n% Program: pulsegrid\n% File type: Binary\n% Fields: \t{mwl_fields(self.layout)}\n%%ENDHEADER\n".encode()

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f".part-{context.partitionId():06d}-{context.taskAttemptId()}")
        dtype, n = np.dtype([(a, t, s) for a, t, s in self.layout]), 0
        with open(path, "wb") as f:
            f.write(self.head)
            block: list[tuple] = []
            for row in rows:
                block.append(tuple(v.encode("latin-1", "replace") if isinstance(v := row[a], str) else v for a, _, _ in self.layout))
                if len(block) == 4096:
                    f.write(np.array(block, dtype).tobytes())
                    n, block = n + len(block), []
            f.write(np.array(block, dtype).tobytes())
        return Written(path, n + len(block))

    def commit(self, messages: list) -> None:
        written = [m for m in messages if m is not None]
        if self.overwrite:
            for old in files_of(self.folder):
                os.remove(old)
        taken = len(files_of(self.folder))
        for i, m in enumerate(sorted(written, key=lambda m: m.path)):
            if m.rows:
                os.replace(m.path, os.path.join(self.folder, f"part-{taken + i:06d}.p"))
            else:
                os.remove(m.path)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


def records_from_storage(spark: SparkSession, path: str, layout: list[tuple], offset: int = HEADER_BYTES) -> DataFrame:
    """Records of files on any storage that Spark reads (a task holds one file): file, record, and the fields of ``layout``."""
    dtype = np.dtype([(n, t, s) for n, t, s in layout])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = content.as_buffer()
                n = max(0, raw.size - offset) // dtype.itemsize
                data = np.frombuffer(raw, dtype, n, offset) if n else np.empty(0, dtype)
                for i in range(0, n, 4096):
                    block = data[i : i + 4096]
                    columns = [pa.array([os.path.basename(name)] * len(block), pa.string()), pa.array(np.arange(i, i + len(block), dtype=np.int64))]
                    yield pa.RecordBatch.from_arrays(columns + [arrow_column(block, c) for c, _, _ in layout], ["file", "record", *[c for c, _, _ in layout]])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "file string, record bigint, " + schema_of(layout))


def open_records(path: str, options: dict) -> np.memmap | np.ndarray:
    layout, start = layout_of(path, options)
    dtype = np.dtype([(n, t, s) for n, t, s in layout])
    count = max(0, os.path.getsize(path) - start) // dtype.itemsize
    return np.memmap(path, dtype, "r", start, (count,)) if count else np.empty(0, dtype)


class RecordSource(DataSource):
    """``spark.read.format("records").load(path)``: a file, a pattern or a folder of one kind of files. Options: record, samples, start, stop (raw clock, closed), recordsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        options = {k.lower(): v for k, v in self.options.items()}
        first = files_of(options["path"])[0]
        return "file string, record bigint, " + schema_of(layout_of(first, options)[0])

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(schema, {k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordSource)


def expand_samples(records: DataFrame, bit_volts: float = 1.0, inverted: bool = False, clip: int | None = None) -> DataFrame:
    """Records of a continuous file as samples: t (seconds), y; only valid samples, clipped ones null."""
    rows = records.filter("samplefreq > 0").select(*[c for c in records.columns if c not in ("signal",)], F.posexplode(F.slice("signal", 1, F.col("numvalidsamples").cast("int"))).alias("j", "_v"))
    y = F.col("_v") * F.lit(-bit_volts if inverted else bit_volts)
    if clip:
        y = F.when(F.abs(F.col("_v").cast("int")) < clip, y)
    return rows.withColumns({"t": F.col("timestamp") / 1e6 + F.col("j") / F.col("samplefreq"), "y": y}).drop("_v")


def unpack_points(points: str = "points") -> Column:
    """Video points from packed words: x and y (12 bits each) and the colour bits; empty words are left out."""
    return F.transform(F.filter(points, lambda p: p != 0), lambda p: F.struct(
        p.bitwiseAND(F.lit(0xFFF)).alias("x"), F.shiftright(p, 16).bitwiseAND(F.lit(0xFFF)).alias("y"),
        (F.shiftright(p, 15).bitwiseAND(F.lit(1)) == 1).alias("intensity"), F.shiftright(p, 28).bitwiseAND(F.lit(7)).alias("rgb"),
    ))


def write_interleaved(samples: DataFrame, folder: str, channels: list[int]) -> None:
    """int16 files of all channels, sample by sample (channel, i, y): range-sorted by sample, one file a task, in order of their names."""
    wide = samples.groupBy("i").pivot("channel", channels).agg(F.first("y")).fillna(0).repartitionByRange("i").sortWithinPartitions("i")
    register(samples.sparkSession)
    wide.select(*[F.col(str(c)).cast("short").alias(f"c{c}") for c in channels]).write.format("records").option("header", "false").mode("overwrite").save(folder)


TTL = r"TTL Input on (\S+) board (\d+) port (\d+) value \((0x[0-9A-Fa-f]+)\)"


def parse_ttl(events: DataFrame, column: str = "eventstring") -> DataFrame:
    """board_name, board, port and value of TTL input strings; other events are left out."""
    part = lambda i: F.regexp_extract(column, TTL, i)
    value = F.conv(F.substring(part(4), 3, 16), 16, 10).cast("long")
    return events.filter(F.col(column).rlike(TTL)).withColumns({"board_name": part(1), "board": part(2).cast("int"), "port": part(3).cast("int"), "value": value})


def ttl_pulses(events: DataFrame, keys: list[str], bit: int, minimum_us: int = 50_000, bucket: float = 3.6e9) -> DataFrame:
    """Pulses of one bit of each port: from a rising edge to the next falling one, longer than ``minimum_us``."""
    on = F.col("value").bitwiseAND(F.lit(1 << bit)) != 0
    by = [*keys, "port"]
    d = parse_ttl(events.filter("timestamp is not null")).select(*by, "timestamp", "rec_id", on.alias("_on"))
    edges = scan(d, by, ["timestamp", "rec_id"], bucket, _was=("lag", "_on")).filter(F.col("_on") != F.coalesce("_was", F.lit(False))).drop("_was")
    d = scan(edges, by, ["timestamp", "rec_id"], bucket, _next=("lead", "timestamp"))
    return d.filter(F.col("_on") & (F.col("_next") - F.col("timestamp") > minimum_us)).select(*by, F.col("timestamp").alias("start_us"), F.col("_next").alias("stop_us"))
