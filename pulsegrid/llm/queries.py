"""Queries and DuckDB SQL of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.garble import examine
from pulsegrid.llm.nearest import nearest_in_time
from pulsegrid.llm.packing import pack
from pulsegrid.llm.tokens import Encoder, encode
from pulsegrid.session import frozen, table

DIODE_MS, CSC_MS = 15, 200


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """TTL edges with the nearest position record (15 ms) and the nearest continuous record (200 ms) of their recording."""
    ttl = table(spark, d, "nlx_event").filter(F.ltrim(F.translate("eventstring", "\0", " ")).startswith("TTL Input")).select("rec_id", "session_id", "timestamp")
    diode = table(spark, d, "mwl_diode").select("rec_id", "session_id", (F.col("timestamp") * 100).alias("timestamp"))
    csc = table(spark, d, "nlx_csc").select("rec_id", "session_id", "timestamp")
    out = [
        nearest_in_time(ttl, other, ["session_id"], "timestamp", "rec_id", "timestamp", "rec_id", ms * 1000).select(F.col("rec_id").alias("event_rec_id"), F.lit(target).alias("target"), F.col("target_id").alias("target_rec_id"))
        for target, other, ms in (("diode", diode, DIODE_MS), ("csc", csc, CSC_MS))
    ]
    return out[0].unionByName(out[1])


P2_SQL = """
WITH ttl AS (SELECT rec_id, session_id, timestamp AS t FROM nlx_event WHERE ltrim(replace(eventstring, chr(0), ' ')) LIKE 'TTL Input%' AND timestamp IS NOT NULL),
     one AS (SELECT 'diode' AS target, session_id, timestamp * 100 AS t, min(rec_id) AS rec_id FROM mwl_diode WHERE timestamp IS NOT NULL GROUP BY ALL
             UNION ALL SELECT 'csc', session_id, timestamp, min(rec_id) FROM nlx_csc WHERE timestamp IS NOT NULL GROUP BY ALL),
     both_sides AS (
       SELECT l.rec_id AS event_rec_id, r.target, r.rec_id AS target_rec_id, l.t - r.t AS far FROM (SELECT ttl.*, x.target FROM ttl, (VALUES ('diode'), ('csc')) x(target)) l
         ASOF JOIN one r ON l.session_id = r.session_id AND l.target = r.target AND l.t >= r.t
       UNION ALL
       SELECT l.rec_id, r.target, r.rec_id, r.t - l.t FROM (SELECT ttl.*, x.target FROM ttl, (VALUES ('diode'), ('csc')) x(target)) l
         ASOF JOIN one r ON l.session_id = r.session_id AND l.target = r.target AND l.t <= r.t),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY event_rec_id, target ORDER BY far, target_rec_id) AS k FROM both_sides
                WHERE far <= CASE target WHEN 'diode' THEN 15000 ELSE 200000 END)
SELECT event_rec_id, target, target_rec_id FROM ranked WHERE k = 1
"""


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every document's token ids."""
    return encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document encoded and decoded again."""
    docs = table(spark, d, "documents")
    encoder = Encoder().fit(docs)
    return encoder.encode(docs.select("doc_id", "text"), "ids").select("doc_id", encoder.text(F.col("ids")).alias("text"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return frozen(Encoder().fit(docs).encode(docs.select("doc_id", "source", "text"), "size", count=True).drop("text"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Documents in containers of each capacity, by their size in tokens."""
    return pack(_sizes(spark, d), table(spark, d, "pack_sizes"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each source in each window of containers."""
    sizes = _sizes(spark, d)
    packed = pack(sizes, table(spark, d, "pack_sizes"))
    return packed.join(sizes.select("doc_id", "source"), "doc_id").groupBy("pack_name", "window_no", "source").agg(F.sum("n_tokens").alias("tokens"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which all or a passage was read in the wrong encoding."""
    return examine(table(spark, d, "documents")).filter("found").select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """The texts given back, with the swap that was undone; texts with lost characters only have none."""
    return examine(table(spark, d, "documents")).filter("found and swap is not null").select("doc_id", "swap", "restored")


QUERIES = {f.__name__: f for f in (p2_found, p6_ids, p6_decoded, p7_packed, p7_mixture, p8_found, p8_restored)}
ORACLES: dict[str, str] = {"p2_found": P2_SQL, "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
