"""Encoding a corpus with a public byte-level BPE tokenizer, by Spark higher-order functions.

A text is split into words by the vocabulary's pattern. A word is folded: it begins as its single bytes (two hex digits
each), and each step merges the leftmost pair of the lowest rank, looked up in a literal rank map, until no pair has a rank.
The distinct words of the corpus are counted; the most frequent ``DICTIONARY`` of them are folded once and form a second
literal map of bounded size. A document is then encoded where it lies: words in the dictionary are looked up, all others are
folded on the spot, so no text is shuffled and no word is left out.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pulsegrid.session import frozen

#: Default folder of the vocabulary files; pass ``folder`` to use another.
FOLDER = os.environ.get("PULSEGRID_TOKENIZERS", "/opt/tokenizers")
#: Most words kept in the literal dictionary (a bound on what is collected and sent to tasks).
DICTIONARY = 50_000
BUCKETS = 8192
#: Bytes of a word from which its text is encoded with a merge queue.
LONG = 512

# The splitting pattern of this vocabulary, with white space spelled out as Unicode defines it.
SPACE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


@lru_cache(maxsize=4)
def ranks(name: str = "byte_bpe_50k", folder: str = FOLDER) -> dict[bytes, int]:
    """The vocabulary's byte sequences with their ranks, which are the token ids."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def bucket(text: str) -> int:
    return zlib.crc32(text.encode()) % BUCKETS


def literal_map(entries: dict[str, object], kind: str) -> Column:
    """A constant array of small maps, found by the hash of the key (a plain map is searched from end to end)."""
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for k, v in entries.items():
        buckets[bucket(k)][k] = v
    return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False, separators=(",", ":"))), f"array<map<string,{kind}>>")


def look_up(maps: Column, key: Column) -> Column:
    return F.try_element_at(F.get(maps, F.pmod(F.crc32(key.cast("binary")), F.lit(BUCKETS)).cast("int")), key)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def fold_word(word: Column, maps: Column) -> Column:
    """The token ids of one non-empty word: ranked merges folded over its bytes."""

    def merge(state: Column, at: Column) -> Column:
        pieces, pairs = state["pieces"], state["pairs"]
        merged = F.concat(F.get(pieces, at - 1), F.get(pieces, at))
        none = F.array().cast("array<int>")

        def joined(new: Column) -> Column:
            left = F.when(at > 1, F.array(look_up(maps, F.concat(F.get(pieces, at - 2), new)))).otherwise(none)
            right = F.when(at + 1 < F.size(pieces), F.array(look_up(maps, F.concat(new, F.get(pieces, at + 1))))).otherwise(none)
            return F.struct(
                F.concat(F.slice(pieces, 1, at - 1), F.array(new), F.slice(pieces, at + 2, F.size(pieces))).alias("pieces"),
                F.concat(F.slice(pairs, 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(pairs, at + 2, F.size(pairs) + 1)).alias("pairs"),
            )

        return let(merged, joined)

    def step(state: Column, _: Column) -> Column:
        return let(F.array_position(state["pairs"], F.array_min(state["pairs"])).cast("int"), lambda at: F.when(at > 0, merge(state, at)).otherwise(state))

    def fold(digits: Column) -> Column:
        n = (F.length(digits) / 2).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, i * 2 + 1, F.lit(2)))
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: look_up(maps, F.substring(digits, i * 2 + 1, F.lit(4))))).otherwise(F.array().cast("array<int>"))
        steps = F.when(n > 1, F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        end = F.aggregate(steps, F.struct(pieces.alias("pieces"), pairs.alias("pairs")), step)
        return F.transform(end["pieces"], lambda p: look_up(maps, p))

    return let(F.hex(F.encode(word, "UTF-8")), fold)


def merge_queue(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The token ids of one word by a queue of its ranked pairs (lowest rank first, then leftmost): n log n steps."""
    pieces = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(pieces) + 1)), list(range(-1, len(pieces) - 1))
    queue: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(pieces) and (r := rank.get(both := pieces[i] + pieces[after[i]])) is not None:
            heapq.heappush(queue, (r, i, both))

    for i in range(len(pieces) - 1):
        offer(i)
    while queue:
        _, i, both = heapq.heappop(queue)
        j = after[i] if pieces[i] else len(pieces)
        if j >= len(pieces) or pieces[i] + pieces[j] != both:
            continue  # one of the two was merged since
        pieces[i], pieces[j] = both, b""
        after[i] = after[j]
        if after[i] < len(pieces):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [rank[p] for p in pieces if p]


def words_of(text: Column) -> Column:
    """The words of a text in order; none for an empty or null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), 0)


class Encoder:
    """A vocabulary as Spark expressions. ``fit`` counts the words of a corpus and folds the frequent ones."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = FOLDER, dictionary: int = DICTIONARY):
        self.ranks, self.limit, self.frequent, self.longest = ranks(name, folder), dictionary, {}, 0
        self.maps = literal_map({k.hex().upper(): v for k, v in self.ranks.items()}, "int")

    def fit(self, documents: DataFrame, text: str = "text") -> Encoder:
        """Fold the most frequent distinct words of the whole corpus once (at most ``dictionary``, by count, then by word)."""
        seen = Observation()
        words = documents.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        words = words.observe(seen, F.max(F.octet_length("word")).alias("longest"))
        top = words.orderBy(F.desc("n"), "word").limit(self.limit)
        top = frozen(top.filter(F.octet_length("word") <= LONG).repartition("word"))
        folded = top.select("word", let(self.maps, lambda m: fold_word(F.col("word"), m)).alias("ids"))
        # as an RDD: a SQL execution writes out its plan on the driver, literal maps and all, anew at the end of each of its stages
        self.frequent = {r.word: list(r.ids) for r in folded.rdd.collect()}
        self.longest = seen.get["longest"] or 0
        return self

    def encode(self, documents: DataFrame, column: str, count: bool = False, text: str = "text") -> DataFrame:
        """Add the ids of ``text`` (or, ``count``, their number) as ``column``; texts with a word of over LONG bytes by the merge queue."""
        folded = self.sizes if count else self.ids
        if self.longest <= LONG:
            return documents.withColumn(column, folded(F.col(text)))
        is_long = F.coalesce(F.col(text).rlike(rf"[^\s]{{{LONG // 4},}}|\s{{{LONG // 4},}}"), F.lit(False))
        short = documents.filter(~is_long).withColumn(column, folded(F.col(text)))
        rank = documents.sparkSession.sparkContext.broadcast(self.ranks)  # the vocabulary

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import regex  # only workers that meet such texts need it

            pattern = regex.compile(PATTERN)
            for pdf in batches:
                ids = [[i for w in pattern.findall(t) for i in merge_queue(w.encode(), rank.value)] for t in pdf[text]]
                yield pdf.assign(**{column: [len(x) for x in ids] if count else ids})

        kind = "int" if count else "array<int>"
        schema = ", ".join(f"`{c}` {t}" for c, t in documents.dtypes) + f", `{column}` {kind}"
        return short.unionByName(documents.filter(is_long).mapInPandas(run, schema))

    def ids(self, text: Column) -> Column:
        """array<int>: the ids of a text, without special tokens; empty for an empty or null text."""
        words = words_of(text)
        if not self.frequent:
            return let(self.maps, lambda m: F.flatten(F.transform(words, lambda w: fold_word(w, m))))
        known = literal_map(self.frequent, "array<int>")
        return let(F.struct(self.maps.alias("m"), known.alias("d")), lambda s: F.flatten(F.transform(words, lambda w: F.coalesce(look_up(s["d"], w), fold_word(w, s["m"])))))

    def sizes(self, text: Column) -> Column:
        """The number of tokens of a text."""
        words = words_of(text)
        if not self.frequent:
            return F.size(self.ids(text))
        counts = literal_map({w: len(i) for w, i in self.frequent.items()}, "int")
        size = lambda s, w: F.coalesce(look_up(s["d"], w), F.size(fold_word(w, s["m"])))
        return let(F.struct(self.maps.alias("m"), counts.alias("d")), lambda s: F.aggregate(words, F.lit(0), lambda n, w: n + size(s, w)))

    def text(self, ids: Column) -> Column:
        """Decode: the tokens' binary pieces, concatenated. Ids outside the vocabulary give null."""
        pieces = [""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            pieces[rank] = piece.hex()
        table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")

        def joined(found: Column) -> Column:
            return F.when(~F.exists(found, lambda p: p.isNull()), F.decode(F.unhex(F.array_join(found, "")), "UTF-8"))

        return let(table, lambda t: let(F.transform(ids, lambda i: F.get(t, i)), joined))


def encode(documents: DataFrame, spark: SparkSession | None = None, **options) -> DataFrame:
    """doc_id, ids of every document; both an empty and a null text give the empty list. Other columns are ignored."""
    encoder = Encoder(**options).fit(documents)
    return encoder.encode(documents.select("doc_id", "text"), "ids").select("doc_id", "ids")
