"""Text decoded with the wrong character encoding: found and restored by per-source substitution ciphers learned by EM.

A wrong decoding replaces letters by symbols: one character for one letter if both code pages are single-byte, a sequence of
two to four characters for one letter if the bytes were UTF-8. Each such swap is a substitution cipher. Per source, EM learns
which ciphers occur, how often, and which symbol stands for which letter, against bigrams of each language that it
re-estimates at the same time:

* E-step, over the distinct tokens with a character beyond ASCII: each is explained as clean or as the ciphertext of one
  cipher, by the bigram likelihood of its reading times the cipher's share in the source. Responsibilities give the bigrams
  of the languages and, per source and cipher, the counts of neighbouring observed characters (bounded by the alphabets).
* M-step (``decipher``): per source and cipher, an inner EM over those pair counts estimates P(symbol | letter) for every
  letter of the corpus' alphabet: the hidden pair of letters comes from the language's bigrams, ASCII stands for itself. The
  tables of public code pages are a Dirichlet prior of weight PAGE_WEIGHT, no more: a symbol that the text contradicts moves.

A swap of no listed page is learned as a free cipher, per source and language, with no prior on its letters: its symbols are
those that shun the documents that hold the language's own commonest letters. If the learned letters agree with some pair of
code pages the interpreter knows, that pair becomes the prior of the letters too rare to learn. The learned table of a
single-byte cipher is applied with ``translate``; sequences from UTF-8 are read token by token. A replacement character
(U+FFFD) is the trace of a wrong decoding by itself, but the letter is lost.
"""

from __future__ import annotations

import encodings.aliases
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import frozen

# Code pages whose bytes are taken for another's, as (bytes of, read as). They seed ciphers; others are learned freely.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859-2", "cp852", "cp866", "koi8-r")
BYTES_OF = ("cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "iso8859-2", "iso8859-5", "koi8-r", "mac_roman", "mac_cyrillic", "mac_latin2")
SINGLE = tuple((right, wrong) for right in BYTES_OF for wrong in ("cp1252", "latin-1")) + tuple(("cp1252", wrong) for wrong in READ_AS[2:] + ("iso8859-5",))
UTF8 = tuple(f"utf-8>{page}" for page in READ_AS)
FREE = "free"
SWAPS = UTF8 + tuple(f"{a}>{b}" for a, b in SINGLE) + (FREE,)

#: Commonest letters beyond ASCII of a language that tell its own documents.
ANCHORS = 3

LOST = "�"
START, END = "\x02", "\x03"
#: All characters beyond the basic plane count as this one letter.
ASTRAL = "\uffff"
#: EM rounds; the share a swap starts from; the least share a swap may have in a source; evidence of a one-character token; of any token.
ROUNDS, FIRST_SHARE, LEAST_SHARE, ONE_CHARACTER, MOST = 2, 0.005, 1e-4, 2.0, 12.0
#: A character is a letter of the model if it has this share of the tokens' characters, for at most LETTERS of them (others are one unknown letter).
LEAST_LETTER, LETTERS = 1e-6, 1023
#: Sources with ciphers of their own; if there are more, sources share ciphers by hash, so the model stays bounded.
SOURCES = 1024
#: Weight of the all-language bigrams within a language, and of the even distribution within those.
LANGUAGE_PRIOR, EVEN_PRIOR, EVEN = 20.0, 2.0, 1e-4
#: Weight of a code page's letter in the M-step, in occurrences; iterations of the inner EM (with a page, without one); share from which a letter counts as one of a language's.
PAGE_WEIGHT, INNER, INNER_FREE, RARE = 20.0, 6, 40, 1e-5
#: Least occurrences and symbols of a free cipher, and the share of them that a code page has to explain to become its prior.
FREE_WEIGHT, FREE_SYMBOLS, AGREE = 60.0, 5, 0.55


def _decode_table(page: str) -> list[str | None]:
    """Character of each byte; where a Windows page leaves a byte undefined, the control character that readers pass through."""
    out: list[str | None] = []
    for b in range(256):
        try:
            c = bytes([b]).decode(page)
        except UnicodeDecodeError:
            c = chr(b) if page.startswith("cp125") else ""
        out.append(c if len(c) == 1 else None)
    return out


@lru_cache(maxsize=None)
def _single_table(right: str, wrong: str) -> dict[str, str]:
    """Pairs of a single-byte swap: observed character -> letter."""
    return {w: r for w, r in zip(_decode_table(wrong)[128:], _decode_table(right)[128:]) if w is not None and r is not None and w != r}


@lru_cache(maxsize=None)
def pages() -> dict[str, list[str | None]]:
    """Every single-byte code page the interpreter knows whose lower half is ASCII."""
    out: dict[str, list[str | None]] = {}
    for name in sorted(set(encodings.aliases.aliases.values())):
        try:
            table = _decode_table(name)
        except (LookupError, UnicodeError, ValueError, AttributeError):
            continue
        if table[:128] == [chr(i) for i in range(128)] and sum(c is not None and ord(c) > 127 for c in table[128:]) > 40 and table not in out.values():
            out[name] = table
    return out


@lru_cache(maxsize=None)
def _utf8_units(page: str) -> tuple[re.Pattern, dict[str, int]]:
    """Pattern of the symbols that UTF-8 sequences become when read as ``page``, and the page's bytes."""
    table = _decode_table(page)
    byte = {c: b for b, c in enumerate(table) if c is not None}
    part = lambda a, b: "[" + "".join(re.escape(c) for c in table[a:b] if c is not None) + "]"
    more = part(0x80, 0xC0)
    return re.compile(f"{part(0xF0, 0xF5)}{more}{{3}}|{part(0xE0, 0xF0)}{more}{{2}}|{part(0xC2, 0xE0)}{more}"), byte


def _read_utf8(text: str, page: str) -> str:
    pattern, byte = _utf8_units(page)

    def letter(m: re.Match) -> str:
        try:
            return bytes(byte[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return pattern.sub(letter, text)


@lru_cache(maxsize=None)
def _utf8_pairs(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Which characters begin a symbol of ``page``, and which go on with one."""
    table = _decode_table(page)
    out = np.zeros((2, 1 << 16), dtype=bool)
    for kind, (a, z) in enumerate(((0xC2, 0xF5), (0x80, 0xC0))):
        out[kind, [ord(c) for c in table[a:z] if c is not None]] = True
    return out[0], out[1]


@lru_cache(maxsize=50_000)
def utf8_readings(text: str, page: str) -> list[str]:
    """What a token reads as if its UTF-8 bytes were read as ``page``, read again (by its page or a Western one) while that changes it."""
    read = _read_utf8(text, page)
    found, last = [], [read] if read != text else []
    while last:  # each reading is shorter than the one before
        found += last
        last = list(dict.fromkeys(y for x in last for again in dict.fromkeys((page, "cp1252", "latin-1")) if (y := _read_utf8(x, again)) != x and y not in found))
    return found


class Model:
    """Letters, bigrams by language (the last over all), and by source the log shares and the learned tables of the ciphers."""

    def __init__(self, letters: str, counts: np.ndarray, langs: dict[str, int], shares: dict[str, np.ndarray], tables: dict[tuple[str, str, str], dict[str, str]], aliens: dict[tuple[str, str], dict[str, float]]):
        self.letters, self.langs, self.shares, self.tables, self.aliens = letters, langs, shares, tables, aliens
        self.lut = np.zeros(1 << 16, dtype=np.int16)
        for i, c in enumerate(letters):
            self.lut[ord(c)] = i + 1
        every = counts.sum(axis=0)
        even = (every + EVEN_PRIOR * EVEN) / (every.sum(axis=1, keepdims=True) + EVEN_PRIOR)
        logs = np.empty(counts.shape, dtype=np.float32)
        logs[-1] = np.log(even)
        for i in range(len(counts) - 1):
            logs[i] = np.log((counts[i] + LANGUAGE_PRIOR * even) / (counts[i].sum(axis=1, keepdims=True) + LANGUAGE_PRIOR))
        self.logs = logs
        self.firsts = counts.sum(axis=2) / np.maximum(counts.sum(axis=(1, 2)), 1.0)[:, None]  # share of each letter
        self.firsts[-1] = every.sum(axis=1) / max(every.sum(), 1.0)
        self.unknown = bool(self.firsts[-1][0] > 1e-4)  # letters beyond LETTERS are usual in this corpus
        self._luts: dict[tuple, np.ndarray] = {}

    def cut(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of START token END ..., and where each token begins."""
        codes = np.frombuffer("".join(START + t + END for t in tokens).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.concatenate([[0], np.cumsum([len(t) + 2 for t in tokens])[:-1]]).astype(np.int64)
        return np.minimum(codes, ord(ASTRAL)), at

    def likelihood(self, idx: np.ndarray, lang: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log likelihood of each token, from its letters and its language at each character."""
        steps = self.logs[lang[:-1], idx[:-1], idx[1:]]
        steps[at[1:] - 1] = 0  # from one token's END to the next one's START
        return np.add.reduceat(steps, at)

    def table(self, key: str, lang: str, swap: str) -> dict[str, str]:
        if swap != FREE:
            return self.tables.get((key, "", swap), _single_table(*swap.split(">")))
        return self.tables.get((key, lang, FREE)) or self.tables.get(("", lang, FREE)) or {}

    def lut_of(self, key: str, lang: str, swap: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Letter of each character under a cipher (-1: no letter of the corpus), and the penalty of pairs that EM found no support for."""
        known = (key, lang if swap == FREE else "", swap)
        if known not in self._luts:
            if len(self._luts) > 512:
                self._luts.clear()
            table = self.table(key, lang, swap)
            if not table:
                self._luts[known] = None
            else:
                lut, fine = self.lut.copy(), np.zeros(1 << 16, dtype=np.float32)
                seed = {} if swap == FREE else _single_table(*swap.split(">"))
                for c, letter in {**seed, **table}.items():
                    i = self.lut[ord(letter)] if ord(letter) < 1 << 16 else 0
                    lut[ord(c)] = i if i or self.unknown else -1
                    if self.tables and swap != FREE and known not in self.tables or c not in table:
                        fine[ord(c)] = 2.0
                self._luts[known] = lut, fine
        return self._luts[known]

    def share(self, key: str) -> np.ndarray:
        return self.shares.get(key, np.full(len(SWAPS), math.log(LEAST_SHARE if self.shares else FIRST_SHARE)))

    def lang(self, name: str) -> int:
        return self.langs.get(name, len(self.logs) - 1)

    def evidence(self, key: str, langs: list[str], tokens: list[str]) -> tuple[np.ndarray, dict[tuple[int, int], str]]:
        """Log likelihood ratio of each token's reading under each swap (-inf where it has none), and the readings of the UTF-8 swaps."""
        out = np.full((len(tokens), len(SWAPS)), -np.inf, dtype=np.float32)
        reads: dict[tuple[int, int], str] = {}
        if not tokens:
            return out, reads
        codes, at = self.cut(tokens)
        size = np.diff(np.append(at, len(codes)))
        token_lang = np.array([self.lang(g) for g in langs])
        lang, idx = np.repeat(token_lang, size), self.lut[codes]
        seen = self.likelihood(idx, lang, at)
        for z in range(len(UTF8), len(SWAPS)):
            groups = sorted(set(langs)) if SWAPS[z] == FREE else [""]
            for g in groups:
                found = self.lut_of(key, g, SWAPS[z])
                if found is None:
                    continue
                lut, fine = found
                read = lut[codes]
                bad = np.logical_or.reduceat(read < 0, at)
                changed = np.logical_or.reduceat(read != idx, at) & ~bad
                if SWAPS[z] == FREE:
                    changed &= token_lang == self.lang(g)
                if not changed.any():
                    continue
                some = np.repeat(changed, size)
                sub_at = np.concatenate([[0], np.cumsum(size[changed])[:-1]])
                ll = self.likelihood(read[some], lang[some], sub_at) - np.add.reduceat(fine[codes[some]], sub_at)
                out[changed, z] = ll - seen[changed]
        tried: list[tuple[int, int, str]] = []
        for z, page in enumerate(READ_AS):
            lead, more = _utf8_pairs(page)
            begins = np.append(lead[codes[:-1]] & more[codes[1:]], False)
            for t in np.flatnonzero(np.logical_or.reduceat(begins, at)):
                tried += [(t, z, r) for r in utf8_readings(tokens[t], page)]
        if tried:
            codes, at = self.cut([r for _, _, r in tried])
            idx = self.lut[codes]
            lang = np.repeat(token_lang[[t for t, _, _ in tried]], np.diff(np.append(at, len(codes))))
            ll, bad = self.likelihood(idx, lang, at), np.logical_or.reduceat(idx == 0, at) & (not self.unknown)
            for (t, z, r), x, no in zip(tried, ll, bad):
                if not no and x - seen[t] > out[t, z]:
                    out[t, z] = x - seen[t]
                    reads[t, z] = r
        single = np.array([len(t) == 1 for t in tokens])
        return np.minimum(out, np.where(single, ONE_CHARACTER, MOST)[:, None]), reads


STRIP = ".,:;()!?\"'[]/-"
PASSAGE = re.compile(r"([\r\n]+|(?<=[.!?])[ \t]+)")


def tokens(text: str) -> list[str]:
    """Tokens with a character beyond ASCII, without ASCII punctuation around them."""
    one = text.replace("\t", " ").replace("\r", " ").replace("\n", " ")  # splitting by one character is quick
    return [x.strip(STRIP) for x in one.split(" ") if not x.isascii()]


def language(lang: Column) -> Column:
    return F.coalesce(F.lower(F.substring(F.trim(lang), 1, 2)), F.lit("?"))


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id (if there), source key, lang, text. Up to SOURCES sources are their own key, more share keys by hash."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("?"))
    many = documents.select(source.alias("s")).distinct().limit(SOURCES + 1).count() > SOURCES
    key = F.concat(F.lit("#"), F.pmod(F.xxhash64(source), F.lit(SOURCES)).cast("string")) if many else source
    return documents.select(*[c for c in ("doc_id",) if c in documents.columns], key.alias("key"), language(F.col("lang")).alias("lang"), "text")


def vocabulary(keyed: DataFrame) -> DataFrame:
    """key, lang, token, n over the whole corpus."""
    beyond = lambda c: F.octet_length(c) > F.length(c)
    parts = keyed.filter(beyond("text")).select("key", "lang", F.explode(F.split("text", " ")).alias("part")).filter(beyond("part"))  # by one character, which is quick
    rows = parts.select("key", "lang", F.explode(F.split("part", r"[\t\r\n]+")).alias("token")).filter(beyond("token"))
    return rows.select("key", "lang", F.btrim("token", F.lit(STRIP)).alias("token")).groupBy("key", "lang", "token").agg(F.count(F.lit(1)).alias("n"))


SUMS = "kind string, key string, lang string, swap string, a int, b int, w double"


def _expect(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    """E-step over a part of the distinct tokens, summed up: shares, bigrams of letters, and per cipher the pairs of observed characters."""
    for batch in batches:
        for key, pdf in batch.groupby("key"):
            own, langs, n = pdf["token"].tolist(), pdf["lang"].tolist(), pdf["n"].to_numpy(float)
            found, reads = model.evidence(key, langs, own)
            logs = np.concatenate([np.zeros((len(own), 1)), found + model.share(key)], axis=1)
            weight = np.exp(logs - logs.max(axis=1, keepdims=True))
            weight *= (n / weight.sum(axis=1))[:, None]
            lost = np.array([LOST in t for t in own])
            weight[lost, 1:] = 0
            if not model.tables:  # the first round has no free cipher yet: symbols that shun the language's own letters make one
                alien = np.array([_alien(model.aliens.get((key, g), {}), t) for g, t in zip(langs, own)])
                alien[lost | (found[:, : len(UTF8)] > 0).any(axis=1)] = 0
                listed = alien * weight[:, len(UTF8) + 1 : -1].sum(axis=1)
                weight[:, -1] = weight[:, 0] * alien
                weight[:, 0] -= weight[:, -1]
            rows = [pd.DataFrame({"kind": "share", "key": key, "lang": "", "swap": ["", *SWAPS], "a": 0, "b": 0, "w": [n.sum(), *weight[:, 1:].sum(axis=0)]})]
            names, lang_no = np.unique(np.array(langs, dtype=object), return_inverse=True)

            def count(at_tokens: np.ndarray, texts: list[str], w: np.ndarray, kind: str, swap: str, luts: dict | None = None) -> None:
                """Weighted pairs of neighbouring letters (or, for a cipher's own pairs, of characters) in each language."""
                codes, at = model.cut(texts)
                size = np.diff(np.append(at, len(codes)))
                lang, steps = np.repeat(lang_no[at_tokens], size), np.repeat(w, size)
                seen = (model.lut[codes] if kind == "bigram" else codes).astype(np.int64)
                for g, lut in (luts or {}).items():
                    seen = np.where(lang == g, np.maximum(lut[codes], 0), seen)
                steps[at[1:] - 1] = 0
                pair, where = np.unique((lang[:-1].astype(np.int64) << 32) | (seen[:-1] << 16) | seen[1:], return_inverse=True)
                w = np.bincount(where, steps[:-1])
                keep = w > 0
                pair, w = pair[keep], w[keep]
                rows.append(pd.DataFrame({"kind": kind, "key": "" if kind == "bigram" else key, "lang": names[pair >> 32], "swap": swap, "a": pair >> 16 & 0xFFFF, "b": pair & 0xFFFF, "w": w}))

            if not model.tables and (some := np.flatnonzero(listed > 1e-3)).size:
                count(some, [own[t] for t in some], listed[some], "listed", FREE)
            for z in range(-1, len(SWAPS)):
                at_tokens = np.flatnonzero((weight[:, z + 1] > 1e-3) & ~lost)
                if not len(at_tokens):
                    continue
                w = weight[at_tokens, z + 1]
                texts = [own[t] if z < 0 or z >= len(UTF8) else reads[t, z] for t in at_tokens]
                if z >= len(UTF8):
                    count(at_tokens, texts, w, "pair", SWAPS[z])
                    if SWAPS[z] == FREE and not model.tables:
                        continue
                    found_luts = {g: model.lut_of(key, name, SWAPS[z]) for g, name in enumerate(names)}
                    count(at_tokens, texts, w, "bigram", "", {g: x[0] for g, x in found_luts.items() if x})
                else:
                    count(at_tokens, texts, w, "bigram", "")
            yield pd.concat(rows)


def _alien(table: dict[str, float], token: str) -> float:
    """Probability that a token is written in the symbols that shun the language's own letters."""
    odds = sum(math.log(p / (1 - p)) for c in token if not c.isascii() and (p := table.get(c, 0.05)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) if table else 0.0


def decipher(pairs: pd.DataFrame, model: Model, prior: dict[str, str] | None, rounds: int) -> tuple[dict[str, str], dict[str, float]]:
    """Learn symbol -> letter from counted pairs of observed characters (lang, a, b, w), by EM over P(symbol | letter).

    The hidden pair of letters follows the language's bigrams; ASCII stands for itself; ``prior`` is a code page's table. Gives the
    likeliest letter of each symbol and the symbols' weights. All sizes are bounded by the alphabets.
    """
    symbols = sorted({c for col in ("a", "b") for c in pairs[col].unique() if c > 127})
    use = np.zeros(len(model.letters) + 1)
    for lang, w in pairs.groupby("lang")["w"].sum().items():
        use += model.firsts[model.lang(lang)] * w
    usual = use > RARE * max(use.sum(), 1e-12)  # the letters of these languages, and those the page has
    own = np.array([i + 1 for i, c in enumerate(model.letters) if ord(c) > 127 and (usual[i + 1] or prior and c in set(prior.values()))])
    if not symbols or not len(own):
        return {}, {}
    at = {c: i for i, c in enumerate(symbols)}
    place = {model.letters[i - 1]: j for j, i in enumerate(own)}
    blocks, heavy = [], np.zeros(len(symbols))
    for lang, p in pairs.groupby("lang"):
        g = model.lang(lang)
        joint = np.exp(model.logs[g]) * model.firsts[g][:, None].astype(np.float32)
        a, b, w = (p[c].to_numpy() for c in ("a", "b", "w"))
        sa, sb = a > 127, b > 127
        ab = np.zeros((len(symbols), len(symbols)))
        np.add.at(ab, ([at[c] for c in a[sa & sb]], [at[c] for c in b[sa & sb]]), w[sa & sb])
        left, right = np.zeros((128, len(symbols))), np.zeros((128, len(symbols)))
        np.add.at(left, (a[~sa & sb], [at[c] for c in b[~sa & sb]]), w[~sa & sb])
        np.add.at(right, (b[sa & ~sb], [at[c] for c in a[sa & ~sb]]), w[sa & ~sb])
        ascii_ = model.lut[:128]
        blocks.append((ab, joint[np.ix_(own, own)], left, joint[np.ix_(ascii_, own)], right, joint[np.ix_(own, ascii_)].T))
        heavy += ab.sum(axis=0) + left.sum(axis=0)
    use = use[own] / max(use[own].sum(), 1e-12)
    start = np.zeros((len(own), len(symbols)))
    if prior:
        for c, letter in prior.items():
            if ord(c) in at and letter in place:
                start[place[letter], at[ord(c)]] = PAGE_WEIGHT
        emit = start + 1e-3
    else:  # a symbol is about as frequent as its letter
        emit = np.exp(-0.5 * (np.log(use + 1e-6)[:, None] - np.log(heavy / max(heavy.sum(), 1e-12) + 1e-6)[None, :]) ** 2) + 1e-6
    emit /= emit.sum(axis=1, keepdims=True)
    tiny = 1e-300
    total = start
    for _ in range(rounds):
        expected = np.zeros_like(emit)
        for ab, jo, left, jl, right, jr in blocks:
            if ab.any():
                ratio = ab / np.maximum(emit.T @ jo @ emit, tiny)
                expected += emit * (jo @ emit @ ratio.T) + emit * (jo.T @ emit @ ratio)
            for seen, j in ((left, jl), (right, jr)):
                expected += emit * (j.T @ (seen / np.maximum(j @ emit, tiny)))
        total = expected + start
        emit = total + 1e-3
        emit /= emit.sum(axis=1, keepdims=True)
    best = total.argmax(axis=0)
    names = list(place)
    return {chr(c): names[best[i]] for c, i in at.items() if heavy[i] >= 0.5}, {chr(c): float(heavy[i]) for c, i in at.items()}


def likely_page(table: dict[str, str], weights: dict[str, float]) -> tuple[str, dict[str, str]] | None:
    """The pair of known code pages that explains most of a learned table, by weight, if it explains AGREE of it."""
    best, name = 0.0, None
    total = sum(weights[c] for c in table)
    for wrong, seen in pages().items():
        byte = {c: i for i, c in enumerate(seen) if c is not None and i > 127}
        own = [(byte[c], letter, weights[c]) for c, letter in table.items() if c in byte]
        if sum(w for _, _, w in own) <= best:
            continue
        for right, letters in pages().items():
            fits = sum(w for i, letter, w in own if letters[i] == letter) if right != wrong else 0.0
            if fits > best:
                best, name = fits, (right, wrong)
    return (">".join(name), _single_table(*name)) if name and best >= AGREE * total else None


TABLES = "key string, lang string, swap string, symbol string, letter string"


def _maximise(pdf: pd.DataFrame, model: Model) -> pd.DataFrame:
    """M-step of one source and cipher: rows of its learned table."""
    key, swap, lang = pdf["key"].iloc[0], pdf["swap"].iloc[0], ""
    if swap == FREE:
        lang, table = pdf["lang"].iloc[0], {}
        aliens = model.aliens.get((key, lang), {})
        known = model.tables.get((key, lang, FREE))
        if model.tables:  # after the first round a free cipher goes on from what it has
            again, weights = decipher(pdf, model, known, INNER) if known else ({}, {})
            table = {**(known or {}), **{c: x for c, x in again.items() if weights[c] >= PAGE_WEIGHT and aliens.get(c, 0.0) > 0.5}}
            return pd.DataFrame([(key, lang, swap, c, x) for c, x in table.items()], columns=["key", "lang", "swap", "symbol", "letter"])
        seen = np.concatenate([pdf["b"].to_numpy(), [0]])
        heavy = np.array([aliens.get(chr(c), 0.0) > 0.5 for c in seen])[:-1]
        if pdf["w"].to_numpy()[heavy].sum() < FREE_WEIGHT or len(set(seen[:-1][heavy])) < FREE_SYMBOLS:
            return pd.DataFrame([], columns=["key", "lang", "swap", "symbol", "letter"])
        for own in (pdf, pdf[pdf["kind"] == "pair"]):  # with what a listed cipher may have half explained, or without
            learned, weights = decipher(own, model, None, INNER_FREE)
            learned = {c: x for c, x in learned.items() if aliens.get(c, 0.0) > 0.5 and x != c}
            if sum(x.isalpha() for x in learned.values()) < FREE_SYMBOLS or sum(weights[c] for c in learned) < FREE_WEIGHT:
                break
            page = likely_page(learned, weights)
            if not page:
                table = table or learned
                continue
            again, _ = decipher(own, model, page[1], INNER)
            moved = sum(weights[c] for c, x in learned.items() if weights[c] >= PAGE_WEIGHT and again.get(c) == x != page[1].get(c))
            if page[0] not in SWAPS or moved > (1 - AGREE) / 2 * sum(weights[c] for c in learned):
                table = {**page[1], **{c: x for c, x in again.items() if weights[c] >= PAGE_WEIGHT and aliens.get(c, 0.0) > 0.5}, "": str(sum(weights[c] for c in learned))}
                break
    else:
        seed = _single_table(*swap.split(">"))
        table, weights = decipher(pdf, model, seed, INNER)
        table = {c: x for c, x in table.items() if c in seed or (weights[c] >= PAGE_WEIGHT and x != c)}
    return pd.DataFrame([(key, lang, swap, c, x) for c, x in table.items()], columns=["key", "lang", "swap", "symbol", "letter"])


def _maximiser(model) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: _maximise(pdf, model.value)


def _aliens(keyed: DataFrame, anchors: dict[str, tuple[str, float]]) -> dict[tuple[str, str], dict[str, float]]:
    """Per source and language the symbols that occur mostly in documents short of the language's commonest letters, with that excess.

    ``anchors`` has those letters and their share of the language's symbols; a document is short of them below half of it.
    """
    if not anchors:
        return {}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
        for pdf in batches:
            for key, lang, text in zip(pdf["key"], pdf["lang"], pdf["text"]):
                letters, share = anchors.get(lang, ("", 0.0))
                beyond = len(text) - len(text.encode("ascii", "ignore"))
                own = beyond * share / 2 <= sum(text.count(c) for c in letters)
                for c in set(text) if letters else ():
                    if not c.isascii():
                        n = sums[key, lang, c]
                        n[0] += 1
                        n[1] += own
                if letters:
                    n = sums[key, lang, ""]
                    n[0] += 1
                    n[1] += own
        yield pd.DataFrame([(*k, *n) for k, n in sums.items()], columns=["key", "lang", "symbol", "n", "own"])

    beyond = keyed.filter(F.octet_length("text") > F.length("text")).select("key", "lang", "text")
    rows = beyond.mapInPandas(counted, "key string, lang string, symbol string, n long, own long")
    sums = rows.groupBy("key", "lang", "symbol").agg(F.sum("n").alias("n"), F.sum("own").alias("own")).filter("n >= 5").collect()  # bounded by the alphabets
    base = {(r.key, r.lang): r.own / r.n for r in sums if r.symbol == ""}
    out: dict = defaultdict(dict)
    for r in sums:
        usual = base.get((r.key, r.lang), 0.0)
        if r.symbol and usual > 0.2 and not unicodedata.combining(r.symbol[0]):  # decomposed accents are correct text
            out[r.key, r.lang][r.symbol] = min(0.98, max(0.02, 1 - r.own / r.n / usual))
    return {k: v for k, v in out.items() if any(p > 0.5 for p in v.values())}


def fit(documents: DataFrame, rounds: int = ROUNDS) -> Model:
    """Learn the ciphers of every source from the whole corpus. What is collected is bounded by the alphabets and SOURCES."""
    return _fit(_keyed(documents), rounds)


def _fit(keyed: DataFrame, rounds: int) -> Model:
    spark = keyed.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    words = frozen(vocabulary(keyed).repartition(tasks, "token"))  # a fixed number: the table is small but costly per row
    framed = words.select("lang", F.concat(F.lit(START), "token", F.lit(END)).alias("t"), "n").filter(~F.col("token").contains(LOST))
    at = F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring("t", i, F.lit(2)))
    plane = lambda c: c if ord(c) <= 0xFFFF else ASTRAL
    first = [(r.lang, plane(r.ab[0]), plane(r.ab[1]), r.n) for r in framed.select("lang", F.explode(at).alias("ab"), "n").groupBy("lang", "ab").agg(F.sum("n").alias("n")).collect() if len(r.ab) == 2]
    use: dict[str, float] = defaultdict(float)
    own: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for lang, a, _, n in first:
        use[a] += n
        if not a.isascii() and a.isalpha():
            own[lang][a] += n
    total = sum(use.values())
    ascii_ = [chr(i) for i in range(128)]
    beyond = sorted((c for c, n in use.items() if not c.isascii() and n >= LEAST_LETTER * total), key=lambda c: (-use[c], c))
    letters = "".join(ascii_ + beyond[: LETTERS - 128])
    langs = {g: i for i, g in enumerate(sorted({lang for lang, *_ in first} - {"?"}))}
    place = {c: i + 1 for i, c in enumerate(letters)}
    shape = (len(langs) + 1, len(letters) + 1, len(letters) + 1)
    counts = np.zeros(shape)
    for lang, a, b, n in first:
        counts[langs.get(lang, len(langs)), place.get(a, 0), place.get(b, 0)] += n
    anchors = {}
    for g, x in own.items():
        top = sorted(x, key=lambda c: (-x[c], c))[:ANCHORS]
        anchors[g] = "".join(top), sum(x[c] for c in top) / sum(x.values())
    anchors.pop("?", None)
    aliens = _aliens(keyed, anchors)
    model = Model(letters, counts, langs, {}, {}, aliens)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        sums = words.mapInPandas(lambda batches, m=sent: _expect(batches, m.value), SUMS)
        sums = frozen(sums.groupBy("kind", "key", "lang", "swap", "a", "b").agg(F.sum("w").alias("w")))
        counts, shares = np.zeros(shape), defaultdict(dict)
        for r in sums.filter("kind in ('share', 'bigram')").collect():
            if r.kind == "bigram":
                counts[langs.get(r.lang, len(langs)), r.a, r.b] += r.w
            else:
                shares[r.key][r.swap] = r.w
        logs = {k: np.log(np.maximum(LEAST_SHARE, np.array([x.get(s, 0.0) for s in SWAPS]) / max(x.get("", 0.0), 1.0))) for k, x in shares.items()}
        better = spark.sparkContext.broadcast(Model(letters, counts, langs, logs, model.tables, aliens))
        pairs = sums.filter("kind in ('pair', 'listed')").withColumn("_free", F.when(F.col("swap") == FREE, F.col("lang")).otherwise(F.lit("")))
        heavy = pairs.groupBy("key", "swap", "_free").agg(F.sum("w").alias("_w")).filter("_w >= 2").drop("_w")
        pairs = pairs.join(heavy, ["key", "swap", "_free"]).repartition(tasks, "key", "swap", "_free")  # few rows, but costly groups
        learned = pairs.groupBy("key", "swap", "_free").applyInPandas(_maximiser(better), TABLES).collect()
        tables: dict = defaultdict(dict)
        for k, t in model.tables.items():
            if k[2] == FREE and not k[0]:
                tables[k] = t
        for r in learned:
            tables[r.key, r.lang, r.swap][r.symbol] = r.letter
        paged = {k: float(t.pop("")) for k, t in tables.items() if "" in t}
        for k in sorted(paged, key=paged.get):  # a free cipher that a code page explains is tried in all sources, and instead of a blind one
            tables["", k[1], FREE] = tables[k]
        if paged:
            for k in [k for k in tables if k[2] == FREE and k not in paged and ("", k[1], FREE) in tables and k[0]]:
                del tables[k]
        model = Model(letters, counts, langs, logs, dict(tables) or {("", "", ""): {}}, aliens)
        sent.unpersist()
        better.unpersist()
    return model


def inspect(model: Model, keys: list[str], langs: list[str], texts: list[str | None]) -> list[tuple[bool, str | None, list[str] | None, list[bool] | None]]:
    """(found, swap, passages, which of them are ciphertext) of each text; UTF-8 sequences in the passages are read already.

    A passage adds up its tokens' evidence for each swap, the text the positive sums of its passages and the swap's share.
    """
    number: dict[tuple[str, str, str], int] = {}
    own: list[set[int]] = []
    for key, lang, text in zip(keys, langs, texts):
        found = set() if not text or text.isascii() else {number.setdefault((key, lang, t), len(number)) for t in set(tokens(text)) if LOST not in t}
        own.append(found)
    ratios, reads = np.full((len(number), len(SWAPS)), -np.inf, dtype=np.float32), {}
    every = list(number)
    by_key: dict[str, list[int]] = defaultdict(list)
    for i, (key, _, _) in enumerate(every):
        by_key[key].append(i)
    for key, at in by_key.items():
        ratios[at], some = model.evidence(key, [every[i][1] for i in at], [every[i][2] for i in at])
        reads.update({(at[t], z): r for (t, z), r in some.items()})
    suspicious = (ratios > 0).any(axis=1)
    sums_of = np.where(np.isfinite(ratios), ratios, 0)
    out: list = []
    for key, lang, text, ids in zip(keys, langs, texts, own):
        lost = bool(text) and LOST in text
        if not any(suspicious[i] for i in ids):
            out.append((lost, None, None, None))
            continue
        parts = PASSAGE.split(text)
        inside = [sorted({number[key, lang, t] for t in tokens(p) if LOST not in t}) if not p.isascii() else [] for p in parts]
        sums = np.array([sums_of[i].sum(axis=0) if i else np.zeros(len(SWAPS)) for i in inside])
        scores = np.where(sums > 0, sums, 0).sum(axis=0)
        scores = np.where(scores > 0, scores + model.share(key), -np.inf)
        z = int(scores.argmax())
        if scores[z] <= 0:
            out.append((lost, None, None, None))
            continue
        hit = (sums[:, z] > 0).tolist()
        if z < len(UTF8):
            for j, ids_in in enumerate(inside):
                if hit[j]:
                    for i in sorted(ids_in, key=lambda i: -len(every[i][2])):
                        if ratios[i, z] > 0:
                            parts[j] = parts[j].replace(every[i][2], reads[i, z])
            hit = [False] * len(parts)
        out.append((True, SWAPS[z], parts, hit))
    return out


def examine(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, found, swap, restored for every document.

    Null and empty texts are not cases and come back unchanged; a text that lost characters (U+FFFD) is a case even where
    nothing can be restored; an unknown source or language is one of its own. Whole texts are read; other columns are ignored.
    """
    keyed = _keyed(documents)
    model = model or _fit(keyed, ROUNDS)
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = inspect(sent.value, pdf["key"].tolist(), pdf["lang"].tolist(), pdf["text"].tolist())
            out = pd.DataFrame(found, columns=["found", "swap", "parts", "hit"])
            yield pdf[["doc_id", "key", "lang"]].assign(text=pdf["text"].where(out["swap"].isna()), found=out["found"], swap=out["swap"], parts=out["parts"], hit=out["hit"])

    kind = dict(documents.dtypes)["doc_id"]
    rows = keyed.mapInPandas(run, f"doc_id {kind}, key string, lang string, text string, found boolean, swap string, parts array<string>, hit array<boolean>")
    seeds = {s: _single_table(*s.split(">")) for s in SWAPS[len(UTF8) : -1]}
    free = sorted({g for _, g, s in model.tables if s == FREE})
    full = [(k, g, s, {**seeds.get(s, {}), **model.table(k, g, s)}) for k in model.shares for s in SWAPS[len(UTF8) :] for g in (free if s == FREE else [""])]
    ciphers = spark.createDataFrame([(k, g, s, "".join(t), "".join(t.values())) for k, g, s, t in full], "key string, _lang string, swap string, _from string, _to string")
    rows = rows.withColumn("_lang", F.when(F.col("swap") == FREE, F.col("lang")).otherwise(F.lit("")))
    rows = rows.join(F.broadcast(ciphers), ["key", "_lang", "swap"], "left")  # bounded by SOURCES and the alphabets
    read = F.array_join(F.zip_with("parts", "hit", lambda p, h: F.when(h & F.col("_from").isNotNull(), F.call_function("translate", p, F.col("_from"), F.col("_to"))).otherwise(p)), "")
    return rows.select("doc_id", "found", "swap", F.when(F.col("swap").isNotNull(), read).otherwise(F.col("text")).alias("restored"))
