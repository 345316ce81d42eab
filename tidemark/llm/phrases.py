"""Lempel-Ziv phrase fingerprints.

A text is cut into tokens and parsed left to right into phrases, each the
shortest run of tokens that is not a phrase yet. The set of phrases is hashed, the hashes are dealt to bins by
their low bits, and a bin keeps the least hash: two texts agree in a bin about
as often as their phrase sets overlap, which grows with how much of one text
helps to compress the other.

Defined cases: a null text counts as empty; a text without phrases has the empty
fingerprint, which is like another empty one (1) and nothing else (0); a phrase
that the end cuts short counts; a text of any length has one dictionary, whose
memory grows with its phrases; empty bins of both texts are left out; equal
texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import mix64

BINS = 128
#: Value of a bin without phrases.
EMPTY = 0xFFFF
FACTOR = 0x9E3779B97F4A7C15
#: A token is what lies between spaces; longer ones are cut into runs of up to eight letters with what follows them.
LONG = 48
PART = re.compile(r"\w{1,8}\W*+|\W+")
NONE = np.iinfo(np.uint64).max
#: Hashes of tokens that a task remembers.
MEMORY = 1 << 18


class TokenHashes(dict):
    """64-bit hash of each token, remembered."""

    def __missing__(self, token: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        found = self[token] = xxhash.xxh64_intdigest(token)
        return found


def tokens_of(text: str) -> list[str]:
    tokens = text.split(" ")
    if max(map(len, tokens)) > LONG:
        tokens = [part for token in tokens for part in (PART.findall(token) if len(token) > LONG else (token,))]
    return tokens


def parse(tokens: list[str], root: dict, node: dict, made: list | None = None) -> tuple[list[int], dict]:
    """Where each phrase ends, counted in tokens, and the node of the open phrase.

    ``made`` gets what is added to the dictionary, for taking it back.
    """
    ends = []
    for end, token in enumerate(tokens, 1):
        inner = node.get(token)
        if inner is None:
            node[token] = {}
            ends.append(end)
            if made is not None:
                made.append((node, token))
            node = root
        else:
            node = inner
    return ends, node


def _bins() -> np.ndarray:
    return np.full(BINS, NONE, np.uint64)


def _packed(least: np.ndarray) -> bytes:
    """16 bits of each bin, so that a fingerprint is small to shuffle."""
    return np.where(least == NONE, EMPTY, mix64(least) % np.uint64(EMPTY)).astype(">u2").tobytes()


def _codes(tokens: list[str], hashes: TokenHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))


def fingerprint_of(text: str, hashes: TokenHashes) -> bytes:
    if not text:
        return b""
    tokens, least, root = tokens_of(text), _bins(), {}
    ends, node = parse(tokens, root, root)
    _collect(_codes(tokens, hashes), ends if node is root else [*ends, len(tokens)], least)
    return _packed(least)


def fingerprints_of_edit(text: str, cut: int, tail: str, hashes: TokenHashes) -> tuple[bytes, bytes]:
    """Fingerprints of ``text`` and of its first ``cut`` characters with ``tail`` behind.

    What both start with is parsed once: the phrases that the rest of the text
    adds are taken out of the dictionary again before the other rest is parsed.
    """
    edited = text[:cut] + tail
    space = text.rfind(" ", 0, cut)
    if space < 0:
        return fingerprint_of(text, hashes), fingerprint_of(edited, hashes)
    head, root, made = tokens_of(text[:space]), {}, []
    ends, fork = parse(head, root, root)
    codes, least = _codes(head, hashes), _bins()
    _collect(codes, ends, least)
    open_codes = codes[ends[-1]:] if ends else codes
    out = []
    for rest in (text[space + 1:], edited[space + 1:]):
        tokens, bins = tokens_of(rest), least.copy()
        own, node = parse(tokens, root, fork, made)
        own = own if node is root else [*own, len(tokens)]
        _collect(np.concatenate([open_codes, _codes(tokens, hashes)]), [e + len(open_codes) for e in own], bins)
        out.append(_packed(bins))
        for place, token in reversed(made):
            del place[token]
        made.clear()
    return out[0], out[1]


def _collect(codes: np.ndarray, phrase_ends: list[int], least: np.ndarray) -> None:
    """Puts the hash of every phrase into its bin."""
    n, ends = len(codes), np.array(phrase_ends, np.int64)
    if not len(ends):
        return
    powers = np.ones(n + 1, np.uint64)
    powers[1:] = np.uint64(FACTOR)
    powers = np.cumprod(powers)                                 # wraps modulo 2^64
    inverse = np.ones(n + 1, np.uint64)
    inverse[1:] = np.uint64(pow(FACTOR, -1, 1 << 64))
    inverse = np.cumprod(inverse)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[:-1])])
    starts = np.concatenate([[0], ends[:-1]])
    hashes = mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    np.minimum.at(least, (hashes & np.uint64(BINS - 1)).astype(np.int64), hashes >> np.uint64(7))


def likeness_of(a: bytes, b: bytes) -> float:
    if not a or not b:
        return float(a == b)
    x, y = np.frombuffer(a, ">u2"), np.frombuffer(b, ">u2")
    used = (x != EMPTY) | (y != EMPTY)
    return float((x == y)[used].mean())


def fingerprint(text: str | Column) -> Column:
    """Fingerprint of a text column."""
    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        hashes = TokenHashes()
        return pd.Series([fingerprint_of(t or "", hashes) for t in texts], dtype=object)
    return of(text)


def fingerprint_edit(text: str, next_text: str) -> Column:
    """Struct of fingerprint, edited_fingerprint and edited_sha256.

    The edited text has, in place of its last half, the first as many characters of ``next_text``.
    """
    @F.pandas_udf("fingerprint binary, edited_fingerprint binary, edited_sha256 binary")
    def of(texts: pd.Series, others: pd.Series) -> pd.DataFrame:
        hashes, rows = TokenHashes(), []
        for t, other in zip(texts, others):
            t, other = t or "", other or ""
            half = len(t) // 2
            tail = other[:half]
            rows.append((*fingerprints_of_edit(t, len(t) - half, tail, hashes),
                         hashlib.sha256((t[:len(t) - half] + tail).encode()).digest()))
        return pd.DataFrame(rows, columns=["fingerprint", "edited_fingerprint", "edited_sha256"])
    return of(text, next_text)


def likeness(a: str | Column, b: str | Column) -> Column:
    """Estimated overlap of the phrase sets behind two fingerprints, 0 to 1; null counts as empty."""
    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness_of(i or b"", j or b"") for i, j in zip(x, y)], dtype="float64")
    return of(a, b)


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows doc_id, text, part, halo: each range of ids, and behind it the row that follows.

    Documents are in order of doc_id, nulls last, equal ids by text; the last one
    is followed by the first. `following` looks at the next row. Rows with a halo
    above 0 are the copies that close a range, to be dropped afterwards. So texts
    are shuffled once and no window sees more than a range; the ids that bound
    the ranges are all that reaches the driver.
    """
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select("doc_id", text)
    cuts = [(i + 1) / parts for i in range(parts - 1)]
    stats = rows.agg(F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls"),
                     F.percentile_approx("doc_id", cuts or [0.5], F.lit(10 * parts)).alias("cuts")).first()
    low = stats.low
    bounds = sorted({c for c in stats.cuts or [] if c > low})
    last = len(bounds)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        found = np.searchsorted(np.array(bounds, np.int64), ids.fillna(0).to_numpy(np.int64), side="right")
        return pd.Series(np.where(ids.isna(), last, found), dtype="int32")

    own = rows.withColumn("part", part_of("doc_id")).withColumn("halo", F.lit(0))
    halos = own.where(F.col("doc_id").isin(bounds) if bounds else F.lit(False)).selectExpr("doc_id", "text", "part - 1 AS part", "1 AS halo")
    wrap = rows.where(F.col("doc_id").eqNullSafe(F.lit(low))).selectExpr("doc_id", "text", f"{last} AS part", "2 AS halo")
    return own.unionByName(halos).unionByName(wrap)


def following(column: str) -> Column:
    """Value of ``column`` in the next document, over a frame from `with_next`."""
    return F.lead(column).over(W.partitionBy("part").orderBy("halo", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text"))
