"""Language ID by nearest centroid.

A text becomes counts of its hashed letter n-grams (one to three letters, spaces
included), damped, weighted by inverse document frequency and scaled to length
one. Each language has several centroids, from spherical k-means over its own
vectors. The language of the nearest centroid by cosine is the prediction; a
text much further from it than nearly all learning texts with as many different
n-grams is rejected. A cosine rises with the n-grams there are, from 0.05 for a
word to 0.9 for a page, so whole learning texts and pieces of them of all lengths
are measured, each against centroids of the parts of the sample it is not in; a
language and half octave of n-grams has its own bound, ``MARGIN`` of the 1%
quantile. The margin is for texts of the language on other subjects than those
learnt from. A few letters can't be told from other languages and mostly pass.

Learning takes a bounded sample: about ``per_language`` rows a language, chosen
by a hash of id and text against a rate from the counts of all rows.

Defined cases: a null text, or one without a letter, is `und`, score 0 and
rejected; null lang teaches nothing; equal cosines go to the first language by
code point; without any learning row every text is `und`; very long texts are
counted in pieces of bounded size; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_slices, free_name

UNKNOWN = "und"
DIMENSIONS = 1 << 13
PIECE = 1 << 19
#: Vectors that are compared with the centroids at a time.
BLOCK = 128
#: A text is rejected below this share of the cosine that 99 of 100 learning texts of its language and size reach.
MARGIN = 0.5
#: Half octaves of different n-grams, parts of the sample, and lengths of the pieces of learning texts.
LEVELS = 2 * 13 + 1
PARTS = 5
LENGTHS = [1 << k for k in range(17)]


@dataclass
class LanguageModel:
    languages: list[str]
    owner: np.ndarray           # language of each centroid
    centroids: np.ndarray       # one column each, times the idf
    idf: np.ndarray
    reject_below: np.ndarray    # a row for each language, a column for each level


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)


def _slots(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64)


def counts(text: str, letters: np.ndarray) -> np.ndarray | None:
    """Counts of hashed n-grams; None without a letter."""
    total, found, carry = np.zeros(DIMENSIONS), False, np.array([32, 32], np.uint32)
    lower = text.lower()
    for start in range(0, len(lower), PIECE):
        codes = np.frombuffer(lower[start:start + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        known = letters[np.minimum(codes, 65535)]
        high = codes > 65535
        if high.any():
            known = known.copy()
            known[high] = [chr(c).isalpha() for c in codes[high]]
        if known.any():
            found = True
        codes = np.where(known, codes, np.uint32(32))
        codes = np.concatenate([carry, codes])
        keep = np.ones(len(codes), bool)                        # runs of other characters are one space
        keep[2:] = (codes[2:] != 32) | (codes[1:-1] != 32)
        codes = codes[keep]
        carry = codes[-2:] if len(codes) >= 2 else carry
        one, two = codes[2:], codes[1:-1] * np.uint32(31) + codes[2:]
        three = codes[:-2] * np.uint32(1009) + two * np.uint32(7) + np.uint32(3)
        total += np.bincount(_slots(one[one != 32]), minlength=DIMENSIONS)
        total += np.bincount(_slots(two + np.uint32(77)), minlength=DIMENSIONS)
        total += np.bincount(_slots(three), minlength=DIMENSIONS)
    return total if found else None


def level(grams: np.ndarray) -> np.ndarray:
    """Half octave of a number of different n-grams."""
    return (2 * np.log2(np.maximum(grams, 1))).astype(np.int64)


def _centres(own: np.ndarray, centroids: int, rounds: int) -> np.ndarray:
    """Spherical k-means over the vectors of one language."""
    picks = np.linspace(0, len(own) - 1, min(centroids, len(own))).round().astype(int)
    centre = own[np.unique(picks)].copy()
    for _ in range(rounds):
        nearest = (own @ centre.T).argmax(1)
        for j in range(len(centre)):
            if (nearest == j).any():
                m = own[nearest == j].mean(0)
                centre[j] = m / np.linalg.norm(m)
    return centre


def _bounds(texts: list[str], own: np.ndarray, idf: np.ndarray, per_language: int, centroids: int, rounds: int) -> np.ndarray:
    """The least cosine to accept for one language, by level of different n-grams."""
    letters, draw, found = _letter_table(), np.random.default_rng(0), [[] for _ in range(LEVELS)]
    for part in range(min(PARTS, len(own))):
        mine, rest = own[part::PARTS], np.delete(own, slice(part, None, PARTS), 0)
        centre = _centres(rest if len(rest) else own, centroids, rounds).T
        for k, best in zip(level((mine > 0).sum(1)), (mine @ centre).max(1)):
            found[k].append(best)
        joined = "\n".join(texts[part::PARTS])
        for n in LENGTHS:
            for _ in range(min(per_language // PARTS, len(joined) // n)):
                at = int(draw.integers(len(joined) - n + 1))
                c = counts(joined[at:at + n], letters)
                if c is not None:
                    v = np.log1p(c).astype(np.float32) * idf
                    found[level((v > 0).sum())].append((v @ centre).max() / np.linalg.norm(v))
    out, last = np.zeros(LEVELS), 0.0
    for k, cosines in enumerate(found):                         # beyond what was measured the level before holds
        last = MARGIN * float(np.quantile(cosines, 0.01)) if cosines else last
        out[k] = last
    return out


def fit(docs: DataFrame, learnable: Column, per_language: int = 400, centroids: int = 3, rounds: int = 8) -> LanguageModel:
    """Learns from ``docs`` (doc_id, text, lang) where ``learnable`` holds."""
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}   # a row per language
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))]) if sizes else None
    if rate is None:
        return LanguageModel([], np.zeros(0, int), np.zeros((DIMENSIONS, 0), np.float32), np.zeros(DIMENSIONS, np.float32), np.zeros((0, LEVELS)))
    draw = F.pmod(F.xxhash64(F.lit("lang"), "doc_id", "text"), F.lit(1_000_000)) / 1_000_000.0
    sample = rows.where(draw < rate[F.col("lang")]).select("lang", "text").toPandas()
    sample = sample.sort_values(["lang", "text"], ignore_index=True)
    letters = _letter_table()
    vectors, langs, texts = [], [], []
    for lang, text in zip(sample.lang, sample.text):
        c = counts(text, letters)
        if c is not None:
            vectors.append(np.log1p(c).astype(np.float32))
            langs.append(lang)
            texts.append(text)
    if not vectors:
        return LanguageModel([], np.zeros(0, int), np.zeros((DIMENSIONS, 0), np.float32), np.zeros(DIMENSIONS, np.float32), np.zeros((0, LEVELS)))
    x, langs = np.stack(vectors), np.array(langs, object)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x = x * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    languages, owner, centres, bounds = sorted(set(langs)), [], [], []
    for k, lang in enumerate(languages):
        own = x[langs == lang]
        centre = _centres(own, centroids, rounds)
        bounds.append(_bounds([t for t, o in zip(texts, langs) if o == lang], own, idf, per_language, centroids, rounds))
        centres.append(centre)
        owner += [k] * len(centre)
    centre = np.concatenate(centres)
    return LanguageModel(languages, np.array(owner), np.ascontiguousarray((centre * idf).T.astype(np.float32)), idf,
                         np.stack(bounds))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (cosine to the nearest centroid) and rejected."""
    def predicted(texts: pa.Array) -> pa.Array:
        letters = _letter_table()
        n = len(texts)
        lang, score, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
        block, places = [], []

        def flush():
            if block and model.languages:
                x = np.stack(block)
                norm = np.sqrt(((x * model.idf) ** 2).sum(1))
                cosine = x @ model.centroids / norm[:, None]
                best = cosine.argmax(1)
                lang[places] = np.array(model.languages, object)[model.owner[best]]
                score[places] = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                rejected[places] = score[places] < model.reject_below[model.owner[best], level((x > 0).sum(1))]
            block.clear()
            places.clear()
        for start, stop in byte_slices(texts):
            for i, value in enumerate(texts.slice(start, stop - start).to_pylist(), start):
                c = counts(value, letters) if value else None
                if c is not None:
                    block.append(np.log1p(c).astype(np.float32))
                    places.append(i)
                    if len(block) == BLOCK:
                        flush()
        flush()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                                          names=["lang_pred", "score", "rejected"])
    found, udf = free_name(docs, "_p"), F.arrow_udf(predicted, "lang_pred string, score double, rejected boolean")
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]      # columns of these names are replaced
    return docs.withColumn(found, udf(text)).select(*own, f"{found}.lang_pred", f"{found}.score", f"{found}.rejected")
