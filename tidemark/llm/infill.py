"""Fill-in-the-middle examples, cut at units found by arithmetic on words of eight bytes.

A unit is a run of white space with the run of other characters behind it, or
white space at the end of a text. The UTF-8 bytes of many texts are viewed as
64-bit words. White space is recognised in all eight bytes of a word at once by
additions that can't carry into the next byte, and a unit ends at a byte that is
no white space in front of one that is, and at the last byte of a text. The ends
are counted with one population count a word; the end of the k-th unit is found
by searching the running counts for its word and then, within the word, by one
multiplication that makes running counts of its bytes. Code points are counted
in the same way, by the bytes that continue none.

Cuts and form of a document are hashes of its id, so a rerun or another
partitioning gives the same examples. Only the places of the cuts come from
Python; text is cut and put together by Spark.

Defined cases: a null text counts as empty; an empty text has no units and stays
plain; a text of white space is one unit; a null id hashes as empty; rows with
the same id are cut by the same hashes; a text that holds one of the marks stays
plain; an empty table gives none. Texts are taken a few million bytes at a time,
a longer text alone. Other columns than id and text are not looked at and not
returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks in front of the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the texts that are rearranged, and of these per cent with the suffix first.
REARRANGED, SUFFIX_FIRST = 50, 80
#: Bytes of text whose words are held at a time.
SLICE_BYTES = 1 << 22


def _each(byte: int) -> np.uint64:
    """A word of eight equal bytes."""
    return np.uint64(byte * 0x0101010101010101)


ONES, HIGH, LOW = _each(0x01), _each(0x80), _each(0x7F)


def _spaces(words: np.ndarray) -> np.ndarray:
    """High bit of each byte that is 0x20 or 0x09 to 0x0D."""
    low = words & LOW
    other = (low ^ _each(0x20)) + LOW                                   # high bit: not 0x20
    control = (low + _each(0x80 - 0x09)) & ~(low + _each(0x80 - 0x0E))  # high bit: 0x09 <= low < 0x0E
    return (~other | control) & ~words & HIGH


def unit_ends(words: np.ndarray, last: np.ndarray) -> np.ndarray:
    """High bit of each byte that ends a unit; ``last`` are the places of the texts' last bytes."""
    space = _spaces(words)
    following = (space >> np.uint64(8)) | (np.append(space[1:], np.uint64(0)) << np.uint64(56))
    marks = ~space & following & HIGH
    np.bitwise_or.at(marks, last >> 3, np.uint64(0x80) << ((last & 7) * 8).astype(np.uint64))
    return marks


def point_starts(words: np.ndarray) -> np.ndarray:
    """High bit of each byte that starts a code point, which is any but 10xxxxxx."""
    return (~words | words << np.uint64(1)) & HIGH


class Marks:
    """Marked bytes, eight to a word, that can be counted up to a place and found by number."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.upto = np.cumsum(np.bitwise_count(words), dtype=np.int64)

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Marked bytes in front of ``place``."""
        word, bits = place >> 3, ((place & 7) * 8).astype(np.uint64)
        inside = self.words[word] & ((np.uint64(1) << bits) - np.uint64(1))
        return self._before(word) + np.bitwise_count(inside)

    def select(self, number: np.ndarray) -> np.ndarray:
        """The place behind the marked byte of this ``number``, from 1."""
        word = np.searchsorted(self.upto, number)
        left = (number - self._before(word)).astype(np.uint64)
        running = (self.words[word] >> np.uint64(7)) * ONES             # byte i: marks in bytes 0 to i
        reached = ((running | HIGH) - left * ONES) & HIGH               # high bit: running count >= left
        return word * 8 + 9 - np.bitwise_count(reached)

    def _before(self, word: np.ndarray) -> np.ndarray:
        return np.where(word > 0, self.upto[np.maximum(word, 1) - 1], 0)


def cuts(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> pa.StructArray:
    """Units of each text, and code points of its prefix and middle, from two hashes a text."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    places = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    base, start, end = places[0], places[:-1] - places[0], places[1:] - places[0]
    held = np.zeros((int(end[-1]) >> 3) + 2, "<u8")
    if end[-1]:
        held.view(np.uint8)[:end[-1]] = np.frombuffer(texts.buffers()[2], np.uint8, end[-1], base)
    ends, points = Marks(unit_ends(held, end[end > start] - 1)), Marks(point_starts(held))
    before = ends.rank(start)
    n = ends.rank(end) - before
    a, b = first % (n + 1), second % (n + 1)
    cut = [np.where(k > 0, ends.select(before + np.maximum(k, np.minimum(n, 1))), start) for k in (np.minimum(a, b), np.maximum(a, b))]
    seen = [points.rank(p) for p in (start, *cut)]
    return pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in (n, seen[1] - seen[0], seen[2] - seen[1])],
                                      names=["n", "prefix_chars", "middle_chars"])


def _sliced_cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    if not len(texts):
        return pa.array([], pa.struct([(c, pa.int64()) for c in ("n", "prefix_chars", "middle_chars")]))
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, second = (v.to_numpy(zero_copy_only=False) for v in (first, second))
    out, at = [], 0
    while at < len(texts):
        behind = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, behind + SLICE_BYTES, side="right")))
        out.append(cuts(texts.slice(at, stop - at), first[at:stop], second[at:stop]))
        at = stop
    return pa.concat_arrays(out)


def transform(docs: DataFrame, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars (null if plain), output.

    Forms: ``plain`` is the text as it is, ``psm`` prefix, suffix and middle, ``spm`` suffix, prefix and middle,
    each behind its mark.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    places = F.arrow_udf(_sliced_cuts, "n long, prefix_chars long, middle_chars long")
    cut = (docs.select("doc_id", text.alias("text"), *(h.alias(f"h{i + 1}") for i, h in enumerate(hashes)))
           .withColumn("cut", places("text", "h1", "h2")))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = (F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= REARRANGED), "plain")
            .when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm"))
    formed = cut.select("doc_id", "text", "cut.n", form.alias("form"),
                        *(F.when(form != "plain", F.col(f"cut.{c}")).alias(c) for c in ("prefix_chars", "middle_chars")))
    prefix, middle = F.col("prefix_chars"), F.col("middle_chars")
    parts = [F.substr("text", F.lit(1), prefix.cast("int")), F.substr("text", (prefix + 1).cast("int"), middle.cast("int")),
             F.substr("text", (prefix + middle + 1).cast("int"))]
    output = (F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), parts[0], F.lit(SUFFIX), parts[2], F.lit(MIDDLE), parts[1]))
              .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), parts[2], F.lit(PREFIX), parts[0], F.lit(MIDDLE), parts[1]))
              .otherwise(F.col("text")))
    return formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def restore(output: str | Column, form: str | Column) -> Column:
    """The text that ``transform`` rearranged; no part of it holds a mark, so the marks split the output."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")       # empty, then the three parts as they stand
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))
