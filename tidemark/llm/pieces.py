"""SentencePiece BPE: exact encoding by backtracking, and decoding.

Encoding doesn't run merges over a text. All pieces that occur in it are found
by Aho-Corasick. From the left, the longest piece is tried that is compatible
with the piece before it; two adjacent pieces are compatible if merging their
joined text again gives just these two. Where no piece fits, the position is
marked in a bitfield as failed, the last piece is taken back and its next
shorter alternative is tried. A sequence whose neighbours are all compatible is
the one that merging would have produced, and a prefix has only one such
sequence, so a failed position never has to be looked at again.

Pieces of the model never continue after a space, so a text falls into words
that are encoded one by one, and a task remembers the words it has met.

Defined cases: a null or empty text has no ids; characters outside the
vocabulary become byte pieces; decoding drops the space that encoding puts in
front, control ids give nothing, the unknown id its surface, and bytes that are
no UTF-8 give U+FFFD each; extra columns pass through, and an output name that
is taken is an error.
"""

from __future__ import annotations

import re
import struct
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SPACE = "▁"
#: Words, parts of words and pairs that a task remembers, each, before it starts afresh.
REMEMBERED = 250_000
#: Rows handled at a time.
ROWS = 256
#: Stands for a character outside the vocabulary.
OTHER = -1

#: Fixed values of the public model format: piece types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Vocabulary:
    """Pieces by id, their types, and the rank at which a piece is merged (least first)."""

    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    unknown_surface: str
    unreached: set[int]         # pieces that merging their own characters doesn't give


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7
    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at:at + size]
            at += size


def read_vocabulary(path: str) -> Vocabulary:
    """Reads a model file. Only what `encode` is exact for is accepted."""
    with open(path, "rb") as file:
        top = list(_fields(file.read()))
    trainer = dict(next((_fields(v) for n, v in top if n == 2), ()))
    normal = dict(next((_fields(v) for n, v in top if n == 3), ()))
    pieces, kinds, scores = [], [], []
    for n, value in top:
        if n == 1:
            piece = dict(_fields(value))
            pieces.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
    plain = not normal.get(2) and normal.get(3, 1) == 1 and normal.get(4, 1) == 0 and normal.get(5, 1) == 1
    if trainer.get(3) != 2 or not plain or not trainer.get(35) or {UNUSED, USER_DEFINED} & set(kinds):
        raise ValueError("a BPE model with byte fallback, a leading space and no other normalisation is expected")
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, k in zip(pieces, kinds) if k == NORMAL):
        raise ValueError("a piece goes on after a space, so words can't be encoded apart")
    ranks = {p: r for p, r, k in zip(pieces, scores, kinds) if k == NORMAL}
    unreached = {i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL and merge(p, ranks) != [p]}
    return Vocabulary(pieces, kinds, scores, trainer.get(44, " ⁇ ".encode()).decode(), unreached)


def merge(text: str, ranks: dict[str, float]) -> list[str]:
    """Plain merging, for the few characters of one piece or two. ``ranks``: scores of the pieces."""
    parts = list(text)
    while len(parts) > 1:
        best, where = None, -1
        for i in range(len(parts) - 1):
            found = ranks.get(parts[i] + parts[i + 1])
            if found is not None and (best is None or found > best):
                best, where = found, i
        if where < 0:
            break
        parts[where:where + 2] = [parts[where] + parts[where + 1]]
    return parts


class Encoder(dict):
    """Ids of words as bytes of int32, remembered; a key is a word without the space in front. Built once in a task."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        self.pieces = vocabulary.pieces
        normal = [i for i, k in enumerate(vocabulary.kinds) if k == NORMAL]
        self.ranks = {self.pieces[i]: vocabulary.scores[i] for i in normal}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(vocabulary.kinds) if k == BYTE}
        self.together = {p[i:i + 2] for p in self.ranks for i in range(len(p) - 1)}
        self.matches = ahocorasick.Automaton()
        for i in normal:
            if i not in vocabulary.unreached:
                self.matches.add_word(self.pieces[i], (len(self.pieces[i]), i))
        self.matches.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.parts: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self.encode(SPACE + key.replace(" ", SPACE))
        if len(key) < 64:
            self[key] = found
        return found

    def compatible(self, pair: int) -> bool:
        """Whether merging the joined text of two pieces gives these two again."""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        left, right = self.pieces[pair >> 24], self.pieces[pair & 0xFFFFFF]
        fits = self.pairs[pair] = merge(left + right, self.ranks) == [left, right]
        return fits

    def encode(self, word: str) -> bytes:
        """Cuts the word where no piece holds both neighbours, so no merge can cross, and encodes the parts."""
        together, parts, start, out = self.together, self.parts, 0, []
        for end in range(1, len(word) + 1):
            if end == len(word) or word[end - 1:end + 1] not in together:
                part = word[start:end]
                found = parts.get(part)
                if found is None:
                    found = array("i", self.split(part)).tobytes()
                    if len(part) < 64:
                        if len(parts) >= REMEMBERED:
                            parts.clear()
                        parts[part] = found
                out.append(found)
                start = end
        return out[0] if len(out) == 1 else b"".join(out)

    def split(self, word: str) -> list[int]:
        """The ids of a part of a word, by backtracking."""
        n = len(word)
        starts: list[list[tuple[int, int]] | None] = [None] * n        # (size, id) of the pieces, by start, ascending
        for end, match in self.matches.iter(word):
            at = end - match[0] + 1
            if starts[at] is None:
                starts[at] = [match]
            else:
                starts[at].append(match)
        for at in range(n):
            if starts[at] is None or starts[at][0][0] > 1:
                starts[at] = [(1, OTHER), *(starts[at] or ())]          # a character outside the vocabulary
        ids: list[int] = []
        sizes: list[int] = []
        tries: list[int] = []                                   # per piece: how many alternatives are left below it
        pairs, failed, at, before, options = self.pairs, 0, 0, OTHER, starts[0]
        left = len(options)
        while at < n:
            while left:
                left -= 1
                size, piece = options[left]
                if failed and failed >> (at + size) & 1:
                    continue
                if before >= 0 and piece >= 0:
                    pair = before << 24 | piece
                    fits = pairs.get(pair)
                    if not (self.compatible(pair) if fits is None else fits):
                        continue
                ids.append(piece)
                sizes.append(size)
                tries.append(left)
                at += size
                if at < n:
                    options, before = starts[at], piece
                    left = len(options)
                break
            else:
                failed |= 1 << at
                at -= sizes.pop()
                ids.pop()
                left = tries.pop()
                options, before = starts[at], ids[-1] if ids else OTHER
        if OTHER in ids:
            places = np.cumsum([0, *sizes]).tolist()
            ids = [i for k, piece in enumerate(ids) for i in
                   ([piece] if piece >= 0 else map(self.bytes.__getitem__, word[places[k]].encode()))]
        return ids


def keys_of(text: str) -> list[str]:
    """The words of a text, each without its first space."""
    if "  " not in text and SPACE not in text and text[0] != " ":
        return text.split(" ")
    return [word[1:] for word in WORDS.findall(" " + text)]


#: A word is the spaces in front and what follows; spaces alone only at the end.
WORDS = re.compile(f"[ {SPACE}]+[^ {SPACE}]*")


def _encoding(vocabulary: Vocabulary, at: int, out: str):
    """Task that adds the ids of the texts in column ``at``."""
    def task(batches):
        encoder = Encoder(vocabulary)
        for batch in sliced(batches):
            data = [b"".join(map(encoder.__getitem__, keys_of(t))) if t else b"" for t in batch.column(at).to_pylist()]
            counts = np.concatenate([[0], np.cumsum([len(d) // 4 for d in data])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(counts, np.frombuffer(b"".join(data), np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, out])

    return task


def _decoding(vocabulary: Vocabulary, at: int, out: str):
    """Task that adds the texts of the ids in column ``at``."""
    def surface(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return (vocabulary.unknown_surface if kind == UNKNOWN else piece.replace(SPACE, " ")).encode()

    def task(batches):
        surfaces = pa.array([surface(p, k) for p, k in zip(vocabulary.pieces, vocabulary.kinds)], pa.large_binary())
        control = np.array([k == CONTROL for k in vocabulary.kinds])
        spaced = np.array([p.startswith(SPACE) and k == NORMAL for p, k in zip(vocabulary.pieces, vocabulary.kinds)])
        for batch in sliced(batches):
            lists = batch.column(at)
            flat = lists.flatten()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)])
            taken = surfaces.take(flat)                         # one buffer of all bytes, and where each piece ends
            places = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)
            everything = memoryview(taken.buffers()[2] or b"")
            values = flat.to_numpy()
            texts = []
            for i in range(len(batch)):
                own = values[starts[i]:starts[i + 1]]
                data = bytes(everything[places[starts[i]]:places[starts[i + 1]]])
                if len(own):
                    first = own[np.argmin(control[own])]        # the space in front belongs to the first real piece
                    data = data[1:] if spaced[first] else data
                try:
                    texts.append(data.decode())
                except UnicodeDecodeError:
                    texts.append(_repair(data))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, out])

    return task


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``, the ids of the whole ``text`` as array<int>."""
    _free(docs, out)
    at = docs.schema.fieldNames().index(text)
    return docs.mapInArrow(_encoding(vocabulary, at, out), _with(docs, out, "array<int>"))


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the text of the ids; a null array gives the empty text."""
    _free(docs, out)
    at = docs.schema.fieldNames().index(ids)
    return docs.mapInArrow(_decoding(vocabulary, at, out), _with(docs, out, "string"))


def encode_decode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids",
                  out: str = "decoded") -> DataFrame:
    """Adds ``ids`` and the text ``out`` that they decode to, as `encode` and then `decode` do, in one Python worker a
    task instead of two and without sending the ids out and in again."""
    _free(docs, ids)
    with_ids = docs.schema.fieldNames()
    encoding, decoding = _encoding(vocabulary, with_ids.index(text), ids), _decoding(vocabulary, len(with_ids), out)
    both = _with(docs, ids, "array<int>").add(out, "string")
    if len({f.lower() for f in both.fieldNames()}) < len(both):
        raise ValueError(f"the column {out} is taken")
    return docs.mapInArrow(lambda batches: decoding(encoding(batches)), both)


def sliced(batches):
    """Batches of ROWS rows at most, so that a task's memory doesn't depend on the session's batch size."""
    for batch in batches:
        for start in range(0, len(batch), ROWS):
            yield batch.slice(start, ROWS)


def _repair(data: bytes) -> str:
    """UTF-8 with U+FFFD for every byte that starts no character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at:at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _free(docs: DataFrame, out: str) -> None:
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the column {out} is taken")


def _with(docs: DataFrame, out: str, kind: str):
    from pyspark.sql import functions as F
    return docs.withColumn(out, F.lit(None).cast(kind)).schema
