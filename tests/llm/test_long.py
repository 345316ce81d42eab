"""Very long texts: linear time, no cut contexts, one dictionary a text."""

import random
import re
import time
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_DIR
from tidemark.llm import linedup, phrases, pii
from tidemark.session import stage_path, write_stage


def test_matches_equal_the_expressions():
    rng = random.Random(1)
    parts = ["a", "1", ".", "@", "+", "-", " ", "(", "b", "_", "%", ",", "1.2.3.4", "a@b.c", "+12 ", "é", "١"]
    for _ in range(30_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        for kind in pii.KINDS:
            assert list(pii.matches(kind, text)) == [m.span() for m in re.finditer(pii.EXPRESSIONS[kind], text)], (kind, text)


@pytest.mark.parametrize("text", ["1" * 1_000_000 + " 1.2 a@b.c", "a" * 1_000_000 + " a@b.c 1.2", "x1" * 500_000 + "+12345678901;" * 10,
                                  "1 " * 500_000 + "1.2.3.4 and +1234567890", "a@" * 500_000, "+1" * 500_000, "(" * 1_000_000 + "1 a@b.c"])
def test_a_megabyte_of_one_kind(text):
    start = time.time()
    pii.mentions(text, pii.base_spans(text))
    assert time.time() - start < 5


def test_contexts_are_whole():
    far = "reach me at" + " " * 90 + "ab12345" + " " * 90 + "soon"
    assert pii.Context(far).patterns(101, 108) == ["me at _", "me at _ soon"]
    long, other = "é9" * 60, "é9" * 59 + "é8x"
    names = [pii.Context(f"{w} ab12345").patterns(len(w) + 1, len(w) + 8)[0] for w in (long, "é0" * 60, other)]
    assert names[0] == names[1] != names[2]
    # the same part of a long word has one name, wherever it stands in it
    word = "q" * 50 + "r" * 60
    inside = pii.Context(f"go {word}|ab12345")
    assert inside.name(1, 3 + 10, 3 + 110) == pii.Context(word[10:110]).name(0, 0, 100)
    assert pii.surface("z" * 300 + "a") != pii.surface("z" * 300 + "b") and pii.surface("z" * 200) == "z" * 200


def test_equal_kinds_tie_to_the_first(spark, tmp_path):
    rows = [(i, f"so write to user{i}@mail.example.org thanks") for i in range(40)]
    rows += [(100 + i, f"so write to 10.0.0.{i} thanks") for i in range(40)] + [(200, "so write to ab12345 thanks")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    read = lambda d: sorted((r.doc_id, str(r.spans)) for r in pii.extract(d).select("doc_id", "spans").collect())
    assert read(docs) == read(docs.repartition(5))


def test_personal_data_query_equals_plain_expressions(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in entry.queries()["op5_pii"](spark, SF_DIR).collect():
        want = [[m.span() for m in re.finditer(pii.EXPRESSIONS[k], texts[r.doc_id]) if pii.holds(k, m.group())] for k in pii.KINDS]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(w) for w in want]
        assert {f"{k}:{s}:{e}" for k, w in zip(pii.KINDS, want) for s, e in w} <= set(r.spans.split(","))


def plain_phrases(text: str) -> set[tuple]:
    """The phrases of a text, by a set of tuples."""
    seen, open_phrase = set(), ()
    for token in phrases.tokens_of(text):
        open_phrase += (token,)
        if open_phrase not in seen:
            seen.add(open_phrase)
            open_phrase = ()
    return seen | ({open_phrase} if open_phrase else set())


def plain_bins(text: str) -> dict[int, int]:
    """Least hash of each bin of the phrase set, in Python integers."""
    mask, bins = (1 << 64) - 1, {}
    for phrase in plain_phrases(text):
        total = sum(xxhash.xxh64_intdigest(t) * pow(phrases.FACTOR, i, 1 << 64) for i, t in enumerate(phrase)) + len(phrase) & mask
        total = mix(total)
        bins[total % phrases.BINS] = min(bins.get(total % phrases.BINS, mask), total >> 7)
    return bins


def mix(x: int) -> int:
    mask = (1 << 64) - 1
    x = x + 0x9E3779B97F4A7C15 & mask
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
    x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
    return x ^ x >> 31


def plain_fingerprint(text: str) -> bytes:
    bins = plain_bins(text)
    if not text:
        return b""
    return b"".join((mix(bins[b]) % phrases.EMPTY if b in bins else phrases.EMPTY).to_bytes(2, "big") for b in range(phrases.BINS))


def test_long_text_has_one_dictionary():
    rng = random.Random(4)
    text = " ".join(str(rng.randrange(300)) for _ in range(300_000))
    assert phrases.fingerprint_of(text, phrases.TokenHashes()) == plain_fingerprint(text)


def test_phrase_query_equals_plain_parse(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in entry.queries()["op7_phrases"](spark, SF_DIR).collect()}
    ids = sorted(texts)
    for place, i in enumerate(ids):
        text, following = texts[i], texts[ids[(place + 1) % len(ids)]]
        half = len(text) // 2
        own, edited, other = map(plain_fingerprint, (text, text[:len(text) - half] + following[:half], following))
        assert (rows[i].fingerprint, rows[i].edited_fingerprint) == (own.hex(), edited.hex())
        assert rows[i].near_edited == phrases.likeness_of(own, edited) and rows[i].near_next == phrases.likeness_of(own, other)


@pytest.mark.parametrize("n, fan", [(1, 2), (2, 2), (9, 2), (40, 3), (13, 64)])
def test_what_lies_beyond_chunks_equals_one_pass(spark, monkeypatch, n, fan):
    monkeypatch.setattr(linedup, "FAN", fan)
    rng = random.Random(n)
    step = lambda: linedup.stairs([(rng.randint(0, 9), rng.randrange(900)) for _ in range(rng.randint(0, 4))])
    chunks = [(c, rng.randint(0, 6), step(), step()) for c in range(n)]
    shown = spark.createDataFrame([(c, t, [list(s) for s in a], [list(s) for s in b]) for c, t, a, b in chunks], linedup.STAIRS)
    got = {(r.chunk, r.side): [tuple(s) for s in r.beyond] for r in linedup.beyond_chunks(shown).collect()}
    want = {}
    for side, order, at in (("right", chunks, 3), ("left", chunks[::-1], 2)):
        state = []
        for chunk in order:
            want[chunk[0], side] = state
            state = linedup.stairs(chunk[at] + [(min(v, chunk[1]), p) for v, p in state])
    assert got == want


def test_line_ranks_leave_no_tables_of_their_rounds(spark):
    texts = ["\n".join(f"w{i} w{i + 1}" for i in range(k, k + 20)) for k in (0, 0, 7, 100)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = linedup.with_row_id(write_stage(docs, "line-test"), "row_id")
    places = linedup.positions(rows)
    staged = lambda: {p.name for p in Path(stage_path(spark, "x").removeprefix("file:")).parent.iterdir()}
    before = staged()
    ranked = linedup.suffix_ranks(places)
    written = staged() - before
    assert written and not any(name.startswith(("line-going", "line-pairs")) for name in written)
    got = ranked.select("pos", "rank").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(53))              # 20 + 20 + 13, each once
    whole = [(text, i) for text in texts for i in range(20)]
    suffixes = [t.split("\n")[i:] for t, i in whole[:40]] + [texts[2].split("\n")[i:13] for i in range(13)]
    assert all((suffixes[a.pos] == suffixes[b.pos]) == (a["rank"] == b["rank"]) for a in got for b in got)
