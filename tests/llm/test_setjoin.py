"""Set join against all pairs of sets."""

import random
import re
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import setjoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    """Row number: size of the set, and of its component the least id."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        ids[r] = min([d for d in (ids.get(r), doc) if d is not None], default=None)
    return [(doc, len(s), ids[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def near(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        at = draw.randrange(len(words))
        kind = draw.random()
        if kind < .4:
            words[at] = f"new{draw.randrange(10**6)}"
        elif kind < .7 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"ins{draw.randrange(10**6)}")
    return words


def corpus(seed):
    draw = random.Random(seed)
    some = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    passage = some(40)
    rows = [(None if i % 17 == 0 else i, t) for i, t in enumerate([None, "", " \n", "one", "ONE", "two words", "a b c d", "A b\tc  D", "Äb c d e f", "äb c d e f"])]
    for g in range(6):
        base = some(draw.choice([7, 12, 60, 150, 300]))
        rows += [(100 * g + 20 + k, " ".join(near(draw, base, draw.choice([0, 1, 1, 2, 4, 8, 16])))) for k in range(draw.randrange(2, 40))]
    for k in range(60):     # a passage in many texts, of some nearly all
        rows.append((2000 + k, " ".join(some(draw.randrange(0, 60)) + passage + some(draw.randrange(0, 9)))))
    rows += [(5000 + k, " ".join(some(draw.randrange(1, 90)))) for k in range(60)]
    rows += [(7000, rows[30][1]), (rows[30][0], rows[30][1]), (7001, rows[30][1].upper())]
    chain = [f"c{i}" for i in range(200)]       # each links with the next only
    rows += [(8000 - k, " ".join(chain[k * 9:k * 9 + 100])) for k in range(10)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_all_pairs(spark, tmp_path, seed):
    rows = corpus(seed)
    made = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n int, tokens string")
    made.repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = setjoin.join(docs)
    assert got.columns == ["doc_id", "n_shingles", "class_id", "component_id"]
    key = lambda r: tuple(map(repr, r))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=key) == sorted(plain(rows), key=key)


def test_frame_that_changes_is_refused(spark):
    ever_new = F.udf(lambda: f"a b c d e f g h i j k l m n {uuid.uuid4()}").asNondeterministic()
    with pytest.raises(ValueError, match="changed"):
        setjoin.join(spark.range(18).select(F.col("id").alias("doc_id"), ever_new().alias("text")))


def test_without_hubs_blocks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "HUBS", 0)
    rows = corpus(4)
    got = setjoin.join(spark.createDataFrame(rows, "doc_id long, text string"))
    key = lambda r: tuple(map(repr, r))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=key) == sorted(plain(rows), key=key)


def test_answers_derived_from_hubs(spark):
    """With the links of one round of hubs, what blocks add is right for every pair that they propose."""
    rows = [(i, t) for i, (_, t) in enumerate(corpus(5))]
    told = spark.createDataFrame(rows, "cid long, text string")
    whole = setjoin._sets(told, whole=True).where("n > 0").dropDuplicates(["tokens"]).cache()
    ranked = setjoin._ranked(whole).cache()
    index = setjoin._index(ranked).cache()
    none = spark.createDataFrame([], "node long, root long")
    stars = setjoin._from_hubs(setjoin._with_hubs(setjoin._rooted(index, none)), ranked).cache()
    pairs = setjoin._between_blocks(setjoin._rooted(index, none)).cache()
    found = {tuple(sorted(r)) for r in setjoin._derived(pairs, ranked, stars).select("a", "b").collect()}
    own = {tuple(sorted(r)) for r in stars.select("hub", "cid").collect()}      # those with the hub itself are known
    sets = {i: plain_set(t) for i, t in rows}
    ids = [r.cid for r in whole.select("cid").collect()]
    want = {(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert found | own == want and len(own) > 20 and len(found - own) > 20


def test_long_text_and_empty_table(spark, monkeypatch):
    draw = random.Random(9)
    words = [f"v{draw.randrange(10**7)}" for _ in range(150_000)]
    long = " ".join(words)
    rows = [(1, long), (2, long + " " * 5 + "end."), (3, "y" * 3_000_000), (4, " ".join(words[:30_000]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(plain_set(long))
    assert got == {1: (n, 1), 2: (n + 1, 1), 3: (1, 3), 4: (len(plain_set(rows[3][1])), 4)}
    assert setjoin.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbÉé \t\n\x0b\x1f\x00"), max_size=30), min_size=1, max_size=6), st.integers(1, 9))
def test_hashes_follow_words(texts, size):
    """Equal shingles have equal hashes, in one text, in a slice of several and in parts."""
    old, setjoin.PART_BYTES = setjoin.PART_BYTES, size
    try:
        alone = [setjoin.shingle_sets([t.encode()])[0] for t in texts]
    finally:
        setjoin.PART_BYTES = old
    together = setjoin.shingle_sets([t.encode() for t in texts] + [b""])
    names = {}
    for t, a, b in zip(texts, alone, together):
        assert np.array_equal(a, b) and len(a) == len(plain_set(t))
    for t, a in zip(texts, alone):
        words = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        if 0 < len(words) <= 5:
            assert names.setdefault(tuple(words), int(a[0])) == int(a[0])
    assert len(set(names.values())) == len(names)
