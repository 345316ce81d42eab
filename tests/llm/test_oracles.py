"""Queries that SQL can express, and results of the others against brute force on the small tables."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_DIR


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet' ORDER BY doc_id").fetchall()
    return dict(rows)


def test_names():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_sentencepiece_equals_library(spark, texts):
    import public_tokenizers
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in entry.queries()["op2_sentencepiece"](spark, SF_DIR).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = library.encode(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def shingles(text):
    words = text.split()
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def near_groups(texts):
    """Components of all pairs of weighted Jaccard 0.8 or more, and of equal texts."""
    bags = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    keys = sorted(texts)
    for a in keys:
        for b in keys:
            if a < b:
                both = sum((bags[a] & bags[b]).values())
                if texts[a] == texts[b] or both and both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in texts}


def test_near_dedup_finds_every_group(spark, texts):
    rows = entry.queries()["op10_near_dedup"](spark, SF_DIR).collect()
    truth, found = defaultdict(set), defaultdict(set)
    for i, r in near_groups(texts).items():
        truth[r].add(i)
    for r in rows:
        found[r.group_id].add(r.doc_id)
    assert sorted(map(sorted, truth.values())) == sorted(map(sorted, found.values()))
    assert {r.doc_id for r in rows if r.kept} == {min(g) for g in truth.values()}


def test_phrase_query(spark, texts):
    rows = {r.doc_id: r for r in entry.queries()["op7_phrases"](spark, SF_DIR).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    for place, i in enumerate(ids):
        text, following = texts[i], texts[ids[(place + 1) % len(ids)]]
        half = len(text) // 2
        assert rows[i].edited_sha256 == hashlib.sha256((text[:len(text) - half] + following[:half]).encode()).hexdigest()
        assert rows[i].n_chars == len(text)
    distinct = [r for r in rows.values() if r.n_chars > 200]
    assert sum(r.near_edited > r.near_next for r in distinct) > 0.95 * len(distinct)


@pytest.mark.parametrize("name, truth, least", [("op3_quality", "quality", 0.85), ("op6_language", "lang", 0.97)])
def test_held_out_accuracy(spark, name, truth, least):
    table = "labels" if truth == "quality" else "documents"
    wanted = dict(duckdb.sql(f"SELECT doc_id, {truth} FROM '{SF_DIR}/{table}.parquet'").fetchall())
    rows = [r for r in entry.queries()[name](spark, SF_DIR).collect() if r.held_out and r.doc_id in wanted]
    right = sum(wanted[r.doc_id] == (r.predicted if truth == "quality" else r.lang_pred) for r in rows)
    assert len(rows) > 20 and right >= least * len(rows)


def test_pipeline_against_brute_force(spark, texts):
    """Every stage on what the one before kept."""
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    known = corpus_pipeline.language(spark, docs, SF_DIR)
    assert known.columns == columns and known.count() > 0.95 * len(texts)
    cut = corpus_pipeline.lines(spark, known, SF_DIR)
    assert cut.columns == columns
    unique = corpus_pipeline.near(spark, cut, SF_DIR)
    left = {r.doc_id: r.text for r in cut.collect()}
    roots = near_groups(left)
    assert sorted(r.doc_id for r in unique.collect()) == sorted({r for r in roots.values()})
    mixed = corpus_pipeline.mixture(spark, unique, SF_DIR)
    assert mixed.columns == columns
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    done = corpus_pipeline.tokens(spark, mixed, SF_DIR)
    assert done.count() == mixed.count() and done.where("NOT round_trip").isEmpty()
