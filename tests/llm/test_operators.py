"""Each operator on small inputs: brute force, edge cases, repeated rows, empty tables."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_DIR
from tidemark.llm import bagminhash, common, cuckoo, htmldiff, langid, linedup, mixing, phrases, pieces, pii, quality
from tidemark.llm.queries import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, size string, row_id int"
ODD = [(1, None, None, None), (2, "", "en", "a"), (None, "one two three four five six", "en", "a"), (3, "  \n ", "en", None),
       (4, "one two three four five six", "en", "b"), (4, "one two three four five six", "en", "b"), (5, "é" * 3000, "fr", "b"),
       (6, "12 34 !!", "de", "c")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, 1, "x", 7) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "t")
    frame(spark, ODD).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "t")
    frame(spark, []).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_vocabulary(vocabulary_path())


# helpers

def test_prefix_sum_and_components(spark):
    rows = [(i, (i * 37) % 101, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k int, v long")
    got = {r.id: r.s for r in common.prefix_sum(df, [F.col("k"), F.col("id")], "v", "s", "t").collect()}
    total = 0
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        assert got[i] == total
        total += v
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 105), (7, 7), (200, 100)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long"), "c").collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 105: 100, 200: 100}


# 1 mixing

def test_mix_reaches_targets_and_survives_odd_rows(spark, odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r.copies in (0, 1, 2) for r in rows)
    assert {r.source: r.source_size for r in rows} == {None: 0, "a": 6, "b": 13, "c": 3}
    assert mixing.mix(nothing).count() == 0 and mixing.emit(nothing, mixing.mix(nothing)).count() == 0
    emitted = mixing.emit(odd, mixing.mix(odd))
    assert emitted.columns == odd.columns and emitted.count() == sum(r.copies for r in rows)
    many = spark.createDataFrame([(i, "w " * (1 + i % 40), f"s{i % 7}") for i in range(2800)], "doc_id long, text string, source string")
    taken = Counter()
    target = {}
    for r in mixing.mix(many).collect():
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(1 + i % 40 for i in range(2800)))


# 2 pieces

@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab the ing▁\n\t<0x>é中😀.,'"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_pieces_equal_library(text):
    library, encoder = _library()
    ids = np.frombuffer(b"".join(map(encoder.__getitem__, pieces.keys_of(text))) if text else b"", np.int32)
    assert ids.tolist() == library.encode(text)


def _library(kept={}):
    if not kept:
        import sentencepiece
        kept["x"] = (sentencepiece.SentencePieceProcessor(model_file=vocabulary_path()),
                     pieces.Encoder(pieces.read_vocabulary(vocabulary_path())))
    return kept["x"]


def test_pieces_over_frames(spark, odd, nothing, vocabulary):
    library, _ = _library()
    rows = pieces.decode(pieces.encode(odd, vocabulary), vocabulary).collect()
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    at_once = pieces.encode_decode(odd, vocabulary)
    assert at_once.columns == [*odd.columns, "ids", "decoded"]
    assert sorted(map(repr, at_once.collect())) == sorted(map(repr, rows))
    assert pieces.encode_decode(nothing, vocabulary).count() == 0
    loose = [[0, 1, 2], [1, 278, 338], [240, 159, 300], [230, 187, 155], [278], [1, 2], [], list(range(3, 259))]
    df = spark.createDataFrame([(x,) for x in loose], "ids array<int>")
    for r in pieces.decode(df, vocabulary).collect():
        assert r.decoded == library.decode(r.ids)
    assert pieces.decode(pieces.encode(nothing, vocabulary), vocabulary).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(odd, vocabulary, out="source")
    for taken in ({"ids": "source"}, {"out": "source"}, {"out": "ids"}):
        with pytest.raises(ValueError):
            pieces.encode_decode(odd, vocabulary, **taken)


# 3 quality

def test_quality_edges(spark, odd, nothing):
    rng = random.Random(4)
    good = [" ".join(rng.choice("alpha beta gamma delta river stone cloud".split()) for _ in range(80)) for _ in range(120)]
    bad = [" ".join(rng.choice("$$$ ### BUY NOW!!! %%% WIN".split()) for _ in range(80)) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)] + [(5, 0), (6, None), (7, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.col("doc_id") % 3 != 1)
    rows = [r for r in quality.score(docs, model).collect() if r.doc_id % 3 == 1]
    assert sum(r.predicted == int(r.doc_id < 120) for r in rows) >= 0.95 * len(rows)
    scores = [r.score for r in quality.score(odd, model).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    blank = quality.fit(nothing, labels, F.lit(True))
    assert {r.score for r in quality.score(odd, blank).collect()} == {0.5}
    assert quality.score(nothing, model).count() == 0


# 4 line dedup

def brute_lines(docs, min_words):
    """Longest earlier match of every line, compared one by one."""
    seq = []
    for d, (_, text) in enumerate(docs):
        seq += [(d, i, line) for i, line in enumerate(text.split("\n"))] + [(d, None, None)]
    out = {d: set() for d in range(len(docs))}
    for p, (d, i, _) in enumerate(seq):
        if i is None:
            continue
        best = 0
        for q in range(p):
            n = 0
            while seq[p + n][1] is not None and seq[q + n][1] is not None and seq[p + n][2] == seq[q + n][2]:
                n += 1
            best = max(best, n)
        if sum(len(seq[p + k][2].split()) for k in range(best)) >= min_words:
            out[d].update(range(i, i + best))
    return out


@pytest.mark.parametrize("seed, chunk", [(1, 1 << 16), (2, 7), (3, 3)])
def test_line_runs_equal_brute_force(spark, tmp_path, monkeypatch, seed, chunk):
    monkeypatch.setattr(linedup, "CHUNK", chunk)
    rng = random.Random(seed)
    docs = []
    for i in range(24):
        lines = [rng.choice(["a", "b c", "d", "", "e f g", f"own {rng.randint(0, 60)}"]) for _ in range(rng.randint(1, 14))]
        if docs and rng.random() < 0.5:
            old = rng.choice(docs)[1].split("\n")
            at = rng.randrange(len(old))
            lines[rng.randint(0, len(lines)):0] = old[at:at + rng.randint(1, 9)]
        docs.append((i, "\n".join(lines)))
    docs += [(24, docs[3][1]), (25, docs[3][1])]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = {r.doc_id: set(r.removed_lines) for r in linedup.dedup(spark.read.parquet(str(tmp_path / "t")), min_words=3).collect()}
    assert got == brute_lines(docs, 3)


def test_longest_earlier_over_chunks():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randint(1, 30)
        pos = np.array(rng.sample(range(n), n))
        lcp = np.array([0] + [rng.randint(0, 4) for _ in range(n - 1)])
        want = [max([int(lcp[min(i, j) + 1:max(i, j) + 1].min()) for j in range(n) if pos[j] < pos[i]], default=0) for i in range(n)]
        size, got = rng.randint(1, 8), []
        cuts = [(pos[s:s + size], lcp[s:s + size]) for s in range(0, n, size)]
        shown = [linedup.edges_of(*c) for c in cuts]
        lefts, state = [], []
        for left, right, through in shown:
            lefts.append(state)
            state = linedup.stairs(right + [(min(v, through), p) for v, p in state])
        rights, state = [], []
        for left, right, through in reversed(shown):
            rights.append(state)
            state = linedup.stairs(left + [(min(v, through), p) for v, p in state])
        for c, a, b in zip(cuts, lefts, reversed(rights)):
            got += linedup.longest_earlier(*c, a, b).tolist()
        assert got == want


def test_line_dedup_edges(spark, odd, nothing):
    rows = linedup.dedup(odd, min_words=5).collect()
    assert len(rows) == len(ODD) and linedup.dedup(odd).columns[:len(odd.columns)] == odd.columns
    six = [r for r in rows if r.n_chars is None and (r.text == "one two three four five six" or r.emptied)]
    assert sorted(r.emptied for r in six) == [False, True, True]
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    assert linedup.dedup(nothing).count() == 0


# 5 personal data

def test_pii_base_and_bootstrap(spark, odd, nothing, tmp_path):
    text = "mail a.b@c.de or 1.2.3.4, not 1.2.3.400; card 4111 1111 1111 1111, call +1 (212) 555-0100 now"
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in pii.base_spans(text)] == [
        ("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (212) 555-0100")]
    seeds = [(i, f"please reach me at user{i}@mail.example.org thanks") for i in range(8)]
    hidden = [(100, "please reach me at some.body42@localhost thanks"), (101, "the year was 19990101x here")]
    spark.createDataFrame(seeds + hidden, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = {r.doc_id: [(s.kind, s.at, s.stop) for s in r.spans] for r in pii.extract(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert rows[100] == [(0, 19, 40)] and rows[101] == [] and len(rows[0]) == 1
    rows = pii.extract(odd).collect()
    assert len(rows) == len(ODD) and all(r.spans == [] for r in rows)
    assert pii.extract(nothing).count() == 0


def test_pii_finds_identifiers_with_blanks(spark, tmp_path):
    def found(text):
        return [text[s:e] for s, e in pii.candidates(text, sorted((s, e) for s, _, e in pii.base_spans(text)))]
    assert found("call (743) 555-3824, or 020 7946 0958. Pay 4111 1111 1111 now") == ["(743) 555-3824", "020 7946 0958", "4111 1111 1111"]
    assert found("write to jo.do at mail dot example dot org or JO [at] host [dot] org") == ["jo.do at mail dot example dot org", "JO [at] host [dot] org"]
    assert found("(see 555 - 3824) and (abc123x) in 2019, 2020 +1 (212) 555-0100 7") == ["555 - 3824", "abc123x"]
    assert found("1234567890 1234567891 12") == ["1234567890", "1234567891"]
    seeds = [(i, f"please call us on +1 (743) 555-38{i:02} thanks") for i in range(10)]
    hidden = [(100 + i, f"please call us on {t} thanks") for i, t in enumerate(("(743) 555-3924", "020 7946 0958", "743 555 3825"))]
    mail = [(200 + i, f"so send it to user{i}@mail.example.org today") for i in range(10)] + [(300, "so send it to jo do at host dot org today")]
    mixed = [(400 + i, f"one of many +1 (743) 555-39{i:02} of these") for i in range(5)] + [(450 + i, f"one of many 19990{i}x of these") for i in range(10)]
    rows = seeds + hidden + mail + [(301, "so send it to jo.do at host dot org today")] + mixed
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    text = dict(rows)
    got = {r.doc_id: [(pii.KINDS[s.kind], text[r.doc_id][s.at:s.stop]) for s in r.spans] for r in pii.extract(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert [got[100 + i] for i in range(3)] == [[("phone", t)] for t in ("(743) 555-3924", "020 7946 0958", "743 555 3825")]
    assert got[301] == [("email", "jo.do at host dot org")] and all(got[450 + i] == [] for i in range(10))


# 6 language

def test_language_edges(spark, odd, nothing):
    learn = spark.createDataFrame([(i, t, l) for i in range(40) for t, l in (("the river and the stone " * 5 + str(i), "en"), ("der fluss und das haus " * 5 + str(i), "de"))],
                                  "doc_id long, text string, lang string")
    model = langid.fit(learn, F.lit(True))
    rows = langid.predict(odd.drop("lang"), model).collect()
    assert len(rows) == len(ODD)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)
    assert all(r.rejected for r in rows if r.lang_pred == "und") and all(0 <= r.score <= 1 for r in rows)
    assert langid.predict(nothing, model).count() == 0
    empty = langid.fit(nothing, F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}
    letters = langid._letter_table()
    long = "the river and the stone " * 60_000
    assert np.abs(langid.counts(long, letters) - 60_000 / 10 * langid.counts(long[:240], letters)).max() < 60_010


def test_language_rejects_what_it_has_not_learnt(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    held = F.pmod("doc_id", F.lit(4)) == 2
    model, rng = langid.fit(docs, ~held), random.Random(3)

    def noise(n, alphabet):
        return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 9))) for _ in range(n))
    strange = ["kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu jarki ja omatunto ja heidan on toimittava",
               "wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci i swych praw sa oni obdarzeni rozumem i sumieniem i powinni postepowac"]
    strange += [noise(n, a) for n in (50, 200, 3000) for a in ("abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", [chr(c) for c in range(0x4E00, 0x9000)])]
    real = [r.text for r in docs.where(held).collect() if r.text]
    short = [t[at:at + n] for t in real for n in (3, 8, 15, 30, 60, 120) if len(t) > n for at in (rng.randrange(len(t) - n),)]
    short = [t for t in short if any(c.isalpha() for c in t)]
    rows = [(kind, t) for kind, texts in (("strange", strange), ("real", real), ("short", short)) for t in texts]
    passed = Counter(r.kind for r in langid.predict(spark.createDataFrame(rows, "kind string, text string"), model).where("NOT rejected").collect())
    assert passed["strange"] == 0
    assert passed["real"] == len(real) and passed["short"] > 0.99 * len(short)


# 7 phrases

def test_phrases_equal_direct_parse():
    rng, hashes = random.Random(5), phrases.TokenHashes()
    words = ["a", "bb", "ccc", "\n", "", "x" * 60, "日本語" * 20]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        tail = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        cut = len(text) - len(text) // 2
        assert phrases.fingerprints_of_edit(text, cut, tail, hashes) == (
            phrases.fingerprint_of(text, hashes), phrases.fingerprint_of(text[:cut] + tail, hashes))
    assert phrases.likeness_of(b"", b"") == 1 and phrases.likeness_of(b"", phrases.fingerprint_of("a", hashes)) == 0


def test_phrases_over_frames(spark, odd, nothing):
    out = phrases.with_next(odd, 3).withColumn("n", phrases.following("text")).where("halo = 0").collect()
    assert len(out) == len(ODD)
    following = {r.doc_id: r.n for r in out if r.doc_id != 4}
    assert following[1] == "" and following[2] == "  \n " and following[5] == "12 34 !!"
    assert following[6] == "one two three four five six" and following[None] == ""
    assert phrases.with_next(nothing, 3).count() == 0
    assert [r.f for r in odd.where("text = ''").select(phrases.fingerprint("text").alias("f")).collect()] == [b""]


# 8 exact dedup

def test_cuckoo_filter_deletes_and_grows():
    shard = cuckoo.Shard(None, [])
    digests = [f"{i * 0x9E3779B97F4A7C15 % (1 << 64):064x}" for i in range(6000)]
    for i, d in enumerate(digests):
        shard.insert(d, i, 1)
    assert shard.resized > 0 and all(d in shard.filter for d in digests)
    for d in digests[::2]:
        shard.delete(d)
    assert all(d in shard.filter for d in digests[1::2])
    assert sum(d in shard.filter for d in digests[::2]) < 60


def test_exact_dedup_edges(spark, odd, nothing):
    rows = cuckoo.dedup(odd).collect()
    assert len(rows) == len(ODD)
    six = [r for r in rows if r.doc_id in (None, 4)]
    assert {r.group_size for r in six} == {3} and {r.keep_id for r in six} == {4} and [r.kept for r in six].count(True) == 2
    assert {r.keep_id for r in rows if r.doc_id in (1, 2)} == {2}
    assert cuckoo.dedup(nothing).count() == 0
    index = cuckoo.update(None, cuckoo.digests(odd))
    gone = cuckoo.digests(odd.where("doc_id = 4"))
    later = cuckoo.update(index, cuckoo.digests(frame(spark, [(9, "new", None, None), (10, "", None, None)])), deletes=gone)
    live = {r.digest: (r.keep_id, r.copies) for r in later.where("digest IS NOT NULL").collect()}
    assert len(live) == index.where("digest IS NOT NULL").count()
    assert sorted(v for v in live.values() if v[0] in (9, 10)) == [(9, 1), (10, 3)]


# 9 pages

def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        places = htmldiff.shared(a, b)
        assert places == sorted(set(places)) and len(places) == table[-1][-1]
        at = 0
        for p in places:
            at = b.index(a[p], at) + 1


def test_pages(spark, tmp_path):
    frame_top, frame_end = "<div>Site name</div><div>All our topics</div>", "<div>Contact us</div>"
    bodies = ["first story one<br>goes on", "second &amp; story\n two", "third  story three", "fourth story"]
    rows = [(i, f"http://h.example/a/{i}", f"<html><head><title>x</title></head><body>{frame_top}<p>{b}</p>{frame_end}") for i, b in enumerate(bodies)]
    rows += [(10, "http://m.example/1", "<nav>menu</nav><article><h1>T</h1><p>a <b>b</b>c<script>var x='<p>no</p>'</script><div class='ad x'>ad</div>"
              "<p>d<section id=comments><p>rude</p></section></article><footer>end</footer>"),
             (11, "http://m.example/2", "<main>shared</main>"), (12, "http://m.example/3", "<main>shared</main>"),
             (13, None, None), (14, "", ""), (15, "http://h.example/a/0", rows[0][2]), (None, "x", "<p>alone")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = {r.page_id: r.text for r in htmldiff.extract(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert [got[i] for i in range(4)] == ["first story one goes on", "second & story two", "third story three", "fourth story"]
    assert got[10] == "T a bc d" and got[11] == got[12] == "shared" and got[13] == got[14] == "" and got[None] == "alone"
    assert got[15] == got[0]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert htmldiff.extract(empty).count() == 0


# 10 near dedup

def test_signatures_estimate_weighted_overlap():
    rng, errors = random.Random(3), []
    for _ in range(150):
        keys = np.sort(np.array([rng.getrandbits(63) for _ in range(25)], np.uint64))
        w, v = (np.array([rng.randint(1, 30) for _ in keys]) for _ in range(2))
        same = (bagminhash.signature(keys, w) == bagminhash.signature(keys, v)).mean()
        errors.append(same - np.minimum(w, v).sum() / np.maximum(w, v).sum())
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_near_dedup_edges(spark, odd, nothing, tmp_path, monkeypatch):
    rows = bagminhash.groups(odd).collect()
    assert len(rows) == len(ODD) and {r.copies for r in rows if r.doc_id in (4, None)} == {3}
    assert sorted(r.kept for r in rows if r.doc_id in (4, None)) == [False, True, True]
    assert bagminhash.groups(nothing).count() == 0
    # a large group of near copies, whose buckets are cut into blocks
    monkeypatch.setattr(bagminhash, "BLOCK_CHARS", 4_000)
    monkeypatch.setattr(bagminhash, "STAR", 20)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(120)] = f"x{rng.randint(0, 999)}"
        docs.append((i, " ".join(words)))
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    from test_oracles import near_groups
    truth = near_groups(dict(docs))
    got = {r.doc_id: r.group_id for r in bagminhash.groups(spark.read.parquet(str(tmp_path / "t"))).collect()}
    same = lambda g: {frozenset(i for i in g if g[i] == k) for k in g.values()}
    assert same(got) == same(truth)


def test_pipeline_keeps_one_row_of_odd_ones(spark, odd, nothing):
    import corpus_pipeline
    assert corpus_pipeline.near(spark, odd, "").columns == odd.columns
    kept = corpus_pipeline.near(spark, odd, "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4, 5, 6]     # null and empty texts are one class, blanks another
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0


def texts_of(spark, path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(path))
    return {r.page_id: r.text for r in htmldiff.extract(spark.read.parquet(str(path))).collect()}


def test_neighbours_decide_beside_an_article(spark, tmp_path):
    names = "red green blue white".split()
    page = "<div>Site name and topics</div><div>A {0} headline</div><article><p>the {0} story of {0}</p><p>they all say this</p></article><div>Contact us here</div>"
    rows = [(i, f"http://h.example/{i}", page.format(c)) for i, c in enumerate(names)] + [(9, "http://alone.example/", page.format("grey"))]
    got = texts_of(spark, tmp_path / "t", rows)
    for i, c in enumerate(names):
        assert got[i] == f"A {c} headline the {c} story of {c} they all say this"
    assert got[9] == "the grey story of grey they all say this"


def test_frame_rules_keep_real_text(spark, tmp_path):
    def one(html):
        return " ".join(t for t, r in htmldiff.lines_of(html) if r not in (htmldiff.CHROME, htmldiff.GUESSED))
    for attributes in ('style="overflow:hidden"', 'href="/a/hidden-gems"', 'title="the hidden side"', 'data-hidden="false"', "href=/x?class=ad",
                       'aria-hidden="false"', *(f'class="{c}"' for c in ("layout has-sidebar", "no-sidebar", "comments-open single", "elementor-widget",
                                                                        "entry-header", "share-price", "related-work"))):
        assert one(f"<div {attributes}><p>real text</p></div>") == one(f"<article><div {attributes}><p>real text</p></div></article>") == "real text"
    for attributes in ("hidden", 'HIDDEN=""', "aria-hidden='true'", "role=navigation", 'class="x ad"', "id=comments"):
        assert one(f"<div {attributes}>gone<p>gone</p></div>stays") == "stays"
    assert one('<div class="page sidebar">gone<article>real</article>gone</div>') == "real"
    assert one('<main>real<div class="sidebar">gone<article>teaser</article></div></main>') == one("<main>real</main><div class=comments><article>gone</article></div>") == "real"
    page = '<article><div class="share-box">Share this now</div><div class="share-price">It stands at {0} today</div><p>news of {0} and {0}, on {0}</p></article>'
    got = texts_of(spark, tmp_path / "t", [(i, f"http://h.example/{i}", page.format(c)) for i, c in enumerate(("ten", "six", "two"))])
    assert got[1] == "It stands at six today news of six and six, on six"


def test_copies_are_passed_and_stubs_are_not_copies(spark, tmp_path):
    frame_top = "".join(f"<div>Topic {t} of our long plain menu</div>" for t in "abcdefgh")
    names = "red green blue white black brown pink".split()
    rows = [(i, f"http://stubs.example/{i}", f"{frame_top}<p>Item {c}</p><div>Contact us here</div>") for i, c in enumerate(names)]
    story = "the long story of a river that runs past many towns and many mills " * 3
    copies = [(20 + i, f"http://copies.example/a{i:02}", f"<div>Site name</div><p>{story}</p><p>seen {i}</p>") for i in range(12)]
    others = [(40 + i, f"http://copies.example/{k}", f"<div>Site name</div><p>only {c} here {c} and {c}</p>") for i, (k, c) in enumerate(zip("019bcd", names))]
    got = texts_of(spark, tmp_path / "t", rows + copies + others)
    assert [got[i] for i in range(len(names))] == [f"Item {c}" for c in names]
    assert [got[20 + i] for i in range(12)] == [f"{story}seen {i}" for i in range(12)]
    assert [got[40 + i] for i in range(6)] == [f"only {c} here {c} and {c}" for c in names[:6]]
