"""Fill-in-the-middle: words of eight bytes against regular expressions over code points."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from conftest import SF_DIR
from tidemark.llm import infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXT = st.text(st.sampled_from(" \t\n\v\f\rab\x08\x0e\x00\x7f!é\xa0\x85 漢😀"), max_size=40)


def plain(text, doc_id, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    key = f"{seed}:{'' if doc_id is None else doc_id}"
    h = [int(hashlib.sha256(key.encode()).hexdigest()[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=1, max_size=8), st.integers(0, 3))
def test_cuts(rows, skipped):
    texts = pa.array(["ü x"] * skipped + [t for t, _, _ in rows]).slice(skipped)
    got = infill.cuts(texts, np.array([a for _, a, _ in rows]), np.array([b for _, _, b in rows])).to_pylist()
    for (text, h1, h2), cut in zip(rows, got):
        units = UNIT.findall(text)
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        assert cut == {"n": len(units), "prefix_chars": len("".join(units[:a])), "middle_chars": len("".join(units[a:b]))}


def test_defined_cases(spark):
    long = "wörd  " * 900_000 + "end"
    rows = [(i, t) for i, t in enumerate(["", None, "   ", "one", "a b c d e f", " x y z", "tag <S> in text here", long] * 6)]
    rows += [(None, "no id at all"), (3, "same id"), (3, "same id")]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, form string, n int")
    made = infill.transform(docs)
    got = made.withColumn("restored", infill.restore("output", "form")).toPandas()
    assert list(got.columns) == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    key = lambda r: tuple(map(repr, r))
    whole = lambda v: None if v is None or v != v else int(v)
    seen = [(whole(r.doc_id), r.n, r.form, whole(r.prefix_chars), whole(r.middle_chars), r.output, r.restored) for r in got.itertuples()]
    assert sorted(seen, key=key) == sorted([(i, *plain(t, i), t or "") for i, t in rows], key=key)
    assert {f for _, _, f, *_ in seen} == {"plain", "psm", "spm"}
    assert infill.transform(docs.limit(0)).count() == 0


def test_query_restores_every_text(spark):
    got = entry.queries()["op12_infill"](spark, SF_DIR)
    text = spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("doc_id", "sha2(coalesce(text, ''), 256) AS own")
    assert got.join(text, "doc_id").where("own = restored_sha256").count() == text.count()
