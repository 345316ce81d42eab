"""Conversation repair against Dijkstra's search over whole lists of edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from conftest import SF_DIR
from tidemark.llm import repair

SOLID = re.compile(r"[^\x20\x09-\x0D]")


def best(initials, faults):
    """(cost, edits): least cost, then least string, by a queue over (cost, edits)."""
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, edits, i, q = heapq.heappop(queue)
        if i == len(initials) and q in ("", "a"):
            return cost, edits
        if (i, q, edits) in done or (i, q) in {(a, b) for a, b, *_ in done}:
            continue                # any later arrival is dearer, or as cheap and greater
        done.add((i, q, edits))
        new = "a" if q == "u" else "u"
        heapq.heappush(queue, (cost + 2, edits + "I", i, new))
        if i < len(initials):
            heapq.heappush(queue, (cost + 3, edits + "D", i + 1, q))
            if faults[i] in "t-":
                more = int(faults[i] == "t")
                heapq.heappush(queue, (cost + 2 + more, edits + "R", i + 1, new))
                if (q + initials[i]) in ("s", "u", "su", "ua", "au"):
                    heapq.heappush(queue, (cost + more, edits + "K", i + 1, initials[i]))
    raise AssertionError


def enumerate_best(initials, faults, most):
    """The same by trying every list of edits up to a cost."""
    found = []

    def go(i, q, cost, edits):
        if cost > most:
            return
        if i == len(initials) and q in ("", "a"):
            found.append((cost, edits))
        new = "a" if q == "u" else "u"
        go(i, new, cost + 2, edits + "I")
        if i < len(initials):
            go(i + 1, q, cost + 3, edits + "D")
            if faults[i] in "t-":
                more = int(faults[i] == "t")
                go(i + 1, new, cost + 2 + more, edits + "R")
                if (q + initials[i]) in ("s", "u", "su", "ua", "au"):
                    go(i + 1, initials[i], cost + more, edits + "K")
    go(0, "", 0, "")
    return min(found)


ROWS = st.lists(st.tuples(st.sampled_from("suauax"), st.sampled_from("---tbd")), max_size=6)


@settings(max_examples=200, deadline=None)
@given(ROWS)
def test_search_is_cheapest_and_least(rows):
    initials, faults = ("".join(c) for c in zip(*rows)) if rows else ("", "")
    cost, edits = repair.cheapest(initials, faults, "", repair.ENDS, True)
    assert (cost, edits) == enumerate_best(initials, faults, cost)
    assert (cost, edits) == best(initials, faults)


@settings(max_examples=60, deadline=None)
@given(st.lists(ROWS.filter(bool), min_size=2, max_size=5))
def test_pieces_give_the_same(parts):
    """Chosen from the costs of pieces as from the whole."""
    import numpy as np
    texts = [tuple("".join(c) for c in zip(*rows)) for rows in parts]
    made = [repair.ways(i, f, k == len(texts) - 1) for k, (i, f) in enumerate(texts)]
    costs = np.array([c for c, _ in made]).reshape(-1, 4, 4)
    ranks = np.array([[sorted(e[q // 4 * 4:q // 4 * 4 + 4]).index(e[q]) for q in range(16)] for _, e in made]).reshape(-1, 4, 4)
    cost, way = repair.choose(costs, ranks)
    edits = "".join(e[4 * q + m] for (_, e), (q, m) in zip(made, way))
    assert (cost, edits) == best("".join(i for i, _ in texts), "".join(f for _, f in texts))


def plain(rows):
    """conv_id: all columns of the query, one conversation after the other."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        kept = talks[conv]
        if key == 0:
            continue
        text = "" if key == 1 else re.sub("[.!?]", "", text) if key == 2 else text
        role = "user" if key == 4 else role
        for copy in range(2 if key == 3 else 1):
            kept.append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest(), copy, text))
    out = {}
    for conv, kept in talks.items():
        kept.sort()
        seen, faults, initials = set(), "", "".join(r[2][:1] if r[2][:1] in ("s", "u", "a") else "x" for r in kept)
        for _, _, role, _, _, text in kept:
            solid = SOLID.findall(text)
            faults += "b" if not solid else "d" if (role, text) in seen else "-" if solid[-1] in ".!?" else "t"
            seen.add((role, text))
        cost, edits = best(initials, faults)
        turns = {r[1] for r in kept if r[0]}
        lines, i, q = [], 0, ""
        for e in edits:
            new = "a" if q == "u" else "u"
            if e == "I":
                lines.append({"u": "user", "a": "assistant"}[new] + ":")
                q = new
                continue
            role, text = kept[i][2], kept[i][5]
            i += 1
            if e != "D":
                q = initials[i - 1] if e == "K" else new
                lines.append((role if e == "K" else {"u": "user", "a": "assistant"}[new]) + ":" + text)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, edits,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, folder):
    rows = entry.queries()["op13_repair"](spark, folder).collect()
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_against_plain(spark):
    import duckdb
    assert run(spark, SF_DIR) == plain(duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF_DIR}/conversations.parquet'").fetchall())


def test_long_conversation_and_defined_cases(spark, tmp_path):
    draw = random.Random(3)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, ""]
    texts = ["So. ", "Why?\n", "open", "", None, " \t", "Ja! x", "漢字。", "a.b"]
    rows = [(c, draw.choice([None, draw.randrange(9)]), draw.choice(roles), draw.choice(texts) if draw.random() < .3 else f"{draw.random()}.")
            for c in (1, 2, 3, None) for _ in range(draw.randrange(12))]
    rows += [(7, t, "user assistant".split()[t % 2] if draw.random() < .8 else draw.choice(roles),
              draw.choice(texts) if draw.random() < .2 else f"{t} words.") for t in range(400)]
    rows += [(None, t, draw.choice(roles), f"{t}") for t in range(120)]
    rows += [(c, 0, "user", "x" * 3_000_000 + ".") for c in range(30, 34)]
    rows += [(100 + c, 0, "user", "only one row") for c in range(60)]
    spark.createDataFrame([(*r, 1, "a") for r in rows], "conv_id long, turn long, role string, text string, place int, audit string") \
        .repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got, want = run(spark, str(tmp_path)), plain(rows)
    assert any(w[6] == "" for w in want.values()) and len(want[7][6]) > 300
    assert got == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert run(spark, str(tmp_path)) == {}


@pytest.mark.parametrize("initials, faults, expected", [
    ("sua", "---", (0, "KKK")), ("", "", (0, "")), ("u", "-", (2, "KI")), ("a", "-", (2, "IK")), ("s", "-", (3, "D")),
    ("ua", "-t", (1, "KK")), ("uu", "-d", (5, "KDI")), ("uu", "--", (2, "KR")), ("ux", "--", (2, "KR")), ("sas", "---", (4, "KRR"))])
def test_by_hand(initials, faults, expected):
    assert repair.cheapest(initials, faults, "", repair.ENDS, True) == best(initials, faults) == expected
