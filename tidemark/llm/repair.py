"""Repair of conversations by iterative-deepening A*.

A conversation should be an optional system turn and then user and assistant in
turns, ``(s?(ua)+)?`` over the first letters of the roles. Its rows may be kept
(free), given another role (2) or deleted (3), and empty turns of the user or the
assistant may be put in anywhere (2); blank and repeated rows must be deleted,
and a truncated row that stays costs 1. The answer is the cheapest list of edits,
of equally cheap ones the least in ASCII order of their initials
(``D`` < ``I`` < ``K`` < ``R``).

A depth-first search tries the edits in ASCII order within a cost bound. What the
rows left must cost in any case (deletions that are required, truncated rows) is
the estimate; a state, which is a row and the role before it, that failed is kept
in a table with the least cost that it can still have, and isn't searched again
within less. If nothing is accepted, the bound rises to the least cost that was
cut off. The first path that is accepted is the answer.

Work on rows doesn't depend on how they are dealt out. Rows get numbers by a
distributed prefix sum, without their texts, and PIECE neighbouring rows of a
conversation make a piece. A conversation of one piece is searched as it is. A
longer one, be it a third of all rows, is searched piece by piece in many tasks,
from each role that may be before it to each that may be last in it; the cheapest
way through its pieces is then chosen from these costs, a few numbers a piece.
That is exact: of two different lists of edits over the same rows none is the
start of the other, so the first piece where they differ decides the order.
Texts are moved once, sorted, and edited as a stream, so no conversation is ever
in memory whole; a digest of a conversation is by its nature one task's work.

Defined cases: a null role or text is one space, a null turn goes first, null ids
are one conversation; rows of the same turn go by role and then by the SHA-256 of
their text; repeated rows are duplicates; a first letter that is none of s, u, a
can't be kept; an empty table gives none. Texts of any length are handled row by
row. Other columns are not looked at and not returned.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import inf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prefix_sum
from tidemark.session import write_stage

#: Rows of a conversation that are searched at once.
PIECE = 48
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The role before the next row, by its initial; nothing yet is the first.
BEFORE = ("", "s", "u", "a")
#: What may follow.
FOLLOW = {"": "su", "s": "u", "u": "a", "a": "u"}
#: Where a conversation may end.
ENDS = ("", "a")
NAMES = {"u": "user", "a": "assistant"}
#: Characters that are no white space, and the ends of sentences.
SOLID, STOPS, SPACES = r"[^\x20\x09-\x0D]", "[.!?]", " \t\n\v\f\r"


def put(before: str) -> str:
    """The initial of the turn that an insertion or another role gives."""
    return "a" if before == "u" else "u"


@lru_cache(maxsize=1 << 16)
def cheapest(initials: str, faults: str, before: str, goal: tuple[str, ...], last: bool) -> tuple[float, str]:
    """Cost and edits of the best repair of these rows, from ``before`` to a role of ``goal``.

    ``faults`` has a letter for each row: ``b`` blank, ``d`` duplicate, ``t`` truncated, ``-`` none. Turns are put in
    behind the rows only if they are the ``last`` of the conversation. Without a repair the cost is infinite.
    """
    n = len(initials)
    if not last and not (set(goal) & {"u", "a"} or before in goal or "s" in goal and before == "" and any(
            i == "s" and f in "t-" for i, f in zip(initials, faults))):
        return inf, ""
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + {"b": DELETE, "d": DELETE, "t": TRUNCATED}.get(faults[i], 0)
    failed: dict[tuple[int, str], int] = {}

    def edits(i: int, q: str):
        if i < n:
            yield "D", DELETE, i + 1, q
        if i < n or last:
            yield "I", INSERT, i, put(q)
        if i < n and faults[i] in "t-":
            more = TRUNCATED if faults[i] == "t" else 0
            if initials[i] in FOLLOW[q]:
                yield "K", more, i + 1, initials[i]
            yield "R", REROLE + more, i + 1, put(q)

    def needs(i: int, q: str) -> int:
        return max(least[i], failed.get((i, q), 0))

    bound = needs(0, before)
    while True:
        # a frame: state, what may still be spent, edits not tried, least cost of the edits that failed
        path, stack = [], [((0, before), bound, edits(0, before), [inf])]
        while stack:
            (i, q), left, untried, lowest = stack[-1]
            if i == n and q in goal:
                return bound, "".join(path)
            for letter, cost, j, r in untried:
                if needs(j, r) + cost <= left:
                    path.append(letter)
                    stack.append(((j, r), left - cost, edits(j, r), [inf]))
                    break
                lowest[0] = min(lowest[0], needs(j, r) + cost)
            else:
                failed[i, q] = max(failed.get((i, q), 0), lowest[0])
                stack.pop()
                if path:
                    path.pop()
                if stack:
                    parent, spent = stack[-1], stack[-1][1] - left
                    parent[3][0] = min(parent[3][0], needs(i, q) + spent)
        bound = failed[0, before]


def illegal_pairs(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def ways(initials: str, faults: str, last: bool) -> tuple[list[float], list[str]]:
    """Costs and edits of a piece from each role before it to each at its end, row by row; the last one to any end."""
    found = [cheapest(initials, faults, q, ENDS if last else (m,), last) if not last or m == "" else (inf, "")
             for q in BEFORE for m in BEFORE]
    return [c for c, _ in found], [e for _, e in found]


def choose(costs: np.ndarray, ranks: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """Least cost, and (before, end) of every piece on the cheapest way of least ASCII order.

    ``costs`` and ``ranks`` (order of the edits among those from the same role) are pieces x 4 x 4.
    """
    ahead = [np.zeros(4)]
    for cost in costs[::-1]:
        ahead.append((cost + ahead[-1][None, :]).min(1))
    ahead.reverse()
    way, q = [], 0
    for p, (cost, rank) in enumerate(zip(costs, ranks)):
        total = cost[q] + ahead[p + 1]
        m = min(np.flatnonzero(total == ahead[p][q]), key=lambda m: rank[q][m])
        way.append((q, int(m)))
        q = int(m)
    return int(ahead[0][0]), way


def damage(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, copy, role, text) after damage by a checksum of conversation and turn."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    key = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))) % 20
    text = (F.when(F.col("key") == 1, "").when(F.col("key") == 2, F.regexp_replace("text", STOPS, "")).otherwise(F.col("text")))
    return (rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), key.alias("key"))
            .where("key <> 0")
            .select("conv_id", "turn", F.explode(F.when(F.col("key") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
                    F.when(F.col("key") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text")))


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("copy")]


def matched(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join on equal keys, a null being equal to a null; the keys are those of ``left``."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return left.join(renamed, on, how).drop(*(f"_{k}" for k in keys))


def pieces(rows: DataFrame) -> DataFrame:
    """Rows in order, PIECE to a row: conv_id, n (rows of the conversation), piece, initials, faults."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    seen = (F.when(~F.col("text").rlike(SOLID), "b").when(~F.right(trimmed, F.lit(1)).rlike(STOPS), "t").otherwise("-"))
    initial = F.substring("role", 1, 1)
    short = rows.select("conv_id", "turn", "copy", "role", F.sha2("text", 256).alias("digest"), seen.alias("fault"),
                        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), F.lit(1).cast("long").alias("one"))
    placed = prefix_sum(short, _order(), "one", "place", "repair-rows").select("conv_id", "role", "digest", "fault", "initial", "place")
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"))
    starts = placed.groupBy("conv_id").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    told = (matched(placed, firsts, "conv_id", "role", "digest")
            .select("conv_id", "place", "initial",
                    F.when((F.col("fault") != "b") & (F.col("place") > F.col("first")), "d").otherwise(F.col("fault")).alias("fault")))
    cut = (matched(told, starts, "conv_id")
           .select("conv_id", "n", F.expr(f"(place - start) div {PIECE}").alias("piece"), F.struct("place", "initial", "fault").alias("row")))
    return (cut.groupBy("conv_id", "n", "piece").agg(F.sort_array(F.collect_list("row")).alias("rows"))
            .select("conv_id", "n", "piece", F.array_join("rows.initial", "").alias("initials"), F.array_join("rows.fault", "").alias("faults")))


def _alone(initials: pd.Series, faults: pd.Series) -> pd.DataFrame:
    found = [(*cheapest(i, f, "", ENDS, True), illegal_pairs(i)) for i, f in zip(initials, faults)]
    return pd.DataFrame(found, columns=["cost", "audit", "illegal"])


def _ways(initials: pd.Series, faults: pd.Series, last: pd.Series) -> pd.DataFrame:
    found = [(*ways(i, f, z), illegal_pairs(i)) for i, f, z in zip(initials, faults, last)]
    return pd.DataFrame(found, columns=["costs", "audits", "illegal"])


def _choose(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("piece", ignore_index=True)
    costs = np.array(frame.costs.tolist()).reshape(-1, 4, 4)
    ranks = np.array(frame.ranks.tolist()).reshape(-1, 4, 4)
    cost, way = choose(costs, ranks)
    edges = [0, *(illegal_pairs(a[-1] + b[0]) for a, b in zip(frame.edge, frame.edge[1:]))]
    return pd.DataFrame({"id": frame.id, "piece": frame.piece, "at": [4 * q + m for q, m in way], "edge": edges,
                         "cost": [cost] + [0] * (len(way) - 1)})


def audits(cut: DataFrame) -> DataFrame:
    """Best repairs from ``pieces``: conv_id, cost, audit, illegal, and counts of blank, duplicate and truncated rows."""
    # short rows, but each a search: more tasks than their bytes would give
    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.repartition(parts, "conv_id", "piece")
    counts = [(F.length("faults") - F.length(F.replace("faults", F.lit(f), F.lit("")))).cast("long").alias(name)
              for f, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))]
    alone = (cut.where(F.col("n") <= PIECE).withColumn("best", F.pandas_udf(_alone, "cost long, audit string, illegal long")("initials", "faults"))
             .select("conv_id", "best.cost", "best.audit", "best.illegal", *counts))
    # a conversation of several pieces; its id may be null, which a grouping by pandas would lose
    last = F.col("piece") == F.expr(f"(n - 1) div {PIECE}")
    searched = F.pandas_udf(_ways, "costs array<double>, audits array<string>, illegal long")
    tables = write_stage(cut.where(F.col("n") > PIECE).withColumn("best", searched("initials", "faults", last))
                         .select("conv_id", F.xxhash64(F.col("conv_id").cast("string"), F.col("conv_id").isNull()).alias("id"), "piece",
                                 F.concat(F.substring("initials", 1, 1), F.substring("initials", -1, 1)).alias("edge"),
                                 "best.costs", "best.audits", "best.illegal", *counts), "repair-ways")
    rank = F.transform("audits", lambda a, i: F.size(F.filter(
        F.slice("audits", (F.floor(i / 4) * 4 + 1).cast("int"), F.lit(4)), lambda b: b < a)))
    chosen = (tables.select("id", "piece", "edge", "costs", rank.alias("ranks"))
              .groupBy("id").applyInPandas(_choose, "id long, piece long, at int, edge long, cost long"))
    long = (tables.drop("edge").join(chosen, ["id", "piece"])
            .groupBy("conv_id").agg(
                F.sum("cost").alias("cost"),
                F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", F.col("audits")[F.col("at")].alias("edits")))),
                                         lambda p: p.edits), "").alias("audit"),
                F.sum(F.col("illegal") + F.col("edge")).alias("illegal"),
                *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated"))))
    return alone.unionByName(long)


def gaps(rows: DataFrame) -> DataFrame:
    """Turns missing between the first and the last of each conversation."""
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    return turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))


def apply(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place, edit (I, K or R), role, text.

    The rows of a conversation are in one partition, together and in order.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    both = (rows.select("conv_id", "turn", "copy", "role", "text", F.sha2("text", 256).alias("digest"), F.lit(None).cast("string").alias("audit"))
            .unionByName(edits.select("conv_id", "audit"), allowMissingColumns=True))
    first = F.col("audit").isNull()
    dealt = (both.repartition("conv_id")
             .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), first, *_order()[1:])
             .select("conv_id", "audit", "role", "text"))
    schema = f"conv_id {kind}, place long, edit string, role string, text string"

    def stream(batches):
        audit, at, before, place, conv = "", 0, "", 0, None
        names, id_type = ["conv_id", "place", "edit", "role", "text"], None
        out = []

        def put_in():
            nonlocal at, before, place
            while at < len(audit) and audit[at] == "I":
                before = put(before)
                out.append((conv, place, "I", NAMES[before], ""))
                at, place = at + 1, place + 1

        def batch():
            columns = list(zip(*out)) or [[]] * 5
            types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            out.clear()
            return made

        for b in batches:
            id_type = b.column(0).type
            for i in range(len(b)):
                told = b.column(1)[i].as_py()
                if told is not None:
                    put_in()                            # behind the last row of the conversation before
                    conv, audit, at, before, place = b.column(0)[i].as_py(), told, 0, "", 0
                    continue
                put_in()
                letter, role, at = audit[at], b.column(2)[i].as_py(), at + 1
                if letter == "D":
                    continue
                before = role[0] if letter == "K" else put(before)
                out.append((conv, place, letter, role if letter == "K" else NAMES[before], b.column(3)[i].as_py()))
                place += 1
            if out:
                yield batch()
        put_in()
        if out:
            yield batch()

    return dealt.mapInArrow(stream, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of the lines ``role:text`` of each conversation that ``apply`` has just given."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def stream(batches):
        conv, running, id_type = None, None, None
        for b in batches:
            id_type, done = b.column(0).type, []
            for i, place in enumerate(b.column(1).to_pylist()):
                if place == 0:
                    if running:
                        done.append((conv, running.hexdigest()))
                    conv, running = b.column(0)[i].as_py(), hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{b.column(3)[i].as_py()}:{b.column(4)[i].as_py()}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], id_type), pa.array([d for _, d in done])],
                                                 names=["conv_id", "digest"])
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([conv], id_type), pa.array([running.hexdigest()])], names=["conv_id", "digest"])

    return repaired.mapInArrow(stream, f"conv_id {kind}, digest string")


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``rows`` has conv_id, turn, copy (0, or 1 for a repeat), role, text, as ``damage`` gives them.
    """
    return matched(audits(pieces(rows)), gaps(rows), "conv_id").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
