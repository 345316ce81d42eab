"""Personal data by bootstrapped contextual extraction.

Base expressions find e-mail addresses, IP addresses, card and phone numbers.
They are the seeds: the two words in front of a find, and the one behind it, are
lexical patterns. Over the graph of patterns and instances Spark alternates two
steps: a pattern scores by the share of its instances that are known of a kind,
where those of no known kind count by ``UNLABELLED``, an instance by the patterns
that extract it. Identifier-like strings that the expressions miss, but that
confident patterns extract, are added as spans: words with a digit or an at sign,
runs of numbers with single blanks between, and addresses with "at" and "dot"
spelled out, each with the context of the whole.

Scoring works on counted edges, so a pattern or an instance with a third of all
mentions is one row per neighbour, and every step is a grouped sum.

Defined cases: a null text counts as empty and has no spans; spans count code
points, end exclusive; a word that touches a base span is not a candidate,
and a run of more than 19 digits falls into its words;
repeated rows keep their own spans but, counting once, lend a pattern no weight;
with no seeds nothing is added; of two kinds with equal confidence the one listed
first is added; base spans and contexts take time linear in the text, whatever
its longest word; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, string_batches, with_row_id
from tidemark.session import write_stage

#: Kinds in the order of ties, and their expressions.
KINDS = ("email", "ip", "card", "phone")
EXPRESSIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What could be an identifier: a string with a digit or an at sign, at least this long.
CANDIDATE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
LEAST_LENGTH = 6
#: Words of digits, brackets and hyphens that may go on after the next blank, or from the one before; what may be between; most digits of a run.
GOES_ON = re.compile(r"[^\w\s@]*+[0-9](?:[0-9()./+-]*[0-9)])?")
FOLLOWS = re.compile(r"[(+]?[0-9][0-9()./+-]*+[^\w\s@]*+")
BETWEEN = re.compile("[ \u00a0](?:[-/\u2013][ \u00a0])?")
MOST_DIGITS = 19
#: An e-mail address with its signs spelled out, tried where "dot" occurs.
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({]?\bat\b[\])}]? ?[A-Za-z0-9-]+(?: ?[\[({]?\bdot\b[\])}]? ?[A-Za-z0-9-]+)+", re.I)
DOT = re.compile("dot", re.I)
#: A pattern needs so many different seeds, and this share of its instances known; an instance this score.
SUPPORT, CONFIDENT, ACCEPTED, ROUNDS = 3, 0.8, 0.8, 3
#: What an instance of no known kind counts against a pattern; one known of another kind counts 1.
UNLABELLED = 0.5
#: Longer words of a pattern, and longer instances, go by a hash of all their letters.
WHOLE, SURFACE = 40, 200
FACTOR = 0x9E3779B97F4A7C15

MENTION = "array<struct<at:int,stop:int,kind:string,surface:string,patterns:array<string>>>"
FOUND = f"row_id long, doc_id long, counts array<long>, base array<struct<at:int,kind:int,stop:int>>, mentions {MENTION}"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def holds(kind: str, value: str) -> bool:
    """What the expression of a kind doesn't say itself."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in value.split("."))
    digits = re.sub("[^0-9]", "", value)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


#: What must be in a text for a match to be possible, tested before the expression.
NEEDED = {"email": re.compile("@"), "phone": re.compile(r"\+[0-9]"), "ip": re.compile(r"[0-9]\.[0-9]"), "card": re.compile("[0-9][ -]?[0-9]")}


#: The same matches in linear time: what can start in the middle of a run that has failed is not tried, and no run is given back.
LINEAR = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(EXPRESSIONS["phone"]),
}
#: What may start an address right behind the last one, where the run of its letters has begun before.
AGAIN = re.compile(LINEAR["email"].pattern.partition(")")[2])


def matches(kind: str, text: str):
    """(start, end) of the leftmost non-overlapping matches of a kind's expression."""
    if kind != "email":
        yield from (m.span() for m in LINEAR[kind].finditer(text))
        return
    at = 0
    while found := AGAIN.match(text, at) or LINEAR[kind].search(text, at):
        yield found.span()
        at = found.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base expressions, by start and then kind."""
    spans = []
    for k, kind in enumerate(KINDS):
        if NEEDED[kind].search(text):
            spans += [(s, k, e) for s, e in matches(kind, text) if holds(kind, text[s:e])]
    return sorted(spans)


class Context:
    """The words of a text, and a short name of any part of one: a part of over WHOLE letters goes by a hash.

    The hashes of all parts of a word come from one running sum, so many finds within one long word cost no more.
    """
    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in re.finditer(r"\S+", text)]
        self.starts = [s for s, _ in self.spans]
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def name(self, word: int, start: int, end: int) -> str:
        if end - start <= WHOLE:
            return re.sub(r"[0-9]", "0", self.text[start:end].lower())
        first, last = self.spans[word]
        if word not in self.sums:
            letters = np.frombuffer(self.text[first:last].encode("utf-32-le", "surrogatepass"), np.uint32)
            inverse = np.cumprod(np.full(len(letters) + 1, pow(FACTOR, -1, 1 << 64), np.uint64))
            powers = np.cumprod(np.full(len(letters), FACTOR, np.uint64))
            codes = mix64(np.where((letters >= 48) & (letters < 58), np.uint32(48), letters).astype(np.uint64))
            self.sums[word] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers)]), inverse
        sums, inverse = self.sums[word]
        part = (int(sums[end - first]) - int(sums[start - first])) * int(inverse[start - first]) % (1 << 64)
        return f"#{end - start}:{part:x}"

    def patterns(self, start: int, end: int) -> list[str]:
        """The lexical patterns of what stands at a place: words in front, words in front with the one behind."""
        word = bisect_left(self.starts, start)                     # the first word that starts at it or behind
        before = [(w, s, min(e, start)) for w, (s, e) in enumerate(self.spans[max(0, word - 2):word], max(0, word - 2))]
        if not before:
            return []
        left = " ".join(self.name(*part) for part in before)
        word = bisect_left(self.starts, end)
        if word and self.spans[word - 1][1] > end:
            after = self.name(word - 1, end, self.spans[word - 1][1])
        else:
            after = self.name(word, *self.spans[word]) if word < len(self.spans) else ""
        return [f"{left} _", f"{left} _ {after}"]


def surface(text: str) -> str:
    """The name of an instance: itself, or a hash if it is long."""
    return text if len(text) <= SURFACE else f"#{len(text)}:{hashlib.sha256(text.encode('utf-8', 'surrogatepass')).hexdigest()}"


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    """Without signs at the ends, but for a plus, and brackets that close within."""
    while s < e and not text[s].isalnum():
        if text[s] in "+(" and text[s + 1:s + 2].isdigit():
            close = text.find(")", s, e)
            if text[s] == "+" or close >= 0 and any(map(str.isalnum, text[close + 1:e])):
                break
        s += 1
    while e > s and not text[e - 1].isalnum():
        e -= 1
    return s, e


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places of what could be an identifier and touches nothing in ``taken``, which is in order."""
    out = [m.span() for m in SPELLED.finditer(text)] if DOT.search(text) else []
    if out:
        starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        out = [(s, e) for s, e in out if not (n := bisect_left(starts, e)) or ends[n - 1] <= s]
    taken, i = sorted([*taken, *out]), 0
    runs: list[list[tuple[int, int]]] = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        cut = _trimmed(text, s, e)
        while i < len(taken) and taken[i][1] <= cut[0]:
            i += 1
        if any(a < cut[1] and cut[0] < b for a, b in taken[max(0, i - 1):i + 4]):
            continue
        if runs and FOLLOWS.fullmatch(text, s, e) and s - runs[-1][-1][1] <= 3 and BETWEEN.fullmatch(text, runs[-1][-1][1], s) \
                and GOES_ON.fullmatch(text, *runs[-1][-1]):
            runs[-1].append((s, e))
        else:
            runs.append([(s, e)])
    for run in runs:
        whole = (run[0][0], run[-1][1])
        long = len(run) > 1 and sum(c.isdigit() for c in text[slice(*whole)]) > MOST_DIGITS
        out += [_trimmed(text, *part) for part in (run if long else [whole])]       # too many digits for one number
    return sorted((s, e) for s, e in out if e - s >= LEAST_LENGTH)


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Base finds and candidates with their patterns."""
    places = [(s, e, KINDS[k]) for s, k, e in spans]
    places += [(s, e, None) for s, e in candidates(text, sorted((s, e) for s, _, e in spans))]
    context = Context(text) if places else None
    return [{"at": s, "stop": e, "kind": kind, "surface": surface(text[s:e]), "patterns": context.patterns(s, e)} for s, e, kind in places]


def find(docs: DataFrame) -> DataFrame:
    """Per document: base spans and mentions. Reads every whole text once."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    rows = with_row_id(docs.select("doc_id", "text"), "row_id").select("row_id", F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = to_arrow_schema(_parse_datatype_string(FOUND))

    def task(batches):
        for batch, texts in string_batches(batches, 2):
            counts, base, seen = [], [], []
            for text in texts:
                spans = base_spans(text)
                counts.append([sum(k == i for _, k, _ in spans) for i in range(len(KINDS))])
                base.append([{"at": s, "kind": k, "stop": e} for s, k, e in spans])
                seen.append(mentions(text, spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(v, f.type) for v, f in zip((counts, base, seen), list(schema)[2:]))],
                schema=schema)
    return rows.mapInArrow(task, FOUND)


def confident_patterns(seen: DataFrame) -> DataFrame:
    """(pattern, kind) of the patterns that extract almost only one kind, after the scoring rounds."""
    edges = write_stage(seen.select("surface", "kind", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    instances = edges.where("kind IS NOT NULL").select("surface", "kind").distinct().withColumn("score", F.lit(1.0))
    seeds = edges.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count_distinct("surface").alias("seeds"))
    sizes = edges.groupBy("pattern").agg(F.count_distinct("surface").alias("size"))
    links = edges.select("pattern", "surface").distinct()
    strong = None
    for turn in range(ROUNDS):
        weights = links.join(instances, "surface").groupBy("pattern", "kind").agg(F.round(F.sum("score"), 9).alias("weight"))
        known = links.join(instances.select("surface").distinct(), "surface").groupBy("pattern").agg(F.count("*").alias("known"))
        strong = (weights.join(sizes, "pattern").join(known, "pattern").join(seeds, ["pattern", "kind"])
                  .withColumn("confidence", F.col("weight") / (F.col("known") + UNLABELLED * (F.col("size") - F.col("known")) + 0.1))
                  .where((F.col("seeds") >= SUPPORT) & (F.col("confidence") >= CONFIDENT)).select("pattern", "kind", "confidence"))
        strong = write_stage(strong, f"pii-patterns-{turn}")
        reached = (links.join(strong, "pattern").groupBy("surface", "kind")
                   .agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"))
                   .withColumn("score", F.round("score", 9)).where(F.col("score") >= ACCEPTED))
        instances = write_stage(
            edges.where("kind IS NOT NULL").select("surface", "kind", F.lit(1.0).alias("score"))
            .unionByName(reached).groupBy("surface", "kind").agg(F.max("score").alias("score")), f"pii-instances-{turn}")
    return strong


def extract(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, counts (base finds by kind), base and spans (arrays of at, kind, stop by place)."""
    found = write_stage(find(docs), "pii-found")
    seen = found.select("row_id", F.explode("mentions").alias("m")).select("row_id", "m.*")
    strong = confident_patterns(seen)
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    added = (seen.where("kind IS NULL").select("row_id", "at", "stop", F.explode("patterns").alias("pattern"))
             .join(strong, "pattern").groupBy("row_id", "at", "stop").agg(F.max_by("kind", F.struct("confidence", -order[F.col("kind")])).alias("kind"))
             .groupBy("row_id").agg(F.collect_list(F.struct("at", order[F.col("kind")].alias("kind"), "stop")).alias("added")))
    return (found.drop("mentions").join(added, "row_id", "left")
            .withColumn("spans", F.sort_array(F.concat("base", F.coalesce("added", F.expr("CAST(array() AS array<struct<at:int,kind:int,stop:int>>)")))))
            .drop("added"))


def joined(spans: str) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["at"].cast("string"), s["stop"].cast("string"))), ",")
