"""Main text of web pages by differencing pages with neighbouring URLs.

A page falls into text lines, one for each block element. Pages are ordered by
host, URL path and URL; each is aligned with its neighbours of the same host by
the longest common subsequence of lines, and shared lines are taken for the
site's frame and deleted. Two things need the markup as well: lines inside an
article or main element are the page's own even if a neighbour carries the same
passage, and lines in menus, headers, footers, sidebars, notices, adverts, forms
and comment threads go even if no neighbour shares them. All other lines, also
those beside an article, stay if no neighbour shares them and go if one does. A
page that shares nearly all words is a copy and says nothing about the frame: the
next page in order that is no copy is the neighbour. Copies are judged on the
words outside the frame, which is what the markup says is frame and, on hosts of
enough pages, lines that nearly all their pages have. (With fewer pages, stubs in
one frame can't be told from copies, and keep it.)

Defined cases: null html is empty, text ""; a null or broken URL gives an empty
host and path, and such pages are neighbours of each other; equal URLs are
ordered by place in the scan; a page without neighbours keeps what the markup
leaves, only the article or main element where it has one; unclosed and stray tags are tolerated; repeated rows are separate pages;
extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prefix_sum, with_row_id
from tidemark.session import write_stage

#: Fixed values of HTML: elements by what they do to text.
RAW = "script style noscript template textarea svg math iframe object canvas audio video select option title".split()
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small "
             "span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OWN = {"article", "main"}
FRAME = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "header", "head"}
FRAME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
#: Class and id names, compared whole: those of what is never page text, and those that page text may carry as well.
#: The latter, and names with a part from either list, are confirmed by what neighbours share.
FRAME_NAMES = set("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored cookie cookies popup nav "
                  "navbar navigation breadcrumb breadcrumbs footer sidebar newsletter subscribe".split())
THREADS = {"comments", "disqus", "replies"}             # often full of article elements
DOUBTFUL = FRAME_NAMES | THREADS | set("promo promos promotion banner consent notice modal overlay menu header masthead aside widget related share social signup "
                             "login comment".split())

TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: One attribute from its start: the name, then the value if it has one.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|[\"'=][^\s>]*")
#: GUESSED is dropped like CHROME, but an article or main element in it is MAIN again, unless it stands in one itself.
#: DOUBT is a doubtful name inside an article: unlike MAIN it goes if a neighbour shares it.
PLAIN, MAIN, CHROME, GUESSED, DOUBT = range(5)
#: Share of the words of either page from which a neighbour counts as a copy.
COPY = 0.8
#: A line is the host's frame on hosts of so many different pages if this share of them has it.
LEAST_PAGES, USUAL = 5, 0.9
#: So many copies are passed one by one; then a run of pages that are each a copy of the one before is passed at once.
SINGLY = 4


def _role(name: str, attributes: str, now: int, inside: bool) -> int:
    """Role of the text in an element, given that of its parent."""
    if now == CHROME:
        return CHROME
    given = {}
    for key, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        if key:
            given.setdefault(key.lower(), next(filter(None, values), ""))
    as_role = given.get("role", "").strip().lower()
    if "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or as_role in FRAME_ROLES:
        return CHROME
    if (name in OWN or as_role in OWN) and not (now == GUESSED and inside):
        return MAIN
    if name in FRAME and not (name == "header" and inside):
        return CHROME
    if now != GUESSED and name not in ("html", "body"):
        words = [w.lower() for key in ("class", "id") for w in given.get(key, "").split()]
        if any(w in THREADS for w in words):
            return CHROME
        if any(w in FRAME_NAMES for w in words):
            return GUESSED
        if now == MAIN and any(w in DOUBTFUL or not DOUBTFUL.isdisjoint(re.split("[_-]+", w)) for w in words):
            return DOUBT
    return now


def lines_of(html: str) -> list[tuple[str, int]]:
    """Text lines of a page with their roles, in page order."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    role, at = PLAIN, 0

    def close():
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            out.append((line, role))
    while True:
        tag = TAG.search(html, at)
        piece = html[at:tag.start()] if tag else html[at:]
        if piece:
            text.append(unescape(piece))
        if not tag:
            break
        at = tag.end()
        if not tag[2]:
            continue
        name = tag[2].lower()
        if name in RAW:
            if not tag[1] and not tag[3].endswith("/"):
                end = re.compile(f"</{name}\\s*>", re.I).search(html, at)
                at = end.end() if end else (len(html) if name in ("script", "style") else at)
            continue
        if name not in INLINE:
            close()
        if tag[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name in INLINE and stack[i][1] != role:
                        close()
                    del stack[i:]
                    break
                if name in INLINE and stack[i][0] not in INLINE:
                    break                                       # a stray inline end closes no block
            role = stack[-1][1] if stack else PLAIN
        elif name not in VOID and not tag[3].endswith("/"):
            inner = _role(name, tag[3], role, any(r == MAIN for _, r in stack))
            if name in INLINE and inner != role:
                close()
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            stack.append((name, inner))
            role = inner
    close()
    return out


def shared(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    low, high = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    where: dict[int, list[int]] = {}
    for j in range(len(b) - high - 1, low - 1, -1):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []                   # least end in b of a common subsequence of each length
    ends: list[tuple] = []
    for i in range(low, len(a) - high):
        for j in where.get(a[i], ()):
            k = bisect_left(tails, j)
            link = (i, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(link)
            elif j < tails[k]:
                tails[k], ends[k] = j, link
    middle, link = [], ends[-1] if ends else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(low), *reversed(middle), *range(len(a) - high, len(a))]


def host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def _hashed(lines) -> list[int]:
    return [xxhash.xxh64_intdigest(line) - (1 << 63) for line, _ in lines]


def outlines(pages: DataFrame) -> DataFrame:
    """row_id, host, path, url, and of each line its hash, its role and its words; same: hash of all lines and roles."""
    @F.pandas_udf("hashes array<long>, roles array<int>, words array<int>")
    def outline(htmls: pd.Series) -> pd.DataFrame:
        pages = [lines_of(h or "") for h in htmls]
        return pd.DataFrame({"hashes": [_hashed(p) for p in pages], "roles": [[r for _, r in p] for p in pages],
                             "words": [[line.count(" ") + 1 for line, _ in p] for p in pages]})
    rows = with_row_id(pages.select("page_id", "url", "html"), "row_id")
    return (rows.withColumn("o", outline("html")).select("row_id", host("url").alias("host"), path("url").alias("path"), "url", "o.*")
            .withColumn("same", F.xxhash64(F.size("hashes"), "hashes", "roles")))


def frame_lines(pages: DataFrame) -> DataFrame:
    """row_id and the places of the lines that a neighbouring page shares; pages compared with none are left out.

    Pages of a host with equal lines are one page here, at the place of the first of them.
    Each side of a page is asked again, further on, while it only met copies.
    """
    outlined = write_stage(outlines(pages), "page-outlines")
    asking = F.exists("roles", lambda r: r.isin(PLAIN, DOUBT))
    hosts = outlined.where(asking).select("host").distinct()        # other hosts have nothing to decide
    firsts = (outlined.join(hosts, "host", "left_semi").groupBy("host", "same").agg(F.min(F.struct("path", "url", "row_id")).alias("k"))
              .select("host", "same", F.col("k.row_id").alias("row_id")))
    distinct = write_stage(outlined.join(firsts.select("row_id"), "row_id"), "page-distinct")
    sizes = distinct.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    usual = (distinct.select("host", F.explode(F.array_distinct("hashes")).alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
             .join(sizes, "host").where(F.col("n") >= USUAL * F.col("pages")).groupBy("host").agg(F.collect_list("hash").alias("usual")))

    @F.pandas_udf("array<int>")
    def own_words(hashes: pd.Series, roles: pd.Series, words: pd.Series, usual: pd.Series) -> pd.Series:
        """Words of each line, 0 for lines of the frame."""
        out = []
        for h, r, w, u in zip(hashes, roles, words, usual):
            frame = set(u.tolist()) if u is not None else ()
            out.append([0 if role in (CHROME, GUESSED) or line in frame else n for line, role, n in zip(h.tolist(), r.tolist(), w.tolist())])
        return pd.Series(out)
    lined = distinct.join(usual, "host", "left").withColumn("words", own_words("hashes", "roles", "words", "usual")).drop("usual").withColumn("one", F.lit(1).cast("long"))
    lined = prefix_sum(lined, [F.col("host"), F.col("path"), F.col("url"), F.col("row_id")], "one", "place", "page-order").drop("one")
    lined = write_stage(lined.withColumn("asking", asking), "page-lined")
    page = F.struct("hashes", "words")

    @F.pandas_udf("array<int>")
    def common(hashes: pd.Series, words: pd.Series, others: pd.Series, other_words: pd.Series) -> pd.Series:
        """Places of the shared lines, null for a copy."""
        out = []
        for a, w, b, v in zip(hashes, words, others, other_words):
            places = shared(a.tolist(), b.tolist())
            w, v = np.asarray(w), np.asarray(v)
            same = int(w[places].sum()) if places else 0
            least = min(int(w.sum()), int(v.sum()))
            out.append(None if least and same >= COPY * least else places)
        return pd.Series(out)

    def compared(asked: DataFrame) -> DataFrame:
        """``asked`` (host, place, at, step) with the places that the page at ``place`` shares with the one at ``at``."""
        mine = lined.select("host", "place", "same", page.alias("m"))
        other = lined.select("host", F.col("place").alias("at"), page.alias("o"))
        return asked.join(mine, ["host", "place"]).join(other, ["host", "at"]).select(
            "host", "place", "same", "at", "step", common("m.hashes", "m.words", "o.hashes", "o.words").alias("places"))

    sides = F.explode(F.array(F.lit(-1), F.lit(1))).alias("step")
    asked = lined.where("asking").select("host", "place", sides).withColumn("at", F.col("place") + F.col("step"))
    done, turn, runs = [], 0, None
    while True:
        found = write_stage(compared(asked), f"page-shared-{turn}")
        done.append(found.where("places IS NOT NULL").select("host", "same", "places"))
        copies = found.where("places IS NULL")
        if copies.isEmpty():
            break
        turn += 1
        if turn < SINGLY:
            asked = copies.select("host", "place", "step", (F.col("at") + F.col("step")).alias("at"))
            continue
        if runs is None:                                        # runs of pages that are each a copy of the one before
            pairs = lined.select("host", "place", F.lit(-1).alias("step"), (F.col("place") - 1).alias("at"))
            linked = compared(pairs).where("places IS NULL").select("host", "place", F.lit(0).cast("long").alias("starts"))
            runs = lined.select("host", "place").join(linked, ["host", "place"], "left").fillna(1, ["starts"])
            runs = prefix_sum(runs, [F.col("host"), F.col("place")], "starts", "before", "page-runs").withColumn("run", F.col("before") + F.col("starts"))
            runs = write_stage(runs.groupBy("host", "run").agg(F.min("place").alias("first"), F.max("place").alias("last")), "page-runs")
            places = write_stage(runs.select("host", "first", "last", F.explode(F.sequence("first", "last")).alias("at")), "page-run-places")
        asked = (copies.select("host", "place", "at", "step").join(places, ["host", "at"])          # on to the next run
                 .select("host", "place", "step", F.when(F.col("step") > 0, F.col("last") + 1).otherwise(F.col("first") - 1).alias("at")))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    merged = every.groupBy("host", "same").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    return outlined.select("row_id", "host", "same").join(merged, ["host", "same"]).select("row_id", "places")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    frames = write_stage(frame_lines(pages), "page-frames").withColumnRenamed("row_id", "r")

    @F.pandas_udf("string")
    def text_of(htmls: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for html, drop in zip(htmls, places):
            lines = lines_of(html or "")
            alone = drop is None and any(r == MAIN for _, r in lines)        # nothing but the markup to go by
            drop = set(drop.tolist()) if drop is not None else ()
            out.append(" ".join(t for i, (t, r) in enumerate(lines) if r == MAIN or i not in drop and (r == DOUBT or r == PLAIN and not alone)))
        return pd.Series(out)

    rows = with_row_id(pages.select("page_id", "url", "html"), "row_id")
    return rows.join(frames, F.col("row_id") == F.col("r"), "left").select("page_id", "url", text_of("html", "places").alias("text"))
