"""Main text of web pages by consensus of their host.

Every page scores its containers: text counts for them, text of links against them, and elements that are menus, headers,
footers, sidebars, notices, adverts, forms or comments by their tag, role or class words count for nothing. The page votes
for the container that holds the main text with its generalised path (tags with class and id words, numbers made equal).
Spark counts the votes of each host; paths with at least a tenth of them win, ten at most. Each page is then read again:
its text is what lies in the host's first winning path that the page has, or in its own choice where that won too and lies
deeper; a page with no winning path keeps its own choice.

Hosts that hold a large share of all pages are joined with their paths by broadcast, the others by host, so no host
gathers in one task; the counts are added up before they move.

Defined results: null or empty HTML gives an empty text; a null URL has the empty host, which votes like any other; text
without any tag is main text; white space is Unicode's, the no-break space included; an element that is not closed ends
with what holds it; repeated rows are each extracted; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallymark.llm.common import saved, spread_join
from tallymark.llm.html_tree import HEADINGS, Page, parse
from tallymark.llm.urls import parts

#: Least share of a host's votes that makes a path win.
SHARE = 0.1
#: A container passes to one inside it that holds this share of its text, or this one where that is an article by name.
HOLDS, ARTICLE_HOLDS = 0.7, 0.3
#: Text of links is taken off this many times.
LINKS = 1.0
#: An element with a weak sign of being no main text is kept if it holds this share of the page's text.
MOST = 0.6

# Signs of what is not main text.
NEVER = frozenset("script style noscript template svg canvas object audio video iframe select button dialog datalist map".split())
ASIDE = frozenset("nav footer aside menu search".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adunit sponsor sponsored sponsors "
    "outbrain taboola nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager sidebar sidebars footer "
    "colophon masthead topbar cookie cookies consent gdpr newsletter comment comments commentlist replies respond disqus "
    "discussion skiplink".split())
WEAK = frozenset(
    "header banner notice notices alert alerts popup popover modal overlay widget widgets related recommended recommendations "
    "share sharing social promo promotion promos subscribe subscription signup login search toolbar rail copyright tabs form "
    "responses reply".split())
CONTENT = frozenset("article content main entry post story text body".split())
PLAIN = frozenset("article main p page".split()) | HEADINGS
CONTAINERS = frozenset("page div section article main center td th table tbody tr form figure details fieldset header".split())

WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NUMBERS = re.compile(r"[0-9]+")


def words_of(told: dict[str, str]) -> set[str]:
    """Words of classes and id, neighbours joined too (``side-bar``); what a page has (``has-sidebar``) is not one of them."""
    found: set[str] = set()
    for name in f"{told.get('class', '')} {told.get('id', '')}".split():
        if not name.lower().startswith(("has-", "with-", "no-", "without-")):
            single = [w.lower() for w in WORD.findall(name)]
            found.update(single, map("".join, zip(single, single[1:])))
    return found


def step(tag: str, told: dict[str, str] | None) -> str:
    """Generalised step of a path: the tag with its classes in order and its id, numbers made equal."""
    if told is None:
        return tag
    classes = sorted({NUMBERS.sub("0", c) for c in told.get("class", "").split()})
    name = NUMBERS.sub("0", "".join(told.get("id", "").split()))
    return "".join([tag, *[f".{c}" for c in classes], *([f"#{name}"] if name else [])]).replace(">", "")


class Scored:
    """A page with what is seen of it and how much text each element holds."""

    def __init__(self, page: Page):
        self.page = page
        tag, parent, told = page.tag, page.parent, page.told
        count = len(tag)
        sign = [0] * count  # 2: no main text, 1: a weak sign of it
        self.article = [False] * count
        linked, inside = [False] * count, [False] * count
        for k in range(1, count):
            up, name, says = parent[k], tag[k], told[k]
            linked[k] = linked[up] or name == "a"
            inside[k] = inside[up] or name in ("article", "main")
            self.article[k] = name in ("article", "main")
            if name in NEVER or name in ASIDE:
                sign[k] = 2
            elif name in ("form", "header"):
                sign[k] = 1
            if says is not None:
                sign[k] = max(sign[k], self._sign(name, says))
                if sign[k] == 0 and not self.article[k]:
                    self.article[k] = says.get("role") in ("main", "article") or says.get("itemprop") == "articleBody" or (
                        name in CONTAINERS and bool(words_of(says) & CONTENT))
        # Text and text of links held by each element.
        size = [len(" ".join(text.split())) for _, _, text in page.pieces]
        plain, link = [0] * count, [0] * count
        for (k, _, _), n in zip(page.pieces, size):
            (link if linked[k] else plain)[k] += n
        held = plain.copy()
        for k in range(count - 1, 0, -1):
            if tag[k] not in NEVER:
                held[parent[k]] += held[k]
        self.seen = [True] * count
        heading = [False] * count
        for k in range(1, count):
            if sign[k] == 1 and held[k] > MOST * held[0]:
                sign[k] = 0
            up, name = parent[k], tag[k]
            heading[k] = heading[up] or name in HEADINGS
            headed = name in HEADINGS and self._in_header(up, inside)
            self.seen[k] = sign[k] == 0 and (self.seen[up] or headed)
        self.good = [p - LINKS * s if ok else 0.0 for p, s, ok in zip(plain, link, self.seen)]
        self.heads = [0] * count  # pieces of the page's headings of the first two levels
        for (k, _, _), n in zip(page.pieces, size):
            if n and self.seen[k] and heading[k]:
                self.heads[k] += 1
        for k in range(count - 1, 0, -1):
            self.good[parent[k]] += self.good[k]
            self.heads[parent[k]] += self.heads[k]

    @staticmethod
    def _sign(name: str, says: dict[str, str]) -> int:
        hidden = "hidden" in says or says.get("aria-hidden", "").lower() == "true" or re.search(
            r"display\s*:\s*none|visibility\s*:\s*hidden", says.get("style", ""), re.I)
        if hidden or says.get("role", "").lower() in ROLES:
            return 2
        found = words_of(says)
        if name in PLAIN and name not in ("p",):
            return 2 if name == "article" and found & {"comment", "comments", "reply"} else 0
        if found & STRONG:
            return 2
        return 1 if found & WEAK and not found & CONTENT else 0

    def _in_header(self, k: int, inside: list[bool]) -> bool:
        """Whether ``k`` lies in the header of an article that is itself seen: its headings belong to the text."""
        tag, parent = self.page.tag, self.page.parent
        while k > 0 and tag[k] in ("div", "hgroup") and not self.seen[k]:
            k = parent[k]
        return k > 0 and tag[k] == "header" and inside[parent[k]] and self.seen[parent[k]]

    def children(self) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        for k in range(1, len(self.page.tag)):
            if self.seen[k] and self.page.tag[k] in CONTAINERS and self.good[k] > 0:
                found.setdefault(self.page.parent[k], []).append(k)
        return found

    def choice(self) -> int | None:
        """The container of the main text; None where the page has no text."""
        if self.good[0] <= 0:
            return None
        children, k = self.children(), 0
        while self.page.tag[k] != "article" and k in children:
            inner = children[k]
            best = max(inner, key=lambda c: (self.article[c], self.good[c], -c))
            alone = sum(self.article[c] for c in inner) == 1
            least = ARTICLE_HOLDS if self.article[best] and alone else HOLDS
            if not (self.article[best] and alone):
                best = max(inner, key=lambda c: (self.good[c], -c))
            titled = self.page.tag[best] not in ("article", "main") or self.page.tag[k] == "main"
            if self.good[best] < least * self.good[k] or titled and self.heads[best] < self.heads[k]:
                break
            k = best
        return k

    def path(self, k: int) -> str:
        steps = []
        while k > 0:
            steps.append(step(self.page.tag[k], self.page.told[k]))
            k = self.page.parent[k]
        return ">".join(["page", *reversed(steps)])

    def matches(self, paths: list[str]) -> list[list[int]]:
        """For each path the seen elements that have it, in page order, none inside another."""
        wanted = [p.split(">") for p in paths]
        tag, parent, told = self.page.tag, self.page.parent, self.page.told
        out: list[list[int]] = [[0] if len(w) == 1 else [] for w in wanted]
        alive: list[list[tuple[int, int]]] = [[]] * len(tag)  # which paths an element has begun, and how far
        alive[0] = [(i, 1) for i, w in enumerate(wanted) if len(w) > 1]
        for k in range(1, len(tag)):
            before = alive[parent[k]]
            if before and self.seen[k]:
                own, go_on = step(tag[k], told[k]), []
                for i, depth in before:
                    if wanted[i][depth] == own:
                        if depth + 1 == len(wanted[i]):
                            out[i].append(k)
                        else:
                            go_on.append((i, depth + 1))
                alive[k] = go_on
        return out

    def text(self, within: list[int]) -> str:
        """The seen blocks inside the elements ``within``, one a line."""
        last = self.page.last
        spans = iter(within)
        start = next(spans, None)
        lines: list[list[str]] = []
        block = -1
        for k, b, piece in self.page.pieces:
            while start is not None and k >= last[start]:
                start = next(spans, None)
            if start is None:
                break
            if k >= start and self.seen[k]:
                if b != block:
                    lines.append([])
                    block = b
                lines[-1].append(piece)
        joined = (" ".join("".join(line).split()) for line in lines)
        return "\n".join(line for line in joined if line)

    def main_text(self, paths: list[str]) -> str:
        """Text of the first of the host's ``paths`` that the page has, or of its own choice (see the module)."""
        own = self.choice()
        at = self.path(own) if own is not None else None
        for path, found in zip(paths, self.matches(paths)):
            if found:
                if at in paths and at.startswith(path + ">"):
                    break
                if self.page.tag[found[0]] not in ("article", "main"):
                    found = [max(found, key=lambda k: (self.good[k], -k))]
                return self.text(found)
        return self.text([own]) if own is not None else ""


def hosted(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("address"),
                        F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), F.col(f"`{html}`").alias("html"))
    return rows.select("key", "address", parts(F.col("url"))[0].alias("host"), "html")


def winning_paths(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """host, paths (most votes first) and size (its pages), from rows with ``host`` and ``html``."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for source in batch.column("html"):
                scored = Scored(parse(source.as_py() or ""))
                own = scored.choice()
                paths.append(None if own is None else scored.path(own))
            yield pa.record_batch([batch.column("host"), pa.array(paths, pa.string())], names=["host", "path"])

    votes = saved(pages.select("host", "html").mapInArrow(vote, "host string, path string").groupBy("host", "path").agg(
        F.count("*").alias("n")))
    hosts = saved(votes.groupBy("host").agg(
        F.sum("n").alias("size"), F.sum(F.when(F.col("path").isNotNull(), F.col("n")).otherwise(0)).alias("cast"),
        F.count("*").alias("kinds")))
    named = spread_join(votes, hosts.drop("size"), "host", "kinds")
    won = named.where(F.col("path").isNotNull() & (F.col("n") >= share * F.col("cast")))
    best = won.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))).alias("paths"))
    return saved(hosts.join(best, "host", "left").select(
        "host", "size", F.coalesce(F.col("paths.path"), F.array().cast("array<string>")).alias("paths")))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", share: float = SHARE) -> DataFrame:
    """``key``, ``url`` and ``text`` of every page."""
    rows = hosted(pages, key, url, html)
    whole = spread_join(rows, winning_paths(rows, share), "host", "size")
    kind = rows.schema["key"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                Scored(parse(source.as_py())).main_text(paths.as_py()) if source.is_valid else ""
                for source, paths in zip(batch.column("html"), batch.column("paths"))]
            yield pa.record_batch([batch.column("key").cast(arrow), batch.column("address"), pa.array(texts, pa.string())],
                                  names=["key", "address", "text"])

    out = whole.select("key", "address", "html", "paths").mapInArrow(run, f"key {kind.simpleString()}, address string, text string")
    return out.toDF(key, "url", "text")
