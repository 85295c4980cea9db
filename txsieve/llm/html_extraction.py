"""The main text of web pages: element subtrees that recur across a host's pages are deleted, then what markup names as no part of the article."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txsieve.llm.common import cut, slices, table

#: A subtree is a site's template if it stands on so many pages of a host with different articles,
LEAST_PAGES = 4
#: and on one in so many of them: subtrees beside an article, and those within one, or single paragraphs and headings.
ONE_IN_BESIDE = 200
ONE_IN_WITHIN = 2

# Elements by what they do to the text around them.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_FLOW = _HEADINGS | frozenset("p pre blockquote".split())
_CELLS = frozenset("li dd dt td th tr".split())
_BLOCKS = _FLOW | _CELLS | frozenset(
    "address article aside body caption center details dialog dir div dl fieldset figcaption figure footer form header hgroup html legend "
    "main menu nav ol optgroup option search section summary table tbody tfoot thead ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe noframes noembed xmp template".split())
#: Elements whose content is left out as well, if they end.
_SKIPPED = frozenset("button select object svg canvas video audio".split())
#: Which open element a new one of the same family ends, unless the family's list stands between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}

# What isn't part of an article, by element, role and the words of class and id.
_ASIDE = frozenset("nav footer aside form dialog menu search header fieldset".split())
_ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split()
)
_ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar sidenav footer header masthead cookie cookies consent gdpr notice notices notification popup modal newsletter subscribe "
    "signup login paywall comment comments disqus respond replies share sharing social related recommended recommendations teaser widget toolbar "
    "pagination pager copyright".split()
)
#: Inside a line only these words count.
_LINE_WORDS = frozenset("ad ads advert advertisement sponsored share".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in _RAW | _SKIPPED}
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), (double or single or bare).lower())
    return found


class Element:
    """An open or ended element: its tag, the element it lies in, the run of text blocks it covers, the hash of its subtree."""

    __slots__ = ("aside", "first", "hash", "header", "last", "parent", "parts", "rank", "tag")

    def __init__(self, tag: str, parent: int, first: int):
        self.tag, self.parent, self.first, self.last = tag, parent, first, first
        self.parts: list[bytes] | None = [tag.encode()]
        self.hash = 0
        self.aside = self.header = False
        self.rank = 0


class Page:
    """A page's blocks of text in order, and its elements as runs of them. Elements without text are dropped."""

    def __init__(self, source: str):
        self.blocks: list[str] = []
        #: The number of the element each block lies in.
        self.owners: list[int] = []
        self.elements = [Element("", -1, 0)]
        self.open = [0]
        self.counts = Counter()
        self.text: list[str] = []
        #: Open elements within a line whose text is left out, and how many blocks were open around them.
        self.quiet: list[tuple[str, int]] = []
        self._read(source)
        while len(self.open) > 1:
            self._end()
        self._flush()
        self._close(self.elements[0])

    def _flush(self) -> None:
        """The text since the last border of a block, as a block if it isn't blank."""
        if self.text:
            block = " ".join("".join(self.text).split())
            self.text.clear()
            if block:
                self.elements[self.open[-1]].parts.append(block.encode())
                self.blocks.append(block)
                self.owners.append(self.open[-1])

    def _close(self, element: Element) -> None:
        element.last = len(self.blocks)
        if element.last > element.first:
            element.hash = xxhash.xxh64_intdigest(b"\x00".join(element.parts))
        element.parts = None

    def _end(self) -> None:
        self._flush()
        element = self.elements[self.open.pop()]
        self.counts[element.tag] -= 1
        while self.quiet and self.quiet[-1][1] > len(self.open):
            self.quiet.pop()
        self._close(element)
        if element.hash:
            self.elements[self.open[-1]].parts.append(element.hash.to_bytes(8, "little"))

    def _end_until(self, tags: set[str], borders: set[str]) -> None:
        """Ends the innermost open element of the tags and all in it, if there is one before a border."""
        if not any(self.counts[tag] for tag in tags):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.elements[self.open[depth]].tag
            if tag in tags:
                while len(self.open) > depth:
                    self._end()
                return
            if tag in borders:
                return

    def _start(self, tag: str, source: str) -> None:
        if tag in _BLOCKS and tag not in ("html", "body") or tag == "hr":
            self._end_until({"p"}, {"button", "td", "th", "caption", "table"})
            self._flush()
            for ended in (_ENDS[tag],) if tag in _ENDS else ():
                self._end_until(*ended)
        elif tag == "br":
            self.text.append(" ")
        if tag in _VOID:
            return
        plain = not source or source.isspace()
        if tag not in _BLOCKS:
            # Of a line's elements only those matter whose text is left out.
            if self.quiet and tag == self.quiet[-1][0] or not plain and self._aside(tag, _attributes(source), _LINE_WORDS):
                self.quiet.append((tag, len(self.open)))
            return
        element = Element(tag, self.open[-1], len(self.blocks))
        named = {} if plain else _attributes(source)
        if tag not in ("html", "body"):
            element.aside = self._aside(tag, named, _ASIDE_WORDS)
            words = _WORD.findall(named.get("class", "") + " " + named.get("id", ""))
            element.header = tag == "header" or "header" in words and tag not in _ASIDE
        if not element.aside:
            main = tag == "main" or named.get("role") == "main" or named.get("itemprop") == "articlebody"
            element.rank = 2 if tag == "article" else 1 if main else 0
        self.open.append(len(self.elements))
        self.counts[tag] += 1
        self.elements.append(element)

    def _aside(self, tag: str, named: dict[str, str], words: frozenset[str]) -> bool:
        if tag in _ASIDE or "hidden" in named or named.get("aria-hidden") == "true":
            return True
        if not named:
            return False
        if named.get("role") in _ASIDE_ROLES or _HIDDEN.search(named.get("style", "")):
            return True
        if tag in ("article", "main") and not _LINE_WORDS.isdisjoint(_WORD.findall(named.get("class", ""))):
            return True
        checked = words if tag not in ("article", "main") else words & {"comment", "comments", "teaser", "related", "promo"}
        return not checked.isdisjoint(_WORD.findall(named.get("class", "") + " " + named.get("id", "")))

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            tag = _TAG.search(source, at)
            end = tag.start() if tag else size
            if end > at and not self.quiet:
                text = source[at:end]
                self.text.append(html.unescape(text) if "&" in text else text)
            if not tag:
                return
            at = tag.end()
            name = (tag[2] or "").lower()
            if not name or not tag[4]:
                continue
            if tag[1]:
                if name in _BLOCKS:
                    self._end_until({name}, {"table"} if name not in ("table", "body", "html") else set())
                elif any(name == open_tag for open_tag, _ in self.quiet):
                    while self.quiet.pop()[0] != name:
                        pass
            elif name in _RAW or name in _SKIPPED:
                close = _CLOSING[name].search(source, at)
                stop = source.find(">", close.start()) + 1 if close else 0
                if close or name in _RAW:
                    at = stop or size
            else:
                self._start(name, tag[3])

    def articles(self) -> list[int]:
        """The elements that hold the page's articles: those for articles, or else main ones; those beside the content only if there are no others."""
        named = [k for k, e in enumerate(self.elements) if e.rank and e.last > e.first]
        beside = [False] * len(self.elements)
        for k, e in enumerate(self.elements[1:], start=1):
            beside[k] = beside[e.parent] or e.aside
        named = [k for k in named if not beside[k]] or named
        best = max((self.elements[k].rank for k in named), default=0)
        return [k for k in named if self.elements[k].rank == best]

    def judged(self) -> tuple[list[bool], list[tuple[int, int, int, bool]], int]:
        """(whether markup speaks against each block, the subtrees that may be templates, a hash of the article).

        A subtree is its hash, the run of blocks it covers and whether only one in ``ONE_IN_WITHIN`` pages makes it a template. Of
        elements that cover the same blocks only the inner counts. Articles and what they lie in are never templates.
        """
        elements = self.elements
        roots = self.articles()
        holds = {0}
        for k in roots:
            while k not in holds:
                holds.add(k)
                k = elements[k].parent
        within, aside, header = [False] * len(elements), [False] * len(elements), [False] * len(elements)
        for k in roots:
            within[k] = True
        innermost = {}
        for k, e in enumerate(elements[1:], start=1):
            up = e.parent
            # A header in an article may hold its headings; markup around an article says nothing about it.
            header[k] = header[up] or e.header and within[up]
            aside[k] = aside[up] or e.aside and not (e.header and within[up]) and k not in holds
            within[k] = within[k] or within[up]
            if e.last > e.first and k not in holds and e.tag not in ("html", "body"):
                innermost[e.first, e.last] = k
        against = [aside[k] or header[k] and elements[k].tag not in _HEADINGS or bool(roots) and not within[k] for k in self.owners]
        subtrees = []
        for (first, last), k in innermost.items():
            single = elements[k].tag in _FLOW
            if not (single and within[k]):
                rare = single or within[k]
                subtrees.append((elements[k].hash ^ rare, first, last, rare))
        own = b"\x00".join(b.encode() for b, lost in zip(self.blocks, against, strict=True) if not lost)
        return against, subtrees, xxhash.xxh64_intdigest(own)


_SUBTREE = pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("within", pa.bool_())])
_PARSED = pa.schema([("article", pa.int64()), ("blocks", pa.list_(pa.string())), ("against", pa.list_(pa.bool_())), ("subtrees", pa.list_(_SUBTREE))])
_PARSED_DDL = (
    "page_id long, url string, host string, article long, blocks array<string>, against array<boolean>, "
    "subtrees array<struct<hash:long,first:int,last:int,within:boolean>>"
)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _parsed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, column="html"):
        rows = []
        for source in batch.column("html").to_pylist():
            page = Page(source or "")
            against, subtrees, article = page.judged()
            found = [{"hash": _signed(h), "first": a, "last": b, "within": w} for h, a, b, w in subtrees]
            rows.append({"article": _signed(article), "blocks": page.blocks, "against": against, "subtrees": found})
        columns = [pa.array([r[f.name] for r in rows], f.type) for f in _PARSED]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), *columns], ["page_id", "url", "host", *_PARSED.names])


def host_of(url: str) -> Column:
    """The lower-case host of a URL, null where it has none."""
    found = F.regexp_extract(F.lower(F.col(url)), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.when(F.length(found) > 0, found)


def parse_pages(pages: DataFrame) -> DataFrame:
    """Every page's blocks of text and element subtrees, written; null html is an empty page. Pages aren't moved between tasks."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of("url").alias("host"), "html")
    return cut(rows.mapInArrow(_parsed_rows, _PARSED_DDL), "pages-parsed")


def site_templates(parsed: DataFrame) -> DataFrame:
    """(host, templates): the hashes of the subtrees that recur across many pages of each host.

    Pages with the same article count once, so copies of an article don't make its parts a template. Counts are added up before
    they are moved, and keys are hosts with hashes, so no host meets in one task. A host's list is bounded: only so many subtrees can each
    stand on one in ``ONE_IN_BESIDE`` pages.
    """
    known = parsed.filter("host IS NOT NULL")
    pages = cut(known.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("pages")), "host-pages")
    each = known.select("host", "article", F.explode("subtrees").alias("s")).select("host", "article", "s.hash", "s.within").distinct()
    found = each.groupBy("host", "hash", "within").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES)
    one_in = F.when(F.col("within"), ONE_IN_WITHIN).otherwise(ONE_IN_BESIDE)
    many = found.join(pages, "host").filter(F.col("n") * one_in >= F.col("pages"))
    return cut(many.groupBy("host").agg(F.collect_set("hash").alias("templates")), "site-templates")


def main_text(parsed: DataFrame, templates: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_template, n_markup): what is left of each page, and how many blocks went as a template and by markup alone."""
    joined = parsed.join(templates, "host", "left")
    recurring = F.array_intersect(F.col("subtrees.hash"), F.coalesce("templates", F.array().cast("array<bigint>")))
    runs = _once(recurring, lambda hit: F.filter("subtrees", lambda s: F.array_contains(hit, s["hash"])))
    covered = lambda runs, i: F.exists(runs, lambda s: (s["first"] <= i) & (i < s["last"]))
    state = _once(runs, lambda runs: F.transform("against", lambda lost, i: F.when(covered(runs, i), 2).when(lost, 1).otherwise(0)))
    count = lambda state, which: F.size(F.filter(state, lambda s: s == which)).cast("long")
    found = _once(
        state,
        lambda state: F.struct(
            F.array_join(F.filter("blocks", lambda b, i: F.get(state, i) == 0), "\n").alias("text"),
            count(state, 2).alias("n_template"),
            count(state, 1).alias("n_markup"),
        ),
    )
    out = joined.select("page_id", "url", F.inline(F.array(found)))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template", "n_markup")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body or a function within it uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page, one row a page, without template subtrees and what markup marks as no part of the article.

    Pages are parsed once; the subtrees' hashes are counted per host, and a page's blocks meet the host's templates, which is a broadcast join only where
    Spark finds the written table small; else adaptive execution splits a host that has many pages. Null and empty pages give an empty text. Line breaks within a block
    are white space. Pages without a host have no templates. Ids may be null or repeat; further columns are not read.
    """
    parsed = parse_pages(pages)
    return main_text(parsed, site_templates(parsed))


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
