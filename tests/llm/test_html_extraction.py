"""Site template removal against plain counting, and the text of pages against their articles."""

import html
import random
import re
from collections import Counter, defaultdict

import pytest

from txsieve.llm import html_extraction
from txsieve.llm.html_extraction import LEAST_PAGES, ONE_IN_BESIDE, ONE_IN_WITHIN, Page

SF = "/root/testdata/sf0.01"


def as_pages(spark, rows):
    """With columns that have the names of results and of inner columns."""
    named = [(i, u, h, "x", "y", 3) for i, u, h in rows]
    return spark.createDataFrame(named, "page_id long, url string, html string, text string, host string, state int")


def texts(spark, rows):
    return {r.page_id: r.text for r in html_extraction.extract(as_pages(spark, rows)).collect()}


def one(source):
    page = Page(source)
    against, _, _ = page.judged()
    return [b for b, lost in zip(page.blocks, against, strict=True) if not lost]


def test_pages_of_the_tables_give_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_extraction.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for row in rows:
        article = re.search(r"<article>(.*?)</article>", row.html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(b.replace("<b>", "")).split()) for b in re.split(r"</?(?:h1|p|br)>", article)]
        assert got[row.page_id].text == "\n".join(b for b in blocks if b)
        assert (got[row.page_id].url, got[row.page_id].n_chars) == (row.url, len(got[row.page_id].text))


def plain_templates(rows):
    """The templates of each host by counting pages one after the other."""
    seen, pages = defaultdict(set), defaultdict(set)
    for _, url, source in rows:
        host = re.match(r"https?://([^/]+)", url or "")
        if host:
            _, subtrees, article = Page(source or "").judged()
            pages[host[1]].add(article)
            for h, _, _, within in subtrees:
                seen[host[1], html_extraction._signed(h), within].add(article)
    out = defaultdict(set)
    for (host, h, within), found in seen.items():
        if len(found) >= LEAST_PAGES and len(found) * (ONE_IN_WITHIN if within else ONE_IN_BESIDE) >= len(pages[host]):
            out[host].add(h)
    return dict(out)


@pytest.fixture(scope="module")
def site():
    """Two hosts whose pages name nothing: menus and footers are only known by recurring; some paragraphs and whole articles recur too."""
    draw = random.Random(2)
    words = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    menus = {h: [f"<div class='x{k}'><ul><li>{words(2)}<li>{words(1)}</ul></div>" for k in range(3)] for h in ("a.example", "b.example")}
    shared = words(60)
    rows, wanted = [], {}
    copy = [words(30), words(30)]
    for k in range(60):
        host = "a.example" if k % 3 else "b.example"
        # A third of the pages has one article, a tenth a paragraph that others have as well.
        article = copy if k % 3 == 1 else [words(20), *([shared] if k % 10 == 0 else []), words(25)]
        body = f"{draw.choice(menus[host])}<div class=c><p>{'<p>'.join(article)}</div><div class=y><p>All rights kept by {host}</p><p>{words(1)[:0]}</p></div>"
        rows.append((k, f"http://{host}/{k}", f"<html><body>{body}"))
        wanted[k] = "\n".join(article)
    return rows, wanted


def test_recurring_subtrees_go_and_articles_stay(spark, site):
    rows, wanted = site
    assert texts(spark, rows) == wanted


def test_counts_equal_plain_ones(spark, site):
    rows, _ = site
    parsed = html_extraction.parse_pages(as_pages(spark, rows).repartition(7))
    got = {r.host: set(r.templates) for r in html_extraction.site_templates(parsed).collect()}
    assert got == plain_templates(rows)
    assert Counter(len(v) > 3 for v in got.values()) == {True: 2}


def test_few_pages_make_no_template(spark):
    rows = [(k, "http://a.example/", f"<div><p>menu</p></div><div><p>text {k}</p></div>") for k in range(LEAST_PAGES - 1)]
    assert texts(spark, rows) == {k: f"menu\ntext {k}" for k in range(LEAST_PAGES - 1)}


def test_other_hosts_and_pages_without_one_are_not_counted(spark):
    rows = [(k, f"http://h{k}.example/", f"<div><p>menu</p></div><p>text {k}</p>") for k in range(10)]
    rows += [(k, None if k % 2 else "no url", f"<div><p>menu</p></div><p>text {k}</p>") for k in range(10, 20)]
    assert texts(spark, rows) == {k: f"menu\ntext {k}" for k in range(20)}


@pytest.mark.parametrize(
    ("source", "blocks"),
    [
        ("", []),
        ("plain &amp; simple\n text", ["plain & simple text"]),
        ("<article><h1>T</h1><p>one<br>two<p> three </article>", ["T", "one two", "three"]),
        ("<p>a</p>tail<p>b", ["a", "tail", "b"]),
        ("<p>x<script>var t='</p><p>no'</script>y</p>", ["xy"]),
        ("<style>p{}</style><title>no</title><p>yes", ["yes"]),
        ("<p>a<!-- <p>no --> b</p><!-- open", ["a b"]),
        ("<nav><ul><li>no</ul></nav><article><p>yes</article><p>no", ["yes"]),
        ("<div class='page has-sidebar'><main><p>yes</main></div><div id=sidebar>no</div>", ["yes"]),
        ("<header><h1>no</h1></header><article><header><h1>yes</h1><p>by no one</p></header><p>t</article>", ["yes", "t"]),
        ("<article><p>t</p><section class=comments><article><p>no</article></section><form>no<button>x</button></form></article>", ["t"]),
        ("<article><p>t <span class='ad x'>no</span>u</p><div class=cookie-notice>no</div></article>", ["t u"]),
        ("<aside><article><p>no</article></aside><article><p>yes</article>", ["yes"]),
        ("<p>1 &lt; 2 &eacute;&nbsp;&#8364; &unknown; &am", ["1 < 2 é € &unknown; &am"]),
        ("<P>a<B>b</b>c<I>d", ["abcd"]),
        ("<table><tr><td>a<td>b<tr><td><p>c</table>", ["a", "b", "c"]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]),
        ("<div hidden>no</div><div style='display: none'>no</div><p>a < b and c<5</p>", ["a < b and c<5"]),
        ('<p title="a>b" x=\'>\'>t</p></div></p></nope>', ["t"]),
        ("<article></article><p>yes", ["yes"]),
        ("<p>t</p><a href=x class=ad><div>no</div>no</a>u", ["t", "u"]),
        ("<div <p>t", ["t"]),
    ],
)
def test_markup(source, blocks):
    assert one(source) == blocks


def test_deep_and_long_pages(spark):
    deep = "<div>" * 50_000 + "<p>x</p>" + "</div>" * 50_000 + "<p>" * 50_000 + "y"
    long = "<article>" + "".join(f"<p>{'word ' * 40}{i}</p>" for i in range(20_000)) + "</article>"
    got = texts(spark, [(1, "http://a.example/", deep), (2, "http://a.example/", long), (3, "http://a.example/", "<" * 200_000 + "a='" * 50_000)])
    assert got[1] == "x\ny"
    assert got[2] == "\n".join(("word " * 40 + str(i)) for i in range(20_000))
    assert len(got) == 3


def test_null_repeated_and_empty(spark):
    rows = [(None, None, None), (None, None, None), (1, "http://a.example/", None), (1, "http://a.example/", "<p>a"), (1, "http://a.example/", "<p>a")]
    got = html_extraction.extract(as_pages(spark, rows)).collect()
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in got) == Counter(
        {(None, None, "", 0): 2, (1, "http://a.example/", "", 0): 1, (1, "http://a.example/", "a", 1): 2}
    )
    assert html_extraction.extract(as_pages(spark, [])).collect() == []
