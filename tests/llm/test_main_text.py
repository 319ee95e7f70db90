"""Main text against a plain parser on the given pages, and on pages of other shapes."""

import collections
import html.parser
import re

import pytest

from viewlens.llm import registry
from viewlens.llm.main_text import main_text
from viewlens.llm.tables import load


class Article(html.parser.HTMLParser):
    """The blocks of a page's article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_a_plain_parser_on_the_whole_table(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    got = {r["page_id"]: r for r in registry.op7_main_text(spark, sf_dir).collect()}
    for r in load(spark, sf_dir, "pages").collect():
        parser = Article()
        parser.feed(r["html"] or "")
        parser.close()
        want = "\n".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x)
        assert got[r["page_id"]]["text"] == want
        assert got[r["page_id"]]["n_chars"] == len(want)


LONG = "A sentence of the story that goes on for a good while, with clauses and commas. " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain &lt;text&gt; &amp; more", "plain <text> & more"),
        (f"<article><h1>T</h1><p>{LONG}<div class='ad'>Buy {LONG}</div><p>End.</article>", f"T\n{LONG.strip()}\nEnd."),
        (f"<div class=ad>unclosed<article><p>a<b>b</b> c<br>d&nbsp; e</p>", "ab c d e"),
        (f"<article><p>x</p><section id='comments'><p>{LONG}</p></section></article>", "x"),
        (f"<article><p>x</p></article><article class='comment'><p>{LONG}</p></article>", "x"),
        (f"<header><h1>Site</h1></header><ul><li><a href=1>{LONG}</a><li><a>b</a></ul><div><p>{LONG}</p><p>Er.</p></div><footer>f</footer>", f"{LONG.strip()}\nEr."),
        (f"<div id='cookie-notice'>{LONG}</div><div><p>Short.</p></div><aside>{LONG}</aside>", "Short."),
        (f"<p>one</p><form><label>{LONG}</label></form><p>{LONG}</p>", LONG.strip()),
        ("<main><p>a<!-- <p>no</p> --><script>var t='</p>';</script>b</p></main>", "ab"),
        ('<p title="a > b">x</p><p title="broken>y</p>', "x\ny"),
        ("<article><header><h1>Head</h1></header><p>Body</p></article>", "Head\nBody"),
        ("<article><p class='ad'>no<p>yes</article>", "yes"),
        ("<p>a &am &#233; &bogus; &#x1F600;</p>", "a &am é &bogus; 😀"),
    ],
)
def test_shapes(page, want):
    assert main_text(page) == want


def test_awkward_rows(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "<article>" + "<p>x y</p>" * 50_000)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id bigint, html string, MAIN_TEXT string")
    from viewlens.llm.main_text import extract

    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got == sorted([(1, ""), (1, ""), (None, ""), (2, "\n".join(["x y"] * 50_000))], key=str)
    assert extract(df.limit(0)).collect() == []


LINKS = "".join(f"<li><a href='/{k}'>Another story of the week, number {k}</a></li>" for k in range(5))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><h1><a href=1>T</a></h1><p>{LONG}<ul>{LINKS}</ul><p>Offer ends soon.</article>", f"T\n{LONG.strip()}"),
        (f"<article><ul>{LINKS}</ul><p>{LONG}<p><a href=2>A source</a><p>{LONG}<p>End.</article>", f"{LONG.strip()}\nA source\n{LONG.strip()}\nEnd."),
        (f"<main><p>{LONG}<div>{LINKS}</div><p>{LONG}</main>", f"{LONG.strip()}\n{LONG.strip()}"),
        ("<article><p><a href=1>only a link</a></article>", "only a link"),
    ],
)
def test_a_window_of_links_dives_in_an_article(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><h1>T</h1><div class='social-history'><p>{LONG}</div><section id='form-and-function'><p>{LONG}</section><p>End</article>", f"T\n{LONG.strip()}\n{LONG.strip()}\nEnd"),
        (f"<article><p>{LONG}<div class='post-social'>Share this</div><p>End</article>", f"{LONG.strip()}\nEnd"),
        (f"<article><p class='post-social'>Share this<p>{LONG}</article>", LONG.strip()),
        (f"<div><p>{LONG}<div>Advertisement: buy {LONG}</div><p>{LONG}</div>", f"{LONG.strip()}\n{LONG.strip()}"),
        (f"<div><h1>T</h1><p>{LONG}</p><div><h3>What readers say</h3><p>Bob: {LONG}</p></div></div>", f"T\n{LONG.strip()}"),
        (f"<article><h2>Comments</h2><p>{LONG}<h2>More</h2><p>{LONG}</article>", f"More\n{LONG.strip()}"),
        (f"<article><h1>Comments</h1><p>{LONG}</article>", f"Comments\n{LONG.strip()}"),
        ("<div>Buy this and that and more of it.</div><div><h1>Short.</h1><p>Text.</div>", "Short.\nText."),
    ],
)
def test_hints_and_labels(page, want):
    assert main_text(page) == want


def test_lengths_decide_where_pages_mark_neither_article_nor_adverts(spark):
    n_ads = n_kept = 0
    for r in load(spark, "/root/testdata/sf0.01", "pages").collect():
        plain = re.sub(r"(</?)article\b", r"\1div", r["html"]).replace('class="ad"', 'class="zz"')
        got, want = main_text(plain).split("\n"), main_text(r["html"]).split("\n")
        assert not collections.Counter(want) - collections.Counter(got)
        n_ads += plain.count('class="zz"')
        n_kept += len(got) - len(want)
    assert n_ads > 200 and n_kept <= 0.1 * n_ads
