"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped so that each block of the page becomes a line. Menus, adverts and other parts
that their elements or names give away become blank lines. The length of a block is summed over a
window of lines sliding down the page. Where the sum surges over a threshold, main text begins; it
goes back to the first line after a blank window and ends where the sum dives to nothing. The
threshold is never above the page's largest sum, so the largest part is found however short.

A name that holds a listed word among others only hints: that part stays if a window of its own
lines surges. So must what stands before a page's first ``h1``, which blank lines set apart; where nothing
surges, the page begins there. A line
that begins with an advert's label, and what follows a heading of reader comments up to the next
heading as high, become blank lines too.

Text inside links doesn't count, so that a list of links never surges. Where a page marks its
article, only lines of the article are searched, with no blanks for what was stripped. There a
window dives at lines that are links; a link of fewer lines than a window stays where it stands
between lines of main text, or before the article's first, as a heading does.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from viewlens.llm.tables import appended, pieces, without

#: Lines in a window, and the characters it must hold to begin main text.
WINDOW, SURGE = 3, 86

#: Elements whose text is never shown, or not as text.
RAW = "script|style|noscript|template|svg|math|textarea|iframe|object|canvas|audio|video|title|datalist"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)>|<[!?/][^>]*>""",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|=|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.IGNORECASE)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that end where the next block begins, if nothing ends them before.
OPEN = frozenset("p dt dd".split()) | HEADINGS
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no main text, and words in class, id or role that say so of any element.
OTHER = frozenset("nav footer aside form menu select button dialog head search".split())
OTHER_NAMES = frozenset(
    "ad adbox ads adsbox adsense adslot adunit advert adverts advertisement advertising alert alertdialog banner "
    "breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookiebanner "
    "cookiebar cookies disqus footer form gdpr masthead menu menubar modal nav navbar navigation newsletter notice "
    "notices pagination popup promo promoted promotion related replies respond responses search share sharing "
    "sidebar sidebars social sponsor sponsored subscribe toolbar topbar widget".split()
)
ARTICLE = frozenset(["article", "main"])
#: Words that may stand beside a listed one in a name without making it a mere hint.
PLAIN_NAMES = frozenset(
    "area bar block bottom box center container content global inner item items left links list main outer page "
    "panel primary right secondary section site slot top unit wrap wrapper".split()
)
ADVERT = re.compile(r"(?:advertisement|sponsored(?: content| post)?|anzeige|werbung|publicité|publicidad)\s*(?:[:|–—-]|\Z)", re.IGNORECASE)
READERS = re.compile(
    r"(?:\d+\s+)?(?:(?:reader|readers'|user)\s+)?(?:comments?|replies|responses|what (?:our )?readers say|"
    r"leave a (?:comment|reply)|join the discussion|kommentare|commentaires|comentarios)\s*(?:\(\d+\))?:?",
    re.IGNORECASE,
)


def says_other(attributes: str) -> tuple[bool, bool]:
    """Whether a name in class, id or role says that an element is other than the article, and
    whether one hints at it: ``site-nav`` says so, ``social-history`` hints."""
    says = hints = False
    for a, b, c in _NAMES.findall(attributes):
        for name in (a or b or c).lower().split():
            named = [w for w in re.split(r"[^a-z]+", name) if w]
            if not OTHER_NAMES.isdisjoint(named):
                hints = True
                says |= all(w in OTHER_NAMES or w in PLAIN_NAMES for w in named)
    return says, hints


def is_other(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is other than the article for certain, and whether it may be."""
    if tag in OTHER or tag == "header" and not in_article:
        return True, True
    if not attributes or tag in ("html", "body") or tag in ARTICLE and "comment" not in attributes.lower():
        return False, False
    says, hints = says_other(attributes)
    return says or bool(_HIDDEN.search(attributes)), hints


def window_sums(lengths: np.ndarray) -> np.ndarray:
    """The characters of the window that begins at each line."""
    total = np.concatenate(([0], np.cumsum(lengths)))
    return total[np.minimum(np.arange(len(lengths)) + WINDOW, len(lengths))] - total[:-1]


def lines_of(page: str) -> tuple[list[tuple[str, int, bool]], bool, int]:
    """Lines as (text, length that counts, whether inside an article), blank ones for what is
    stripped; whether the page has an article; and the line of its first ``h1``, or 0."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    links: list[str] = []
    skipped, depth, article, in_link, has_article = "", 0, 0, 0, False
    # the block being read; the level of the heading whose comments are left out; the line of the
    # first h1; the element that a name hints at: its tag, how many of it are open, its first line
    block, readers, titled, hinted = "", 0, 0, ("", 0, 0)

    def blank() -> None:
        lines.extend([("", 0, article > 0)] * WINDOW)

    def unhint() -> None:
        nonlocal hinted, titled
        if hinted[0]:
            own = np.array([size for _, size, _ in lines[hinted[2] :]], np.int64)
            if len(own) and window_sums(own).max() < SURGE:
                del lines[hinted[2] :]
                titled = min(titled, hinted[2])
                blank()
            hinted = ("", 0, 0)

    def flush() -> None:
        nonlocal readers, titled
        text = " ".join(html.unescape("".join(parts)).split())
        level = int(block[1]) if block in HEADINGS else 0
        if text and level:
            if level <= readers:
                readers = 0
            if level > 1 and READERS.fullmatch(text):
                readers = level
            elif level == 1 and not readers and not has_article and not titled:
                blank()
                titled = len(lines)
        if text and (readers or ADVERT.match(text)):
            blank()
        elif text:
            in_links = len(" ".join(html.unescape("".join(links)).split()))
            lines.append((text, max(0, len(text) - 2 * in_links), article > 0))
        parts.clear()
        links.clear()

    end = 0
    for m in _TOKEN.finditer(page):
        if not skipped and m.start() > end:
            parts.append(page[end : m.start()])
            if in_link:
                links.append(page[end : m.start()])
        end = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        if skipped:
            if tag == skipped:
                depth += -1 if closing else 1
            # what a page forgot to close ends where its article or body begins, or, for a
            # paragraph, with the next block
            ends = depth <= 0 or not closing and (tag in ARTICLE and not article or tag == "body")
            ends = ends or skipped in OPEN and tag in BLOCKS and not (closing and tag == skipped)
            if not ends:
                continue
            skipped = ""
            if depth <= 0 and closing and tag not in ARTICLE:
                continue
        if tag in BLOCKS:
            flush()
            block = "" if closing else tag
        elif tag == "br":
            parts.append(" ")
        other, hint = (False, False) if closing or tag in VOID else is_other(tag, attributes, article > 0)
        if other:
            if tag in BLOCKS:
                blank()
            skipped, depth = tag, 1
            continue
        if hinted[0] in OPEN and tag in BLOCKS and not closing:
            unhint()
        if tag == hinted[0]:
            hinted = (tag, hinted[1] + (-1 if closing else 1), hinted[2])
            if not hinted[1]:
                unhint()
        elif hint and not hinted[0] and tag in BLOCKS:
            hinted = (tag, 1, len(lines))
        if tag in ARTICLE:
            unhint()
            readers = 0
            article = max(0, article - 1) if closing else article + 1
            has_article |= not closing
        elif tag == "a":
            in_link = 0 if closing else 1
    if not skipped and end < len(page):
        parts.append(page[end:])
    flush()
    unhint()
    return lines, has_article, titled


def main_lines(lengths: np.ndarray, in_article: bool = False) -> np.ndarray:
    """Which lines lie between a surge and a dive; lines of no length only in an article."""
    if not lengths.any():
        return np.zeros(len(lengths), bool)
    block = window_sums(lengths)
    # a run lasts from one window without text to the next
    run = np.cumsum(np.append(True, (block[1:] > 0) & (block[:-1] == 0)))
    highest = np.zeros(run[-1] + 1, np.int64)
    np.maximum.at(highest, run, block)
    surges = highest >= min(SURGE, block.max())
    main = surges[run] & (lengths > 0)
    if in_article:
        before = np.maximum.accumulate(np.where(main, run, 0))
        after = np.minimum.accumulate(np.where(main, run, run[-1] + 1)[::-1])[::-1]
        main |= (after == run) & ((before == run) | (run == 1))
    return main


def main_text(page: str) -> str:
    lines, has_article, titled = lines_of(page)
    in_article = has_article and any(inside and text for text, _, inside in lines)
    if in_article:
        lines = [line for line in lines if line[2] and line[0]]
    lengths = np.array([size for _, size, _ in lines], np.int64)
    if not in_article and titled and lengths[titled:].any() and window_sums(lengths).max() < SURGE:
        lines, lengths = lines[titled:], lengths[titled:]
    if in_article and not lengths.any():  # nothing but links
        return "\n".join(text for text, _, _ in lines)
    return "\n".join(text for (text, _, _), main in zip(lines, main_lines(lengths, in_article)) if main)


def extract_batches(batches: Iterator[pa.RecordBatch], html_col: str) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, html_col):
        texts = [main_text(p or "") for p in batch.column(html_col).to_pylist()]
        yield appended(batch.drop_columns([html_col]), main_text=pa.array(texts, pa.string()))


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` with ``main_text`` instead of its HTML; a column named ``main_text`` is replaced.

    A null or empty page has an empty text, as has one without text. Each page is read by itself,
    whole: repeated rows and null ids don't matter.
    """
    df = without(df, "main_text")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != html_col]
    return df.mapInArrow(lambda batches: extract_batches(batches, html_col), ", ".join([*kept, "main_text string"]))
