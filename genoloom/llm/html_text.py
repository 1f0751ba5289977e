"""Main text of web pages: a two-pass classification of blocks."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags and class words with a meaning of their own, and frequent words of some languages.
BLOCKS = frozenset("address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul video audio canvas object svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head title button select option textarea iframe noscript template dialog svg canvas object video audio".split())
BOILER_TAGS = frozenset("nav header footer aside form menu".split())
BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments comentarios consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
LAYOUT_WORDS = frozenset("and area bar block body bottom box button buttons container content extra fixed float form global group in inline inner js left link links list main mobile outer overlay page panel post right section site slot sticky the top unit up view wrap wrapper".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
STOP_WORDS = frozenset("""
the of and to in a is that it for on was be with as this by are from at or an have not his he they which but we you all
de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son sa ses aux
der die und das von zu den mit sich auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
el los las del y que por con no su para es al lo como mas pero sus o este ha si una
""".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")


def _named_boiler(value: str) -> bool:
    """Whether one of a class or id attribute's names is made of boilerplate words, and words of layout beside them."""
    for name in value.split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if not BOILER_WORDS.isdisjoint(parts) and all(x in BOILER_WORDS or x in LAYOUT_WORDS for x in parts):
            return True
    return False


def _boiler(tag: str, attributes: str) -> bool:
    """Whether an element's tag or attributes say that it is no part of the article."""
    if tag in BOILER_TAGS or tag in SKIPPED:
        return True
    if not attributes.strip():
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in BOILER_ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main") and _named_boiler(value):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, in a boilerplate element, in an article) of each block of a page, in order.

    A close tag ends the innermost open element of its name with all inside it, and is ignored where none is open;
    a paragraph ends where the next block begins.
    """
    out: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, in boilerplate, in an article
    parts: list[str] = []
    linked, at, links = 0, 0, 0

    def end() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.append((text, min(linked, len(text)), stack[-1][1] if stack else False, stack[-1][2] if stack else False))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        parts.append(raw)
        if links:
            linked += len("".join(html.unescape(raw).split()))

    for m in _TAG.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[1]:
                parts.append(" ")
            continue
        closing, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in BLOCKS or (not closing and tag not in VOID and attributes and _boiler(tag, attributes)):
            end()
            links = 0 if tag != "p" else links
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            else:
                while stack and stack[-1][0] == "p":
                    stack.pop()
                if tag not in VOID and not attributes.rstrip().endswith("/"):
                    boiler, article = stack[-1][1:] if stack else (False, False)
                    stack.append((tag, boiler or _boiler(tag, attributes), article or tag in ("article", "main")))
        elif closing and any(tag == s[0] for s in stack):
            end()
            while stack.pop()[0] != tag:
                pass
    if at < len(page):
        say(page[at:])
    end()
    return out


def evidence(text: str, linked: int, article: bool, short: int, long: int, low: float, high: float, links: float) -> int:
    """What a block says of itself: 2 and more, it is article text; -1 and less, it is not; between, it is open.

    Stop-word density counts with the length behind it; an article or main element adds one point, so that in it a
    block without stop words (a table, a list of names) is open rather than out.  Dense links take a point, a block
    that is little else than links is out.
    """
    if linked > links * len(text):
        return article - 1 if linked < 0.8 * len("".join(text.split())) else -1
    words = _WORD.findall(text.lower())
    density = sum(x in STOP_WORDS for x in words) / max(1, len(words))
    if len(text) < short:
        points = 0
    elif density >= high or density >= low and len(text) >= long:
        points = 2
    else:
        points = 1 if density >= low else -1
    return points + article


def classify(found: list[tuple[str, int, bool, bool]], short: int = 70, long: int = 200, low: float = 0.2, high: float = 0.3, links: float = 0.33) -> list[bool]:
    """Whether each block is article text.

    Blocks of elements that their markup names as boilerplate are out and are nobody's neighbours.  First pass over
    the others, each by itself: stop-word density, length and link density decide, or leave it open (``evidence``).
    Second pass: an open block takes the label of the nearest decided block, where two are as near, in wins if either
    is; without any decided block all open ones are in.
    """
    out = [False] * len(found)
    rest = [k for k, b in enumerate(found) if not b[2]]
    points = [evidence(found[k][0], found[k][1], found[k][3], short, long, low, high, links) for k in rest]
    label = [True if x >= 2 else False if x < 0 else None for x in points]
    n = len(rest)
    left, right = [None] * n, [None] * n
    last = None
    for i in range(n):
        last = i if label[i] is not None else last
        left[i] = last
    last = None
    for i in range(n - 1, -1, -1):
        last = i if label[i] is not None else last
        right[i] = last
    for i, k in enumerate(rest):
        x = label[i]
        if x is None:
            a, b = left[i], right[i]
            if a is None and b is None:
                x = True
            elif a is None or b is None:
                x = label[b if a is None else a]
            else:
                x = label[a] if i - a < b - i else label[b] if b - i < i - a else label[a] or label[b]
        out[k] = bool(x)
    return out


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by one space; a null page has none."""
    found = blocks(page or "")
    return " ".join(b[0] for b, keep in zip(found, classify(found), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html; other columns are ignored).

    Each page is one row's own work: no shuffle.  Null or empty html gives an empty text; repeated rows give
    repeated rows, an empty table an empty one.  A very long page is read whole, in time and memory in proportion.
    Ties between neighbours are settled in ``classify``; nothing else can tie.
    """

    def run(batches):
        for pdf in batches:
            text = [main_text(x) for x in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(x) for x in text]})

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The synthetic pages keep the article in one element: heading and paragraphs.  SQL for that layout.
OP5_SQL = """
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's') as x from pages),
b as (select page_id, url, regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?(p|h1)>', ' ', 'g') as x from a),
c as (select page_id, url, regexp_replace(x, '<[^>]*>', '', 'g') as x from b),
d as (select page_id, url, regexp_replace(replace(replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;', '"'), '&#39;', ''''), '&amp;?', '&', 'g') as x from c),
e as (select page_id, url, trim(regexp_replace(x, '\\s+', ' ', 'g')) as text from d)
select page_id, url, text, length(text) as n_chars from e
"""
