"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page in page order. Text of elements that are page furniture by
their tag, role, class or id (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments,
hidden parts) leaves ``WINDOW`` empty lines in its place, as does text outside the article where the page marks one (an article or main
element or role; where there is none, a class or id that names one). Within an article only names that consist of furniture words count.

Where an article is marked, its lines are the text. On all other pages the distribution of text over lines decides:

* A line weighs the characters outside links less those in links. Lines of running text (paragraphs, quotations, headings, captions, preformatted
  text) weigh three times that, and at least their length: a paragraph that is one link is text. Copyright notices, and rows of at least
  WINDOW lines that are links for their most part, weigh nothing.
* Weights are summed over a sliding window of WINDOW lines. A surge is a line with weight at which the sum reaches ``THRESHOLD`` (or half
  of the greatest sum, on pages with little text); its dive is the next line at which the sum is below it again. Lines at the front of such a span that are
  no running text and do not reach the threshold on their own are there for what follows them, and are cut.
* What is kept is all between the first surge and the last dive but lines that weigh nothing, with the running text that directly goes before or comes after,
  empty lines aside.

Character references are decoded, white space (as Unicode has it) inside a block is turned into one space, blocks are
trimmed and joined by newlines. A null or empty page gives an empty text; each row gives one row; nothing is capped; other columns, whatever their
names are, are ignored.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from itertools import dropwhile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillstone.llm.shared import map_arrow, table

WINDOW, THRESHOLD = 3, 80

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ENDS = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in "script style textarea title noscript iframe xmp noembed noframes".split()}
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul caption".split())
_DROP = frozenset("head script style noscript template svg iframe object applet canvas nav aside footer dialog menu button select textarea datalist audio video map".split())
_CONTROLS = frozenset("input select textarea button".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert status menu menubar form toolbar".split())
#: Elements that a class or id may name as furniture; paragraphs, quotations, headings and the like are running text whatever they are called.
_BOXES = frozenset("div section article ul ol li dl table tbody tr td span center details figure fieldset header".split())
#: Words that mark furniture wherever they stand in a name, and such as do so only as a whole class name.
_FURNITURE = frozenset("nav navigation navbar navi menu menus menubar breadcrumb breadcrumbs crumbs pagination pager sidebar sidebars footer masthead banner cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login paywall ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted comments commentlist disqus sharing social widget widgets copyright".split())
_ALONE = frozenset("aside rail foot toc notice notices notification notifications alert alerts comment reply replies respond related recommended recommendations trending share skip search form".split())
_PAIRS = {"related": "posts articles stories content links reading topics", "recommended": "posts articles stories content reading", "share": "buttons bar links box this tools", "search": "box bar", "skip": "link links", "comment": "list section area thread respond", "notice": "bar box", "alert": "bar box", "site": "notice"}
_NAMED_PAIRS = frozenset(f"{a} {b}" for a, bs in _PAIRS.items() for b in bs.split())
_ARTICLE = frozenset("article post entry story content main".split())
_BODIES = frozenset(f"{a} {b}" for a in ("article", "post", "entry", "story") for b in ("body", "content", "text"))
_NEGATIONS = frozenset("with has no without".split())
_CLOSES_P = _BLOCK - {"body", "html"}
_LISTED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDERS = ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "div")
_RUNNING = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figcaption".split())
#: What goes before and what follows furniture words in names that consist of them.
_LEADS = _ARTICLE | frozenset("blog page reader site user".split())
_PARTS = frozenset("area bar block box button buttons container content form group inner link left links list outer panel placeholder right section slot tools unit wrap wrapper".split())
_NOTICE = re.compile(r"^(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)
#: A form with fewer characters of text a control is one to fill in; any other wraps text.
FORM_TEXT = 200


def _attrs(text: str) -> dict:
    return {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(text)} if text and "=" in text or "hidden" in text else {}


def _names(attrs: dict) -> list[list[str]]:
    """The words of each class and of the id."""
    return [[x.lower() for x in _NAMES.findall(name)] for name in (*attrs.get("class", "").split(), attrs.get("id", ""))] if attrs else []


def _dropped(tag: str, attrs: dict, in_article: bool) -> bool:
    """Whether an element is furniture: by its element or role; boxes also by the words of their classes and id."""
    if tag in ("html", "body", "main"):
        return False
    if tag in _DROP or tag == "header" and not in_article:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")) or attrs.get("role", "").lower() in _ROLES:
        return True
    if tag not in _BOXES:
        return False
    if any(x.lower() in _ALONE for x in attrs.get("class", "").split()):
        return True
    for words in _names(attrs):
        if not words or not _NEGATIONS.isdisjoint(words):
            continue
        if " ".join(words) in _NAMED_PAIRS:
            return True
        if in_article:
            own = list(dropwhile(_LEADS.__contains__, words))
            if own and own[0] in _FURNITURE and own != ["advertising"] and all(x in _FURNITURE or x in _ALONE or x in _PARTS for x in own):
                return True
            continue
        of_article = not _ARTICLE.isdisjoint(words)
        if words[-1] in _FURNITURE or not of_article and not _FURNITURE.isdisjoint(words) or "header" in words and not of_article:
            return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """(text before, tag as `name attributes` or `/name`, or empty): one pass that looks at each character a few times at most.

    Comments, declarations and the end are empty tags; contents of scripts and the like are left out with their closing tags. A `<`
    that opens no tag, or that no `>` follows, is text.
    """
    start = at = 0
    last, quoted, closes = page.rfind(">"), True, True
    while 0 <= (lt := page.find("<", at)) < last:
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            tag, before, at = "", page[start:lt], end + 3 if end >= 0 else len(page)
        elif closes and page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            closes = end >= 0
            if not closes:
                continue
            tag, before, at = "", page[start:lt] + html.escape(page[lt + 9 : end], False), end + 3
        elif page[lt + 1] in "!?":
            tag, before, at = "", page[start:lt], page.find(">", lt) + 1
        elif name := _NAME.match(page, lt + 1 + (page[lt + 1] == "/")):
            end = name.end()
            mark = None
            while quoted and (mark := _ENDS.search(page, end)) and mark[1]:
                end = page.find(mark[1], mark.end()) + 1 or mark.end()
            if quoted and mark is None:
                quoted, end = False, name.end()
            end = page.find(">", end)
            closing = page[lt + 1] == "/"
            tag, before, at = "/" + name[0] if closing else name[0] + " " + page[name.end() : end], page[start:lt], end + 1
            if not closing and (raw := _RAW.get(name[0].lower())):
                found = raw.search(page, at)
                at = found.end() if found else len(page)
        else:
            at = lt + 1
            continue
        yield before, tag
        start = at
    yield page[start : lt if lt >= 0 and page.startswith("<!--", lt) else len(page)], ""


def lines_of(page: str, by_name: bool = False) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, in an article, is running text) of every block; stripped furniture leaves empty lines."""
    out: list[tuple[str, int, bool, bool]] = []
    buffer: list[str] = []
    linked = 0
    stack: list[tuple[str, bool]] = []  # open elements, with whether they are an article
    places: dict[str, list[int]] = {}  # depths at which each element is open
    blocks: list[int] = []  # depths of open blocks
    forms: list[list] = []  # depth, lines before, controls, whether it wraps an article
    skip_from = -1  # depth of the element that is being dropped
    articles = links = 0
    running = False

    def flush() -> None:
        nonlocal linked, running
        text = " ".join("".join(buffer).split())
        if text:
            out.append((text, linked, articles > 0, running))
        buffer.clear()
        linked, running = 0, False

    def gap() -> None:
        flush()
        out.extend([("", 0, False, False)] * WINDOW)

    def close(depth: int) -> None:
        nonlocal articles, links, skip_from
        while len(stack) > depth:
            name, article = stack.pop()
            places[name].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            articles -= article
            links -= name == "a"
            if skip_from == len(stack):
                skip_from = -1
            if forms and forms[-1][0] == len(stack):
                judge()

    def judge() -> None:
        """Drops the lines of a form that is one to fill in."""
        flush()
        _, before, controls, wraps = forms.pop()
        if controls and not wraps and sum(len(x[0]) for x in out[before:]) < FORM_TEXT * controls:
            del out[before:]
            gap()

    def top(*names: str) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def push(name: str, article: bool) -> None:
        places.setdefault(name, []).append(len(stack))
        if name in _BLOCK:
            blocks.append(len(stack))
        stack.append((name, article))

    for before, token in tokens(page):
        if before and skip_from < 0:
            text = html.unescape(before)
            buffer.append(text)
            linked += len(text.strip()) if links else 0
        if not token:
            continue
        if token[0] == "/":
            tag = token[1:].lower()
            depth = top(tag)
            if depth >= 0 and (skip_from < 0 or depth >= skip_from):
                if tag in _BLOCK and skip_from < 0:
                    flush()
                dropped = skip_from == depth
                if stack[depth][1] and skip_from < 0:
                    gap()
                close(depth)
                if dropped and tag in _BLOCK:
                    gap()
            elif tag in _BLOCK and skip_from < 0:
                flush()
            continue
        tag, _, rest = token.partition(" ")
        tag = tag.lower()
        if forms and skip_from < 0 and tag in _CONTROLS and not re.search(r"type\s*=\s*[\"']?hidden", rest, re.I):
            forms[-1][2] += 1
        if tag == "br":
            if skip_from < 0:
                buffer.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr" and skip_from < 0:
                flush()
            continue
        if tag in _RAW:
            continue
        if skip_from < 0:
            if tag in _CLOSES_P and blocks and stack[blocks[-1]][0] == "p":
                flush()
                close(blocks[-1])
            if tag in _LISTED:
                same = top(*_LISTED[tag])
                if same >= 0 and same > top(*_HOLDERS) and not (tag in ("td", "th") and top("tr") > same):
                    flush()
                    close(same)
        elif tag in ("li", "p") and stack[-1][0] == tag and len(stack) - 1 > skip_from:
            close(len(stack) - 1)
        if rest.rstrip().endswith("/") and tag not in _BLOCK:
            continue
        attrs = _attrs(rest)
        if skip_from < 0 and (_dropped(tag, attrs, articles > 0) or forms and tag in ("label", "legend")):
            if tag in _BLOCK:
                gap()
            skip_from = len(stack)
            push(tag, False)
            continue
        article = skip_from < 0 and (tag in ("article", "main") or attrs.get("role", "") in ("main", "article") or attrs.get("itemprop") == "articleBody")
        if not article and skip_from < 0 and tag in ("div", "section", "td"):
            names = _names(attrs)
            article = any(" ".join(words) in _BODIES for words in names) or by_name and any(words and words[-1] in _ARTICLE for words in names)
        if skip_from < 0 and tag in _BLOCK:
            flush()
        if article and not articles:
            gap()
        if forms and skip_from < 0 and (article or tag == "h1"):
            for form in forms:
                form[3] = True
        if tag == "form" and skip_from < 0:
            forms.append([len(stack), len(out), 0, False])
        push(tag, article)
        articles += article
        links += tag == "a"
        if tag in _RUNNING and skip_from < 0:
            running = True
    flush()
    while forms:
        judge()
    return out


def weights(lines: list[tuple[str, int, bool, bool]]) -> list[int]:
    """What each line counts for; 0 for empty ones, notices, rows of links and single links that are no running text."""
    out, row = [0] * len(lines), []
    for i, (text, linked, _, running) in enumerate([*lines, ("end", 0, False, False)]):
        if text and len(text) <= 2 * linked:
            row.append(i)
        elif text:
            if len(row) >= WINDOW:
                for k in row:
                    out[k] = 0
            row = []
        if i < len(lines) and text and not _NOTICE.search(text):
            own = max(0, len(text) - 2 * linked)
            out[i] = max(len(text), 3 * own) if running else own
    return out


def spans(weight: list[int], running: list[bool]) -> list[tuple[int, int]]:
    """Spans of lines from a surge to its dive, by sums of weights over WINDOW lines; light lines at the front are cut."""
    n = len(weight)
    sums = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        sums[i] = sums[i + 1] + weight[i] - (weight[i + WINDOW] if i + WINDOW < n else 0)
    least = min(THRESHOLD, max(sums) / 2)
    out: list[tuple[int, int]] = []
    start = None
    for i in range(n + 1):
        dense = i < n and sums[i] >= least and sums[i] > 0
        if start is None and dense and weight[i] and (running[i] or weight[i] >= least):
            start = i
        elif start is not None and not dense:
            out.append((start, i))
            start = None
    return out


def dense_lines(lines: list[tuple[str, int, bool, bool]]) -> list[int]:
    """Places of the lines that the distribution keeps: between the first surge and the last dive, and running text next to them."""
    weight, running = weights(lines), [r for *_, r in lines]
    found = spans(weight, running)
    if not found:
        return []
    first, last = found[0][0], found[-1][1] - 1
    filled = [i for i, (text, *_) in enumerate(lines) if text]
    at, end = bisect.bisect_left(filled, first), bisect.bisect_right(filled, last)
    while at > 0 and running[filled[at - 1]] and weight[filled[at - 1]]:
        at -= 1
    while end < len(filled) and running[filled[end]] and weight[filled[end]]:
        end += 1
    return [i for i in filled[at:end] if weight[i]]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines = lines_of(page)
    if not any(article for text, _, article, _ in lines if text):
        lines = lines_of(page, by_name=True)
    if any(article for text, _, article, _ in lines if text):
        return "\n".join(text for text, _, article, _ in lines if text and article)
    return "\n".join(lines[i][0] for i in dense_lines(lines))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every page; null ids and urls stay null, repeated rows stay."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return {key: batch.column(0), url: batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_arrow(pages.select(key, url, column), run, f"{key} {kinds[key]}, {url} {kinds[url]}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
