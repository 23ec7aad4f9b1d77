"""The main text of web pages, from the distribution of text over line blocks.

Markup is stripped to lines, one per block-level element, each with the length of its text. Text in elements that are
never part of an article (menus, headers, footers, sidebars, notices, adverts, forms, comments) has length 0, and so has
the text of links outside an article. The lengths are summed over sliding windows of `WINDOW` lines. Where the sum surges
to the threshold a text region begins, where it dives to 0 the region ends; all lines between, from the first to the last
with a length, are kept, those of links alone too. The threshold is the mean length of the page's own lines, so the
densest region is always kept however short it is; it is `THRESHOLD` at most. The distribution decides on pages without
article or main only: a marked-up article is a region by itself, of which all lines are kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]

WINDOW = 3
#: Window sum, in characters, that makes a surge outside marked-up articles at the latest.
THRESHOLD = 80

# Element names by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
NOT_TEXT = frozenset("script style noscript template svg math iframe object textarea select canvas".split())
ASIDE = frozenset("nav header footer aside form menu dialog head button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the second kind closes.
CLOSED_BY = {"li": {"li"}, "p": BLOCKS, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|menu|nav\w*|breadcrumbs?|sidebar|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|social|related|"
    r"comments?|disqus|footer|header|masthead|copyright|login|signup|widget|pagination|pager|toolbar)(?:$|[\s_-])",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def _is_aside(name: str, attributes: str, in_article: bool) -> bool:
    if name in ASIDE and not (in_article and name == "header"):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and _BOILERPLATE.search(value) or key == "role" and value.lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, length that counts, whether it lies in an article) of every block with text, in page order."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each is an aside
    text: list[str] = []
    linked = asides = articles = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            out.append((line, 0 if asides else len(line) if articles else max(0, len(line) - linked), bool(articles) and not asides))
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not asides:
            piece = html.unescape(piece)
            text.append(piece)
            if any(name == "a" for name, _ in stack[-4:]):
                linked += len(piece.strip())

    def pop(to: int) -> None:
        nonlocal asides, articles
        while len(stack) > to:
            name, aside = stack.pop()
            asides -= aside
            articles -= name in ("article", "main")

    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS:
                flush()
            elif name == "br":
                text.append(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if name not in BLOCKS and stack[i][0] in BLOCKS:
                    break
            continue
        if name in NOT_TEXT:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in BLOCKS:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if name in CLOSED_BY.get(stack[i][0], ()):
                    pop(i)
                    break
                if stack[i][0] in BLOCKS and stack[i][0] not in CLOSED_BY:
                    break
        if name in VOID:
            if name in ("br", "hr", "wbr"):
                text.append(" " if name == "br" else "")
            continue
        if m[3].rstrip().endswith("/"):
            continue
        aside = _is_aside(name, m[3], articles > 0)
        if aside:
            flush()
        stack.append((name, aside))
        asides += aside
        articles += name in ("article", "main")
    add(page[at:])
    flush()
    return out


def main_text(page: str) -> str:
    """The blocks between surges and dives, joined by an empty line."""
    lines = lines_of(page)
    if any(inside for _, _, inside in lines):
        return "\n\n".join(line for line, _, inside in lines if inside)
    lengths = [n for _, n, _ in lines]
    kept: list[str] = []
    least = max(1.0, min(THRESHOLD, sum(lengths) / max(1, len(lengths))))
    start = None
    for i in range(len(lines) + 1):
        window = sum(lengths[i : i + WINDOW])
        if start is None and window >= least:
            start = i
        elif start is not None and window == 0:
            counted = [j for j in range(start, i) if lengths[j]]
            kept += [line for line, _, _ in lines[counted[0] : counted[-1] + 1]]
            start = None
    return "\n\n".join(kept)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds `text` (the main text, empty if none) and `n_chars` (its code points) and drops `html_col`.

    Blocks keep page order; white space inside one is a single space; character references are decoded; nothing else is
    dropped or cut. Pages are read whole, broken and truncated markup included; null is an empty page. Each page is a
    row of its own, so repeated pages give repeated rows. Input columns called text or n_chars are replaced.
    """
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = [main_text(x or "") for x in part.column(len(others)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*others, "text", "n_chars"])

    return pages.select(*others, html_col).mapInArrow(run, f"{schema}{', ' if schema else ''}text string, n_chars long")
