"""Main text of web pages as the maximum-scoring run of a page's words and tags.

A page is read as a run of tokens. Words score positive and tags negative; how much is learned from pages that label their main
text themselves with <article> or <main>: a tag costs more the larger its share outside of them is, and crossing the border of
such an element costs half of what their text scores on average, so that a run leaves one only for much more text. One linear
scan finds the contiguous run with the highest sum, and its first and last block are taken whole. Nothing else chooses the region:
a page without those elements is read by the same scan.

What is never main text is one negative token, wherever it stands: scripts and styles, menus, headers, footers, sidebars, forms,
and containers whose class, id or role says notice, advert, comments or the like, unless they hold the page's <main> or only <article>.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusmill.session import ship
from corpusmill.storage import table

SAMPLE = 2000  # pages that the weights are learned from, about
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
RAW_END = {name: re.compile(f"</{name}", re.I | re.ASCII) for name in RAW}  # lower-casing a page could change its length
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = {"nav", "header", "footer", "aside", "form", "noscript", "template", "select", "dialog", "menu", "head", "object", "canvas", "audio", "video", "datalist"}
NEVER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist"}
_NAME = (
    r"(?:ads?|adverts?|advertisement|advertising|adbox|adsense|adslot|banner|sponsor(?:ed|s)?|promo(?:tion|s)?|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|"
    r"header|masthead|topbar|footer|foot|cookies?|consent|gdpr|notices?|disclaimer|alert|comments?|commentlist|respond|replies|disqus|share|sharing|social|"
    r"related|recommended|newsletter|subscribe|subscription|signup|login|popup|modal|overlay|widget|toolbar|pagination|pager|hidden)"
)
_PLACE = r"(?:site|page|global|main|top|bottom|left|right|primary|secondary|box|bar|area|list|section|block|container|wrapper|wrap|buttons?|links?|[0-9]+)"
#: A whole name of a class or id: such words, and words that say where or what kind of part. Others make it a name of something else.
NEVER_NAMES = re.compile(rf"(?:{_PLACE}[_-]+)*{_NAME}(?:[_-]+(?:{_NAME}|{_PLACE}))*", re.I)
BLOCK = set(
    "address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
APART = BLOCK | {"nav", "header", "footer", "aside", "form", "noscript", "template", "dialog", "menu", "head"}  # what stands between two blocks even if it is skipped
KNOWN = BLOCK | VOID | set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
LABEL = {"article", "main"}
#: Where HTML implies an end: a start tag of ENDS_P ends a paragraph, and one of SIBLINGS ends those elements if they aren't beyond SCOPES.
ENDS_P = BLOCK - {"body", "html", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "legend"} | {"aside", "dialog", "footer", "form", "header", "menu", "nav"}
TABLE_PARTS = {"table", "td", "th", "caption", "html", "object", "template"}
_LIST, _ROWS = {"ul", "ol", "menu", *TABLE_PARTS}, {"table", "html", "template"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}} | dict.fromkeys(
    ("tbody", "thead", "tfoot"), {"tbody", "thead", "tfoot"}
)
SCOPES = {"li": _LIST, "dt": {"dl", *TABLE_PARTS}, "dd": {"dl", *TABLE_PARTS}, "option": {"select", "datalist"}, "optgroup": {"select"}, "td": {"tr", *_ROWS}, "th": {"tr", *_ROWS}} | dict.fromkeys(
    ("tr", "tbody", "thead", "tfoot", "table"), _ROWS
)
SCOPES["table"] = {"html", "template"}
IN_HEAD = RAW | {"base", "basefont", "bgsound", "link", "meta", "noscript", "template", "object"}
DEEPEST = 512  # open elements that an end tag is looked for in, as browsers nest no deeper
ALWAYS = {"head", "noscript", "template", "select", "object", "canvas", "audio", "video", "datalist"}  # skipped whatever they hold
STARTS = {"label": LABEL, "main": {"main"}, "begin": {*LABEL, "h1"}, "text": {*LABEL, "p", "h1", "h2", "h3", "h4", "h5", "h6"}}
DEFAULT_WORD, DEFAULT_TAG, DEFAULT_BORDER = 1.0, -0.25, -50.0
LEAST = 0.05


class Token(NamedTuple):
    kind: str  # word, a tag's name, or never
    words: int
    block: int  # text of one block has one number
    text: str
    inside: bool  # whether it stands in a labelled element; only the weights are learned from that


def _shunned(name: str, attrs: str) -> bool:
    if name in NEVER:
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    seen = set()
    for key, *values in ATTRIBUTE.findall(attrs):
        value = html.unescape(next(filter(None, values), "")).strip()
        key = key.lower()
        if key in seen:  # the first one of a name counts
            continue
        seen.add(key)
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true" and name != "article"):
            return True
        if key == "role" and not NEVER_ROLES.isdisjoint(value.lower().split()[:1]) or key in ("class", "id") and any(map(NEVER_NAMES.fullmatch, value.split())):
            return True
    return False


class Tag(NamedTuple):
    begin: int
    end: int  # where the text after it begins
    name: str
    closing: bool
    attrs: str


def _tags(page: str) -> list[Tag]:
    """The tags of a page in order, without comments and what stands in scripts and the like."""
    at, out = 0, []
    while found := TAG.search(page, at):
        at = found.end()
        name = (found["name"] or found["name2"] or "").lower()
        closing = bool(found["close"] or found["close2"])
        if name in RAW and not closing:
            stop = RAW_END[name].search(page, at)
            at = stop.start() if stop else len(page)
            name = ""
        out.append(Tag(found.start(), at, "" if name in RAW else name, closing, found["attrs"] or found["attrs2"] or ""))
    return out


def _opens(tag: Tag) -> bool:
    return bool(tag.name) and not tag.closing and tag.name not in VOID and not tag.attrs.rstrip().endswith("/")


def _ends(tags: list[Tag]) -> dict[int, tuple[int, bool]]:
    """For each element, by its start tag's place, the place of the tag that ends it, and whether that is its own end tag."""
    ends: dict[int, tuple[int, bool]] = {}
    opened: list[int] = []
    count: Counter = Counter()

    def close(names, until, at: int, own: bool) -> None:
        """End the innermost element of ``names`` that isn't beyond one of ``until``, and all within it."""
        if not any(count[n] for n in names):
            return
        for k in range(len(opened) - 1, max(-1, len(opened) - 1 - DEEPEST), -1):
            name = tags[opened[k]].name
            if name in names:
                for i in opened[k:]:
                    ends[i] = (at, own and i == opened[k])
                    count[tags[i].name] -= 1
                del opened[k:]
                return
            if until(name):
                return

    for at, tag in enumerate(tags):
        name = tag.name
        if tag.closing and name:
            inline = name not in BLOCK and name not in NEVER and name not in ("html", "body")
            close({name}, (lambda n: n in BLOCK or n in NEVER) if inline else SCOPES.get(name, TABLE_PARTS).__contains__, at, True)
        elif name:
            if opened and tags[opened[-1]].name == "head" and name not in IN_HEAD:
                close({"head"}, TABLE_PARTS.__contains__, at, False)
            if name in ENDS_P:
                close({"p"}, ENDS_P.__contains__, at, False)
            if name in SIBLINGS:
                close(SIBLINGS[name], SCOPES[name].__contains__, at, False)
            if _opens(tag):
                opened.append(at)
                count[name] += 1
    for i in opened:
        ends[i] = (len(tags), False)
    return ends


def _skips(tags: list[Tag]) -> dict[int, tuple[int, bool]]:
    """For each start tag whose element is never main text, the place of the tag to go on with, and whether its own end tag is before it.

    An element that was never closed ends where HTML implies it, and where main text surely begins: at an <article>, <main> or <h1>,
    and within an <article> or <main> at the next paragraph or heading too. One that holds a <main>, or the page's only
    <article>s, is read.
    """
    candidates = [i for i, t in enumerate(tags) if _opens(t) and _shunned(t.name, t.attrs)]
    if not candidates:
        return {}
    ends = _ends(tags)
    starts = {n: [i for i, t in enumerate(tags) if t.name in names and _opens(t)] for n, names in STARTS.items()}
    labelled, reach = set(), -1  # what stands in a labelled element
    for i in sorted({*candidates, *starts["label"]}):
        if i < reach:
            labelled.add(i)
        if tags[i].name in LABEL:
            reach = max(reach, ends[i][0])

    def first(kind: str, after: int, before: int) -> int:
        k = bisect_right(starts[kind], after)
        return min(before, starts[kind][k]) if k < len(starts[kind]) else before

    spans = {}
    for i in candidates:
        end, own = ends[i]
        if not own:
            end = first("begin" if i not in labelled or tags[i].name in LABEL else "text", i, end)
        elif tags[i].name not in ALWAYS and first("main", i, end) < end:
            continue
        spans[i] = (end + own, own)
    free, reach = False, -1  # whether a labelled element would be read
    for i in sorted({*spans, *starts["label"]}):
        if i >= reach:
            free = free or i not in spans
            reach = spans[i][0] if i in spans else reach
    if free:
        return spans
    return {i: (end, own) for i, (end, own) in spans.items() if tags[i].name in ALWAYS or (tags[i].name not in LABEL and first("label", i, end) >= end)}


def tokens(page: str) -> Iterator[Token]:
    """The tokens of a page in order. It may be cut off anywhere, and its tags may be wrongly nested."""
    tags = _tags(page)
    skips = _skips(tags)
    at, block, depth, i = 0, 0, 0, 0
    while at < len(page):
        end = tags[i].begin if i < len(tags) else len(page)
        if end > at:
            text = html.unescape(page[at:end])
            yield Token("word", len(text.split()), block, text, depth > 0)
        if i == len(tags):
            break
        if i in skips:
            apart = tags[i].name in APART
            block += apart
            yield Token("never", 0, block, "", depth > 0)
            block += apart
            i, own = skips[i]
            at = tags[i - 1].end if own else tags[i].begin if i < len(tags) else len(page)
            continue
        name, closing = tags[i].name, tags[i].closing
        at = tags[i].end
        i += 1
        if not name:
            continue
        if name in LABEL and closing:
            depth = max(0, depth - 1)
        block += name in BLOCK
        yield Token("border" if name in LABEL else name if name in KNOWN else "other", 0, block, " " if name == "br" else "", depth > 0)
        if name in LABEL and not closing:
            depth += 1


class Weights(NamedTuple):
    word: float
    tags: dict[str, float]

    def of(self, t: Token) -> float:
        return self.word * t.words if t.kind == "word" else self.tags.get(t.kind, DEFAULT_TAG)


def learned(inside: Counter, outside: Counter, regions: int, stretches: int) -> Weights:
    """Weights from counts of token kinds inside and outside of labelled main text.

    There were ``regions`` such texts, and ``stretches`` of words outside of them. A word scores one. A tag costs ``LEAST``, and besides
    twice a mean stretch of words outside times the share of such tags that stand outside: one such tag is between a stretch and the text,
    so it doesn't pay to take in a stretch of up to twice the mean. What is skipped costs ``LEAST``, as it stands everywhere. Without labelled pages the weights are fixed.
    """
    if not inside["word"]:
        return Weights(DEFAULT_WORD, {"never": -LEAST, "border": DEFAULT_BORDER})
    full = max(1.0, 2 * outside["word"] / max(1, stretches))
    tags = {k: -LEAST - full * (outside[k] + 0.5) / (inside[k] + outside[k] + 1) for k in inside | outside if k != "word"}
    return Weights(DEFAULT_WORD, tags | {"never": -LEAST, "border": -max(full, inside["word"] / max(1, regions) / 2)})


def best_run(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run with the highest sum; the first and longest such. Empty if nothing is positive."""
    best, span, total, begin = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total < 0:
            total, begin = 0.0, i
        total += x
        if total > 0 and total >= best and (total > best or begin == span[0]):
            best, span = total, (begin, i + 1)
    return span


def main_text(page: str | None, weights: Weights) -> str:
    """The blocks of the page's best run, each with its white space as single spaces, joined by line feeds."""
    if not page:
        return ""
    run = list(tokens(page))
    begin, end = best_run([weights.of(t) for t in run])
    if begin == end:
        return ""
    first, last = run[begin].block, run[end - 1].block
    blocks: dict[int, list[str]] = {}
    for t in run:
        if t.text and first <= t.block <= last:
            blocks.setdefault(t.block, []).append(t.text)
    texts = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(t for t in texts if t)


def _tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    regions = stretches = 0
    for f in frames:
        for page in f["html"]:
            run = list(tokens(page or ""))
            if any(t.inside for t in run):
                regions += 1
                for t in run:
                    counts[not t.inside][t.kind] += t.words if t.kind == "word" else 1
                    stretches += t.kind == "word" and t.words > 0 and not t.inside
    rows = [(kind, counts[0][kind], counts[1][kind]) for kind in counts[0] | counts[1]] + [("", regions, stretches)]
    yield pd.DataFrame(rows, columns=["kind", "inside", "outside"]).astype({"inside": "int64", "outside": "int64"})


def learn(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from about ``sample`` pages with an <article> or <main>, which label themselves, chosen by a hash of page_id.

    Only a tally of token kinds leaves a task.
    """
    labelled = pages.where(F.col("html").rlike(r"(?i)<(?:article|main)(?:[\s/>]|$)"))
    total = max(1, labelled.count())
    share = F.pmod(F.xxhash64(F.lit("html"), "page_id"), F.lit(1 << 52)) < int((1 << 52) * min(1.0, sample / total))
    tally = labelled.where(share).select("html").mapInPandas(_tally, "kind string, inside long, outside long")
    rows = tally.groupBy("kind").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()  # a row for each known tag at most
    inside, outside = Counter({r["kind"]: r["i"] for r in rows}), Counter({r["kind"]: r["o"] for r in rows})
    return learned(inside, outside, inside.pop("", 0), outside.pop("", 0))


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages without main text, have empty text. Repeated rows are read alike, and null ids and urls stay
    null. Without labelled pages, fixed weights are used. Other columns are not read.
    """
    ship(pages.sparkSession)
    weights = weights or learn(pages)

    @F.pandas_udf(StringType())
    def text(markup: pd.Series) -> pd.Series:
        return pd.Series([main_text(m, weights) for m in markup], dtype=object)

    return pages.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
