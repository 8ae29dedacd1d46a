"""Main text of web pages by text-to-tag ratio."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text.
SILENT = frozenset("script style noscript template iframe object embed svg math canvas audio video map title select option datalist textarea button".split())
#: Elements that stand around an article.
AROUND = frozenset("nav footer aside form menu dialog search".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag ends, if they are open.
_ENDS_P = BLOCK - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = frozenset("ul ol dl table article section main div nav aside header footer form body html".split())

#: Words of class, id, role and aria-label that tell of surroundings.
_AROUND_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies discussion disqus footer gdpr hidden masthead menu modal "
    "nav navbar navigation newsletter notice pager pagination popup promo promoted related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "toolbar widget complementary".split()
)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_SIGMA = 1.0


def _around_words(value: str | None) -> bool:
    return any(x in _AROUND_WORDS for x in _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value or "").lower()))


@dataclass
class Line:
    """A block of text, with what stands around it."""

    text: str
    tags: int
    link_chars: int
    #: the open element that says this is no article text, and the innermost article or main element, as serial numbers
    around: bool
    root: int
    #: serial numbers of the open wrappers whose words speak of surroundings, and whether an article without such words is open
    named: tuple[int, ...] = ()
    article: bool = False


_NOTHING = ("", False, 0, (), False)


class _Blocks(HTMLParser):
    """Turns parser events into lines.  Holds the open elements and the text of one block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self._open: list[tuple[str, bool, int, tuple[int, ...], bool]] = []
        #: how many elements of each name are open
        self._count: Counter[str] = Counter()
        #: of each wrapper whose words speak of surroundings: whether it stands in an article or main, and whether in an article
        self._named: list[tuple[bool, bool]] = []
        self._holds_main: set[int] = set()
        self._parts: list[str] = []
        self._tags = self._links = self._serial = 0
        self._silent: str | None = None
        self._depth = 0

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self._parts)).strip()
        if text:
            _, around, root, named, article = self._open[-1] if self._open else _NOTHING
            self.lines.append(Line(text, self._tags, self._links, around, root, named, article))
        self._parts.clear()
        self._tags = self._links = 0

    def _push(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        _, around, root, named, article = self._open[-1] if self._open else _NOTHING
        if tag in ("article", "main"):
            inner = not around and not (tag == "article" and (root or named) and self._is_comment(attrs))
            if inner and not root:
                self._serial += 1
                root = self._serial
            if inner and tag == "main":
                self._holds_main.update(named)
            article = article or (inner and tag == "article")
            around = around or not inner
        values = {k: v for k, v in attrs if k in ("class", "id", "role", "aria-label", "hidden", "aria-hidden", "style")}
        if tag in AROUND or (tag == "header" and not root):
            around = True
        elif values and tag not in ("html", "body", "main", "article"):
            if any(_around_words(values.get(k)) for k in ("class", "id", "role", "aria-label")):
                self._named.append((bool(root), article))
                named = (*named, len(self._named) - 1)
            unseen = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in (values.get("style") or "").replace(" ", "").lower()
            around = around or unseen
        self._open.append((tag, around, root, named, article))
        self._count[tag] += 1

    def _pop(self) -> str:
        tag = self._open.pop()[0]
        self._count[tag] -= 1
        return tag

    @staticmethod
    def _is_comment(attrs: list[tuple[str, str | None]]) -> bool:
        return any(_around_words(v) for k, v in attrs if k in ("class", "id", "role"))

    def _close(self, names: set[str], scope: frozenset[str]) -> None:
        """Close the innermost open element of ``names``, and what it holds, unless an element of ``scope`` is in between."""
        if not any(self._count[x] for x in names):
            return
        for i in range(len(self._open) - 1, -1, -1):
            tag = self._open[i][0]
            if tag in names:
                self._flush()
                while len(self._open) > i:
                    self._pop()
                return
            if tag in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self._silent:
            self._depth += tag == self._silent
            return
        if tag == "body" and self._open and self._open[-1][0] == "head":
            self._pop()
        if tag in SILENT:
            if tag not in VOID:
                self._silent, self._depth = tag, 1
            self._tags += 1
            return
        if tag in _ENDS_P:
            self._close({"p"}, _SCOPE)
        if tag in _SIBLINGS:
            self._close(_SIBLINGS[tag], _SCOPE)
        if tag in BLOCK:
            self._flush()
        self._tags += 1
        if tag == "br":
            self._parts.append(" ")
        if tag == "body" and self._count["body"]:
            return
        if tag not in VOID:
            self._push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            return
        if tag in VOID or not self._silent:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self._silent:
            if tag == self._silent:
                self._depth -= 1
                if not self._depth:
                    self._silent = None
            elif tag == "head":
                self._silent = None
            return
        self._tags += 1
        if tag in BLOCK:
            self._flush()
        if self._count[tag]:
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self._silent:
            return
        self._parts.append(data)
        if self._count["a"]:
            self._links += len(data.strip())

    def end(self) -> list[Line]:
        self.close()
        self._flush()
        self._judge_named()
        return self.lines

    def _judge_named(self) -> None:
        """Make the lines of named wrappers surroundings, but for wrappers that hold the page's content.

        Those hold a main element, or half or more of the text of all articles;
        on a page without either, half or more of its text, and more text than
        links.  Nothing that is named inside an article is its content.
        """
        seen = [x for x in self.lines if not x.around]
        plain = lambda lines: sum(max(0, len(x.text) - x.link_chars) for x in lines)
        all_text, all_articles, rooted = plain(seen), plain(x for x in seen if x.article), any(x.root for x in seen)
        text, articles, links = ([0] * len(self._named) for _ in range(3))
        for x in seen:
            for i in x.named:
                text[i] += plain([x])
                articles[i] += plain([x]) if x.article else 0
                links[i] += x.link_chars
        kept = set()
        for i, (in_root, in_article) in enumerate(self._named):
            by_article = articles[i] > 0 and 2 * articles[i] >= all_articles
            by_text = not rooted and 2 * text[i] >= all_text and text[i] > links[i]
            if not in_article and (i in self._holds_main or by_article or (by_text and not in_root)):
                kept.add(i)
        for x in self.lines:
            x.around = x.around or not kept.issuperset(x.named)


def _smooth(x: np.ndarray) -> np.ndarray:
    reach = int(np.ceil(3 * _SIGMA))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * _SIGMA**2))
    weight = np.convolve(np.ones(len(x)), kernel)[reach : reach + len(x)]
    return np.convolve(x, kernel)[reach : reach + len(x)] / weight


def _threshold(x: np.ndarray) -> float:
    """Bound between two clusters of the ratios, by 2-means on a logarithmic scale; the mean of the cluster centres."""
    v = np.log1p(x)
    low, high = float(v.min()), float(v.max())
    if high - low < 1e-9:
        return -1.0
    for _ in range(30):
        cut = (low + high) / 2
        a, b = v[v <= cut], v[v > cut]
        now = (float(a.mean()) if len(a) else low, float(b.mean()) if len(b) else high)
        if now == (low, high):
            break
        low, high = now
    # ratios all of one kind don't make two clusters
    return float(np.expm1((low + high) / 2)) if high - low > 0.7 else -1.0


def content_lines(lines: list[Line]) -> list[Line]:
    """The lines of the content regions, in page order.

    A line's ratio is its characters outside links for each tag; the ratios are
    smoothed with a Gaussian over neighbouring lines, and two clusters of them
    give the threshold.  The regions above it vote, by their characters, for the
    article or main element that they lie in; the winner's lines are the
    content.  Where no region lies in such an element, the content is the lines
    from the first to the last of the regions whose own ratio is above the
    threshold, short ones in between included.  Lines of surroundings never count.
    """
    own = [x for x in lines if not x.around]
    if not own:
        return []
    ratio = np.array([max(0, len(x.text) - x.link_chars) / max(1, x.tags) for x in own])
    smooth = _smooth(ratio)
    cut = _threshold(smooth)
    inside = smooth > cut
    votes: dict[int, int] = {}
    for line, good in zip(own, inside, strict=True):
        if good:
            votes[line.root] = votes.get(line.root, 0) + len(line.text)
    rooted = {k: v for k, v in votes.items() if k} or {x.root: 1 for x in own if x.root}
    if rooted:
        least = 0.25 * max(rooted.values())
        good_roots = {k for k, v in rooted.items() if v >= least}
        return [x for x in own if x.root in good_roots]
    good = np.flatnonzero(inside & (ratio > cut))
    if not len(good):
        good = np.flatnonzero(inside | (ratio > cut))
    return own[good[0] : good[-1] + 1] if len(good) else []


def main_text(html: str | None) -> str:
    """Main text of one page: its blocks, joined by two newlines."""
    if not html:
        return ""
    parser = _Blocks()
    parser.feed(html)
    return "\n\n".join(x.text for x in content_lines(parser.end()))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page, from its whole html.

    Returns ``page_id``, ``url``, ``text`` (empty where a page has none, or its
    html is null) and ``n_chars`` (code points of the text), one row for each
    input row.  Character references are decoded, white space within a block
    becomes one space, and blocks are joined in page order by two newlines.
    Broken markup is read as far as it goes.  Ids and urls may be null or
    repeat; an empty table gives an empty result; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
