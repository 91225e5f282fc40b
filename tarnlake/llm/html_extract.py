"""Main text of web pages: text-to-tag ratio per line, Gaussian smoothing and threshold clustering.

The standard library's streaming parser turns a page into lines: the text between two block boundaries,
with the number of tags inside it, its characters inside links and the container that holds it. A line's ratio is its
characters outside links by its tags. Ratios are smoothed by a Gaussian over neighbouring lines, and lines at or above the
threshold (a share of the deviation of the smoothed ratios) cluster into regions. The regions choose the containers:
the deepest one that holds nine tenths of their characters, or, where the page names its content (article, main),
every named one that holds part of a region. All lines of a chosen container are its text, short ones included, save two kinds. One is
what the regions pass over and links fill: a container of three lines or more, most of them outside the regions, or a line of three links or
more outside them or in a dip of the ratios, in which nothing is said outside links (a list of other stories, a row of share buttons). The other is lines in containers that are never content (menus, headers, footers, sidebars, notices, adverts, forms, reader comments): by element or role,
or by class words. Class words, and a form, are evidence only: such a container stays if it holds most of the regions'
characters (``HOLDS``; nearly all of them where a class begins with the word, as in "sidebar" but not in "has-sidebar"),
and they never speak against a heading or a paragraph. A page costs time in proportion to its length, however deep it nests.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm import text as T

# HTML's element kinds.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template iframe object svg math canvas audio video title select textarea button datalist".split())
NEVER = frozenset("nav header footer aside menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar note".split())
#: Elements whose start closes an open paragraph.
CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr option optgroup legend".split())
#: Elements whose start closes an open one of these kinds, up to the element that holds them.
OWN_KIND = {
    "li": (("li",), frozenset(("ul", "ol", "menu", "dir"))),
    **dict.fromkeys(("dd", "dt"), (("dd", "dt"), frozenset(("dl",)))),
    **dict.fromkeys(("td", "th"), (("td", "th"), frozenset(("tr", "table")))),
    "tr": (("tr",), frozenset(("table", "tbody", "thead", "tfoot"))),
    "option": (("option",), frozenset(("select", "datalist", "optgroup"))),
}
_PAGE = ("article", "main", "body", "html")
_P_WALLS = frozenset("article main section div td th li body blockquote aside nav header footer form button object".split())
#: Class words say nothing about these.
_UNNAMED = frozenset("body html article main p h1 h2 h3 h4 h5 h6".split())
_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|promoted|nav\w*|menu\w*|header|footer|sidebar|side-bar|aside|widget|breadcrumbs?|cookies?|consent|gdpr|notice|notices|notification|popup|modal|newsletter|subscribe|signup|login|comments?|commentlist|disqus|replies|respond|reader-comments|related|share|sharing|social|toolbar|pagination|pager|skip|copyright|legal|masthead|topbar|bottombar)(?=$|[\s_-])",
    re.I,
)
#: The head of a piece of content, which carries its title.
_OWN_HEAD = re.compile(r"(?:^|(?<=[\s_-]))(?:entry|post|article|story|content)[_-]header(?=$|[\s_-])", re.I)
_HEAD = re.compile(r"(?:^|(?<=[\s_-]))header(?=$|[\s_-])", re.I)
_GAP = re.compile(r"\s+")
RADIUS, SIGMA, SHARE = 2, 1.0, 0.5
#: A line is in a dip where its smoothed ratio is below this share of both neighbours'.
DIP = 0.95
#: The share of the content from which a container stays in spite of class words: inside a name, at its beginning.
HOLDS = (0.5, 0.9)


class _Lines(HTMLParser):
    """Feeds: each block boundary ends a line. ``lines`` has (text, tags, number of the container, letters outside links, links).

    Containers are numbered as they open, 0 is the page; ``parent`` gives the one around each, ``never`` those
    that are never content and ``named`` those that only the content's weight can save.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.stack: list[tuple[str, int]] = []
        self.parent, self.main, self.never = [0], [], set()
        # Containers that class words, or a form, speak against: the share of the content from which they stay.
        self.named: dict[int, float] = {}
        self.held: list[str] = []
        self.open: Counter = Counter()
        self.tags = self.silent = self.own = self.links = 0
        self.linked = False

    def flush(self) -> None:
        if self.held:
            text = _GAP.sub(" ", "".join(self.held)).strip()
            if text:
                self.lines.append((text, self.tags, self.stack[-1][1] if self.stack else 0, self.own, self.links))
            self.held = []
        self.tags = self.own = 0
        self.links = int(self.linked)

    def pop(self) -> None:
        tag, _ = self.stack.pop()
        self.open[tag] -= 1
        self.silent -= tag in SILENT

    def named_by(self, value: str) -> float | None:
        """The share from which a container of this class or id stays; None where it has no never-content word."""
        value = (_HEAD if self.open["article"] or self.open["main"] else _OWN_HEAD).sub("", value)
        found = [m[0] for m in _WORDS.finditer(value)]
        return HOLDS[any(x[0] not in "_-" for x in found)] if found else None

    def handle_starttag(self, tag, attrs):
        # The end of the head may be left out; the body or a block ends it.
        if tag in BLOCKS and tag != "html" and self.silent == 1 and self.open["head"]:
            self.close_to("head", ())
        if tag in BLOCKS:
            self.flush()
        if tag in CLOSES_P:
            self.close_to("p", _P_WALLS)
        if tag in OWN_KIND:
            # An item ends the one before it, within the list or table that holds both.
            kinds, walls = OWN_KIND[tag]
            for kind in kinds:
                self.close_to(kind, walls)
        if tag == "br":
            self.held.append(" ")
        self.tags += 1
        if tag == "a" and not self.silent:
            self.linked = any(k == "href" for k, _ in attrs)
            self.links += self.linked
        if tag in VOID or not (tag in BLOCKS or tag in SILENT):
            return
        number = len(self.parent)
        self.parent.append(self.stack[-1][1] if self.stack else 0)
        shares = [0.5] if tag == "form" else []
        # A header inside the article carries its title.
        never = tag in NEVER and not (tag == "header" and (self.open["article"] or self.open["main"]))
        for k, v in attrs:
            if v and k == "role" and v.strip().lower() in ROLES or k == "hidden" or k == "aria-hidden" and v == "true":
                never = True
            elif v and k in ("class", "id") and tag not in _UNNAMED and (by := self.named_by(v)) is not None:
                shares.append(by)
        if never:
            self.never.add(number)
        elif shares and tag != "header":
            self.named[number] = max(shares)
        self.stack.append((tag, number))
        self.open[tag] += 1
        self.silent += tag in SILENT
        if tag in ("article", "main") and not self.silent:
            self.main.append(number)

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self.held.append(" ")
        elif tag in BLOCKS and tag in VOID:
            self.flush()
        elif tag not in VOID:
            self.handle_starttag(tag, attrs)

    def close_to(self, tag, walls) -> None:
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k][0] in walls:
                return

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag == "a":
            self.linked = False
        if tag in BLOCKS or tag in SILENT:
            self.close_to(tag, _PAGE if tag not in _PAGE else ())

    def handle_data(self, data):
        if not self.silent:
            self.held.append(data)
            if not self.linked:
                # Bars, dots and the like between links say nothing.
                self.own += len(data) if data.isalnum() else sum(map(str.isalnum, data))


def ratios(lines: list[tuple[str, int, int, int, int]]) -> np.ndarray:
    """Smoothed text-to-tag ratio of each line; a line of links alone has none."""
    raw = np.array([(len(t) if own else 0) / max(1, n) for t, n, _, own, _ in lines], float)
    kernel = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA**2))
    return np.convolve(np.pad(raw, RADIUS, mode="edge"), kernel / kernel.sum(), "valid")


def regions(smooth: np.ndarray) -> np.ndarray:
    """The region of each line, -1 outside: runs of lines at or above the threshold, together where no more than RADIUS lines part them."""
    above = np.flatnonzero(smooth >= min(SHARE * smooth.std() + smooth.min(), smooth.max()))
    out = np.full(len(smooth), -1)
    out[above] = np.cumsum(np.concatenate([[False], np.diff(above) > RADIUS + 1]))
    return out


def _weights(parent: list[int], of: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Characters in each container, those of the containers inside it included."""
    out = np.bincount(of, weights=size, minlength=len(parent)).tolist()
    for n in range(len(parent) - 1, 0, -1):
        out[parent[n]] += out[n]
    return np.array(out)


def _below(parent: list[int], roots) -> np.ndarray:
    """The containers that are one of ``roots`` or inside one."""
    out = [n in roots for n in range(len(parent))]
    for n in range(1, len(parent)):
        out[n] = out[n] or out[parent[n]]
    return np.array(out)


def _link_blocks(lines, parent: list[int], of: np.ndarray, content: np.ndarray, smooth: np.ndarray) -> np.ndarray:
    """The lines that the regions pass over and links fill: rows of three links, and containers of three such lines.

    Smoothing lifts a line between long ones into their region: a row that lies in a dip of the smoothed ratios is passed over, too,
    and so is a container of which most lines are outside.
    """
    links = np.array([n for *_, n in lines])
    said = np.array([own > 0 or n == 0 for *_, own, n in lines])
    beside = np.minimum(np.concatenate([[np.inf], smooth[:-1]]), np.concatenate([smooth[1:], [np.inf]]))
    passed = ~content | (smooth < DIP * beside)
    row = ~said & passed & (links >= 3)
    count, out = _weights(parent, of, np.ones(len(of))), _weights(parent, of, passed.astype(float))
    words = _weights(parent, of, said.astype(float))
    whole = {n for n in range(1, len(parent)) if count[n] >= 3 and not words[n] and 2 * out[n] > count[n]}
    return row | _below(parent, whole)[of] if whole else row


def main_text(html: str | None) -> tuple[str, int, int]:
    """(text, lines taken, lines of the page)."""
    p = _Lines()
    p.feed(html or "")
    p.close()
    p.flush()
    if not p.lines:
        return "", 0, 0
    of, size = np.array([x[2] for x in p.lines]), np.array([len(x[0]) for x in p.lines], float)
    smooth = ratios(p.lines)
    content = regions(smooth) >= 0
    usable = ~_below(p.parent, p.never)[of]
    for chosen in (content & usable, usable):
        if not chosen.any():
            continue
        weight = _weights(p.parent, of, size * chosen)
        out = {n for n, share in p.named.items() if weight[n] < share * weight[0] or not weight[n]}
        left = usable & ~_below(p.parent, out)[of]
        if left.any():
            break
    else:
        return "", 0, len(p.lines)
    chosen = content & left if (content & left).any() else left
    weight = _weights(p.parent, of, size * chosen)
    named = {n for n in p.main if weight[n]}
    if named:
        # The page names its content: every article of it.
        taken = left & _below(p.parent, named)[of]
    else:
        # The deepest container with nine tenths of the regions' characters, of two lines at least.
        lines = _weights(p.parent, of, np.ones(len(of)))
        deep = np.flatnonzero((weight >= 0.9 * weight[0]) & (lines > 1))
        taken = left & _below(p.parent, {int(deep[-1])} if len(deep) else {0})[of]
    linked = _link_blocks(p.lines, p.parent, of, content, smooth)
    # A page of links alone keeps them.
    taken = taken & ~linked if (taken & ~linked).any() else taken
    return "\n\n".join(p.lines[k][0] for k in np.flatnonzero(taken)), int(taken.sum()), len(p.lines)


def _extract(batches):
    for b in batches:
        done = [main_text(h.as_py()) for h in b["html"]]
        text, taken, lines = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([b["id"], b["url"], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array(taken, pa.int64()), pa.array(lines, pa.int64())], ["page_id", "url", "text", "n_chars", "n_lines", "page_lines"])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_lines, page_lines.

    Character references are decoded, white space inside a block becomes one space, and blocks join by an
    empty line in page order. Null and empty pages, and pages without content, have an empty text. Pages cut short and
    unclosed elements are read as they stand. Repeated rows repeat; an empty table gives no rows.
    """
    pages = T.pick(df, id=id_col, url=url_col, html=html_col).withColumn("id", F.col("id").cast("long"))
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long, n_lines long, page_lines long")


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
