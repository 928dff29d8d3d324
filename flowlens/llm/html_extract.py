"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, functions as F

#: Elements whose whole content is not text of the page's article.
SKIP = frozenset("head title script style noscript template iframe object svg canvas math form button select textarea nav footer aside dialog menu".split())
#: Those of them that hold no article either.
NEVER = frozenset("head title script style noscript template iframe object svg canvas math button select textarea".split())
#: Elements that end one block of text and begin another.
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header hr address center details summary fieldset hgroup".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of these is ended by the start of its like.
SIBLING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Starts of these end an open paragraph.
NO_P = BLOCK - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "li", "dt", "dd"}
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Whole classes and ids that mark what surrounds an article.
BOILER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
    popup modal overlay newsletter subscribe subscription signup login sidebar sidenav rail nav navbar navigation menu breadcrumb breadcrumbs
    footer comment comments commentlist respond replies disqus share sharing social related recommended widget toolbar pagination pager""".split()
)
SPACES = re.compile(r"\s+")
UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
#: How many characters of content elsewhere one in an ``article`` or ``main`` outweighs.
PRIOR = 2
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())


class _Blocks(HTMLParser):
    """Streams parser events into blocks: [text pieces, tags, characters in links, region, element, boilerplate around it].

    What an article or main lies in, or is, is no boilerplate. So only what can't hold one is skipped at once; the other
    blocks name the boilerplate around them, and :meth:`content` drops them at the page's end.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int]] = []  # element, region before it, its boilerplate: -1 none, 0 skipped at once
        self.parent, self.named = [0], [False]  # of each region: the one around it; whether it is an article or main
        self.region, self.skip, self.links = 0, 0, 0
        self.around: tuple[int, ...] = ()  # boilerplate that is open here
        self.number, self.cleared = 0, set()  # last number given to boilerplate; numbers of what holds an article or main
        self.blocks: list[list] = []
        self.now, self.fresh, self.breaks = None, True, 0  # the last block, whether text begins another, block tags so far
        self.paused: list[tuple] = []  # these at the start of each boilerplate that is open

    def handle_starttag(self, tag, attrs):
        if tag in SIBLING or tag in NO_P:
            self._end_sibling(tag)
        a = {k: v or "" for k, v in attrs}
        role = a.get("role", "").lower()
        words = {*a.get("class", "").lower().split(), a.get("id", "").strip().lower()}
        inside = any(self.named[r] for r in self._around(self.region))
        named = tag in ("article", "main") or role == "main" or a.get("itemprop") == "articleBody"
        nested = any(t == "article" for t, _, _ in self.open)
        boiler = -1
        if tag in NEVER or "hidden" in a:
            boiler = 0
        elif named and not nested:
            self.cleared.update(self.around)
        elif tag in SKIP or role in BOILER_ROLES or (tag not in ("html", "body") and not BOILER_WORDS.isdisjoint(words)) or ((tag == "header" or "header" in words) and not inside):
            self.number += 1
            boiler = self.number
        if tag in BLOCK:
            self.fresh = True
            self.breaks += 1
        elif not self.fresh:
            self.now[1] += 1
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        self.open.append((tag, self.region, boiler))
        self.skip += boiler == 0
        if boiler > 0:
            self.around += (boiler,)
            self.paused.append((self.now, self.fresh, self.breaks))
            self.fresh = True
        self.links += tag == "a"
        if named or tag in ("section", "div", "td", "body"):
            self.parent.append(self.region)
            self.named.append(named)
            self.region = len(self.parent) - 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.fresh = True
            self.breaks += 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._close(k)
                return

    def handle_data(self, data):
        if self.skip:
            return
        if self.fresh:
            if data.isspace():
                return
            element = next((t for t, _, _ in reversed(self.open) if t in BLOCK), "")
            self.now, self.fresh = [[], 1, 0, self.region, element, self.around], False
            self.blocks.append(self.now)
        self.now[0].append(data)
        if self.links:
            self.now[2] += len(data)

    def close(self):
        if UNFINISHED.match(self.rawdata):
            self.rawdata = ""  # a tag or comment that the page's end cuts off is no text
        super().close()

    def content(self):
        """The blocks that aren't in boilerplate, without what told so."""
        return [b[:5] for b in self.blocks if self.cleared.issuperset(b[5])]

    def _around(self, region):
        while region:
            yield region
            region = self.parent[region]

    def _end_sibling(self, tag):
        ends = SIBLING.get(tag, set()) | ({"p"} if tag in NO_P else set())
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in ends:
                self._close(k)
                return
            if self.open[k][0] in ("ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "aside", "nav", "form", "footer", "header"):
                return

    def _close(self, k):
        for tag, region, boiler in reversed(self.open[k:]):
            self.region = region
            self.skip -= boiler == 0
            if boiler > 0:
                self.around = self.around[:-1]
                now, fresh, breaks = self.paused.pop()
                # The text around boilerplate without block elements, such as a span, is one block.
                self.now, self.fresh = (now, fresh) if breaks == self.breaks else (self.now, True)
            self.links -= tag == "a"
        del self.open[k:]


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is cut and scaled."""
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        w = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(a * b for a, b in zip(w, values[lo:hi], strict=True)) / sum(w))
    return out


def extract(html: str, sigma: float = 1.0) -> str:
    """The article's blocks, one a line. See :func:`extract_pages`."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    rows = []
    for pieces, tags, linked, region, element in parser.content():
        if text := SPACES.sub(" ", "".join(pieces)).strip():
            rows.append((text, len(text) / tags * (1 - min(1.0, linked / len(text))), linked > 0.5 * len(text), region, element))
    if not rows:
        return ""
    level = smooth([r[1] for r in rows], sigma)
    mean = sum(level) / len(level)
    least = min(mean, math.sqrt(sum((x - mean) ** 2 for x in level) / len(level)))
    chosen = [x >= least and not r[2] for x, r in zip(level, rows, strict=True)]
    parent, named = parser.parent, parser.named
    top: dict[int, int] = {}  # the outermost article or main around each region, 0 if none
    for r in range(len(parent)):
        around = r and top[parent[r]]
        top[r] = around or (r if named[r] else 0)
    # An article or main counts with all its text outside links, and PRIOR times; the rest with what the clusters chose.
    inside = sum(len(r[0]) for r in rows if top[r[3]] and not r[2])
    outside = sum(len(r[0]) for r, c in zip(rows, chosen, strict=True) if c and not top[r[3]])
    if any(top[r[3]] for r in rows) and PRIOR * inside >= outside:
        kept = {top[r[3]] for r, c in zip(rows, chosen, strict=True) if c and top[r[3]]}  # those with content; all, if none has
        return "\n".join(r[0] for r in rows if top[r[3]] and (top[r[3]] in kept or not kept))
    # No element names the article, or it's elsewhere: go down into the region that holds almost all of the chosen text.
    mass = [0] * len(parent)
    for r, c in zip(rows, chosen, strict=True):
        if c:
            k = r[3]
            while True:
                mass[k] += len(r[0])
                if not k:
                    break
                k = parent[k]
    at = 0
    while inner := [k for k in range(1, len(parent)) if parent[k] == at and mass[k] >= 0.7 * mass[at] > 0]:
        at = inner[0]
    within = [False] * len(parent)
    for k in range(len(parent)):
        within[k] = k == at or (k > 0 and within[parent[k]])
    marked = [i for i, c in enumerate(chosen) if c and within[rows[i][3]]]
    if not marked:
        return ""
    first, last = marked[0], marked[-1]
    return "\n".join(r[0] for i, r in enumerate(rows) if within[r[3]] and (chosen[i] or not r[2] and r[4] in CONTENT and first - 2 <= i <= last + 2))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of each page, one output row for each input row.

    A standard-library parser streams start, end and text events. They build blocks ("lines"): runs of text between
    block elements, outside of scripts, styles, menus, footers, sidebars, forms and whatever its class, id or role
    names as advert, notice or reader comments, unless an ``article`` or ``main`` is what is named so or lies within;
    a name is a whole class or id, and other names are left to the clusters. Inside an ``article`` another one can be
    reader comments. Each block has a text-to-tag ratio (its characters outside links by
    its tags), the ratios are smoothed by a Gaussian, and blocks at or above a threshold out of their mean and
    deviation are content. Content tells the region: text in ``article`` and ``main`` elements weighs ``PRIOR`` times,
    and if it outweighs the content elsewhere, those of them that hold content are taken whole. Otherwise, as on pages
    with no such element or with teasers alone in them, the region that holds most of the content is taken, with short
    paragraphs between its content blocks.

    White space inside a block becomes one space, blocks are joined by one line feed in page order. Null or empty
    html gives an empty text. Repeated rows give repeated results, null ids and urls pass through, an empty table
    gives an empty result, and other columns are not read. Each page is parsed on its own: no shuffle.
    """
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                out = [extract(h, sigma) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = src.schema["page_id"].dataType.simpleString()
    return src.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
