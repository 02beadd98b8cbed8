"""Main text of web pages by tree scoring (operator 9).

A page's tree is built with the usual implied end tags. Blocks of text pass points to
their ancestors: one, one for each comma and up to three for length, all times one minus
the block's link density; the parent gets all, its parent half, further ones a third,
a fourth and so on up to five levels. Boilerplate elements (menus, headers and footers
of the page, sidebars, notices, adverts, forms, scripts, styles, reader comments) are
set aside first by tag and role. A class or id only weighs: a name all of whose parts are
words of boilerplate sets its element aside unless it holds half of the page's text or
more and no article with text stands elsewhere; a name with such a word among others halves the points of what is inside, and its
element is set aside if it holds mostly links or no text to score. The best container is
taken; if it lies in an ``article`` or ``main`` element, that whole element; else also
those of its siblings whose points reach a fifth of its own, and sibling headings and
prose paragraphs. Inside, everything that is not boilerplate is kept in page order.

Defined cases: null or empty html gives an empty text; a page without any scored block
gives the non-boilerplate text of its whole body; markup cut off at the end of the page
is ignored; ``<br>`` counts as white space; of equal points the outermost and first
container wins; repeated rows each get their text; an empty table gives an empty result;
columns named text or n_chars give way to the results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math select button xmp object".split())
BLOCK = frozenset(
    "html body p div article section main header footer nav aside h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address hr form fieldset details summary center dialog menu".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p pre blockquote li td dd h1 h2 h3 h4 h5 h6 figcaption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
#: Elements that are boilerplate wherever they stand, and those that are so outside an article.
ALWAYS = frozenset("nav aside form dialog menu footer".split())
OUTSIDE = frozenset(["header"])
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Words of a class or id that speak for boilerplate.
NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert
    popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead comment comments commentlist disqus reply replies respond
    share sharing social related recommended newsletter subscribe signup login pager pagination toolbar widget skip legal copyright""".split()
)
#: Words that say nothing beside those, and words that turn a name round: an element without a sidebar, or one that has one.
BESIDE = frozenset("site page top bottom left right box wrap wrapper container list area section block item items inner outer bar link links main left col column header body text title logo button buttons tools unit slot primary secondary js id widget".split())
TURNED = frozenset("no has with without hide hidden disable disabled non".split())
KEEP = frozenset("html body article main".split())
#: How an element is marked: not at all, by a word of a name, by a whole name, by tag, role or attribute.
CLEAR, WORD, NAME, OFF = range(4)
#: What a marked element's text is worth, and the length from which a block is scored.
LESS, SCORED = 0.5, 25

MARKUP = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
ATTRIBUTES = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
#: One attribute after the other, each with its value, so that no name is found inside a value.
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?|"[^"]*"|'[^']*'""")
HEAD_END = re.compile(r"</head\s*>|<body\b", re.I)
WORDS = re.compile(r"[a-z]+")


def _marked(tag: str, attrs: str, in_article: bool) -> int:
    if tag in ALWAYS or (tag in OUTSIDE and not in_article):
        return OFF
    if tag in KEEP or not attrs:
        return CLEAR
    mark = CLEAR
    for m in ATTRIBUTE.finditer(attrs):
        name, value = (m[1] or "").lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return OFF
        if name in ("class", "id"):
            for whole in value.split():
                words = WORDS.findall(whole)
                if NAMES.isdisjoint(words) or not TURNED.isdisjoint(words):
                    continue
                mark = max(mark, NAME if all(w in NAMES or w in BESIDE for w in words) else WORD)
    return mark


class Page:
    """The tree of one page: for each element its parent, tag, mark, whether it is boilerplate and the nearest block; and its blocks of text. A tag takes a constant time at any depth."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.mark, self.off, self.article, self.block = [-1], ["#root"], [CLEAR], [False], [False], [0]
        #: (element that holds the block, text, characters within links)
        self.blocks: list[tuple[int, str, int]] = []
        self._run: list[str] = []
        self._links = 0
        self._stack = [0]
        #: Places in the stack of the open elements of each tag.
        self._open_at: dict[str, list[int]] = {}
        self._build(html)
        self._settle()

    def _last(self, tags: Iterable[str]) -> int:
        """The highest place of an open element of these tags; 0 if none is open."""
        return max((at[-1] for t in tags if (at := self._open_at.get(t))), default=0)

    def _flush(self) -> None:
        if self._run:
            text = " ".join(unescape("".join(self._run)).split())
            if text:
                self.blocks.append((self.block[self._stack[-1]], text, min(self._links, len(text))))
            self._run, self._links = [], 0

    def _text(self, s: str) -> None:
        if s and not self.off[self._stack[-1]]:
            self._run.append(s)
            if self._open_at.get("a"):
                self._links += len(s.strip())

    def _pop(self, at: int) -> None:
        if any(self.tag[i] in BLOCK for i in self._stack[at:]):
            self._flush()
        for i in self._stack[at:]:
            self._open_at[self.tag[i]].pop()
        del self._stack[at:]

    def _open(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            if tag not in ("html", "body") and (at := self._last("p")):
                self._pop(at)
            ends = self._last(CLOSES.get(tag, ()))
            if ends and ends > self._last(SCOPE.get(tag, ())):
                self._pop(ends)
            self._flush()
        elif tag == "br":
            self._run.append(" ")
        elif tag == "a" and (at := self._last("a")):
            self._pop(at)  # links do not nest
        if tag in VOID:
            return
        up, k = self._stack[-1], len(self.tag)
        inside = self.article[up] or tag in ("article", "main")
        self.parent.append(up)
        self.tag.append(tag)
        # an inline element's text cannot be told from its block's afterwards, so a whole name decides there at once
        mark = _marked(tag, attrs, inside)
        self.mark.append(mark)
        self.off.append(self.off[up] or mark == OFF or (mark == NAME and tag not in BLOCK))
        self.article.append(inside)
        self.block.append(k if tag in BLOCK else self.block[up])
        self._open_at.setdefault(tag, []).append(len(self._stack))
        self._stack.append(k)

    def _close(self, tag: str) -> None:
        at = self._last((tag,))
        if at and (tag in BLOCK or at > self._last(("article", "main", "body"))):
            self._pop(at)

    def _build(self, html: str) -> None:
        at, n = 0, len(html)
        endless: set[str] = set()
        while at < n:
            m = MARKUP.search(html, at)
            if not m:
                rest = html[at:]
                self._text(rest[:-1] if rest.endswith("<") else rest)
                break
            self._text(html[at : m.start()])
            if m[1]:
                end = html.find("-->", m.end())
                at = n if end < 0 else end + 3
                continue
            if m[2]:
                end = html.find(">", m.end())
                at = n if end < 0 else end + 1
                continue
            a = ATTRIBUTES.match(html, m.end())
            if not a:
                end = html.find(">", m.end())
                if end < 0:
                    break
                stop = end + 1
            else:
                stop = a.end()
            tag, attrs = m[4].lower(), html[m.end() : stop - 1]
            at = stop
            if m[3]:
                self._close(tag)
            elif tag == "head":
                end = HEAD_END.search(html, at)
                at = at if not end else end.start() if html[end.start() + 1] != "/" else end.end()
            elif tag in RAW:
                # no second search for an end that the page does not have
                end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(html, at)
                if not end:
                    endless.add(tag)
                if tag not in ("svg", "math", "object", "template") or end:
                    at = n if not end else end.end()
            else:
                self._open(tag, attrs)
                if attrs.endswith("/") and tag not in BLOCK and tag not in VOID:
                    self._close(tag)
        self._flush()


    def _settle(self) -> None:
        """Decide about the elements that names have marked, by the text below them, and leave out the blocks of what is set aside."""
        n = len(self.tag)
        size, linked, scored, framed = [0] * n, [0] * n, [False] * n, [False] * n
        for owner, text, links in self.blocks:
            size[owner] += len(text)
            linked[owner] += links
            scored[owner] = scored[owner] or (len(text) >= SCORED and self.tag[owner] not in HEADING and 2 * links < len(text))
        for i in range(n - 1, 0, -1):  # children come after their parents
            up = self.parent[i]
            size[up] += size[i]
            linked[up] += linked[i]
            scored[up] = scored[up] or scored[i]
            framed[i] = framed[i] or (self.tag[i] in ("article", "main") and size[i] > 0)
            framed[up] = framed[up] or framed[i]
        #: whether an element or one around it is marked but kept
        self.less = [False] * n
        for i in range(1, n):
            up = self.parent[i]
            if self.off[up]:
                self.off[i] = True
            elif self.mark[i] == NAME and not self.off[i]:
                self.off[i] = 2 * size[i] < size[0] or (framed[0] and not framed[i] and not self.article[i])
            elif self.mark[i] == WORD and not self.off[i]:
                self.off[i] = 2 * linked[i] >= size[i] or not scored[i]
            self.less[i] = self.less[up] or self.mark[i] in (WORD, NAME)
        self.blocks = [b for b in self.blocks if not self.off[b[0]]]


def points(page: Page) -> list[float]:
    """The points of each element."""
    out = [0.0] * len(page.tag)
    for owner, text, links in page.blocks:
        if len(text) < SCORED or page.tag[owner] in HEADING:
            continue
        worth = (1 + text.count(",") + min(3.0, len(text) / 100)) * (1 - links / len(text)) * (LESS if page.less[owner] else 1)
        up, level = (page.parent[owner] if page.tag[owner] in PROSE else owner), 1
        while up > 0 and level <= 5:
            out[up] += worth / level
            up, level = page.parent[up], level + 1
    return out


def extract(html: str) -> str:
    """The main text of one page, its blocks joined by line feeds."""
    if not html:
        return ""
    page = Page(html)
    if not page.blocks:
        return ""
    got = points(page)
    best = max(range(len(got)), key=lambda i: (got[i], -i))
    if got[best] <= 0:
        best = max((i for i, t in enumerate(page.tag) if t in ("article", "main")), default=0, key=lambda i: (page.tag[i] == "article", -i))
        return _within(page, {best})
    up, whole = best, 0
    while up > 0:
        if page.tag[up] in ("article", "main"):
            whole = up
            break
        up = page.parent[up]
    if whole:
        kept = {whole}
    else:
        kept = {best}
        links: dict[int, list[int]] = {}
        for o, t, k in page.blocks:
            x = links.setdefault(o, [0, 0])
            x[0] += len(t)
            x[1] += k
        for i in range(1, len(page.tag)):
            if page.parent[i] == page.parent[best] and i != best and page.parent[best] > 0:
                size, linked = links.get(i, (0, 0))
                if got[i] >= 0.2 * got[best] or (page.tag[i] in PROSE and size and linked < 0.25 * size and (page.tag[i] in HEADING or size >= SCORED)):
                    kept.add(i)
    return _within(page, kept)


def _within(page: Page, kept: set[int]) -> str:
    """The blocks inside the kept elements, in page order."""
    inside = [False] * len(page.tag)
    for i, up in enumerate(page.parent):
        inside[i] = i in kept or (up >= 0 and inside[up])
    return "\n".join(t for o, t, _ in page.blocks if inside[o])


def main_text(df: DataFrame, html: str = "html") -> DataFrame:
    """df without html, with text and n_chars (its code points)."""
    own = [f for f in df.schema.fields if f.name not in (html, "text", "n_chars")]
    names = [f.name for f in own]
    out = T.StructType([*own, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x or "") for x in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return df.select(*names, html).mapInArrow(run, out)
