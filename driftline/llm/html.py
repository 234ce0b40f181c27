"""Main-text extraction by tag-path ratios.

A page is read once by a tolerant scanner into text blocks. Each block has the
path of block elements from the root to it. Text length without links and
punctuation are summed up for each path and divided by the path's number of
nodes; the nodes' values in page order are smoothed, both are fused, and nodes
above a threshold (a share of the page's standard deviation) are content, unless
they are mostly links. All visible blocks take part, those of menus and footers
too. What an element's name, role, class or id says is a prior: blocks in
navigation, footers, asides, forms, page headers and elements whose class or id
reads like boilerplate (advert, comments, widget ...) count LOW times their score.
A class or id is not believed where the element holds a block, not mostly links, of
the page's best path and that path half of the text or more, nor is a form that holds most of the page's text, nor the
class of an ``article`` or ``main``. Only what is not shown is left out at once:
scripts, styles, the head and hidden elements; running text is never cut by the name
of an inline element.
The chosen nodes
then vote for their container: the ``article`` or ``main`` elements whose mean
score by text is above the threshold (of nested ones the innermost that holds most of
the chosen text), else the deepest element with most of it, widened to its parent as
long as all that this adds is content as well: text, lists and tables beside it, and
other elements with mostly chosen text. All blocks of the container stay, unless they
are mostly links or have the low prior.

Text: character references decoded, white space inside a block made one space,
trimmed, blocks joined in page order by one space.

Defined cases: null or empty html, and a page without content, give ''; markup
that is cut off or wrongly nested is read as far as it goes, an unclosed script
or comment to the end of the page; very long pages are read whole; repeated rows
are extracted one by one; an empty table gives an empty result; an input column
that has the name of a result column is replaced.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Element names of HTML by their role.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg select canvas annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics object audio video".split())
ASIDE = frozenset("nav footer aside form button menu dialog".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": (), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login search share sharing social comment comments disqus reply replies "
    "feedback opinion opinions discussion discussions talkback respond related recommended recommendations teaser teasers widget widgets toolbar pagination pager copyright legal disclaimer topbar topnav sitemap tags".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NEUTRAL = frozenset("with has no wrapper container layout page body".split())
MAIN = frozenset(["article", "main"])
PUNCTUATION = frozenset(".,;:!?…。，、！？")
SHARE_OF_DEVIATION = 0.4
#: The prior's factor, and the least score of content.
LOW, FLOOR = 0.05, 2.0
#: A form with so much of the page's text is its frame.
FRAME = 0.8
KERNEL = (0.25, 0.5, 0.25)
MOST_LINKS = 0.6
#: Elements that are text beside an article's other text, without a ratio of their own.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote ul ol dl table figure figcaption hgroup details address".split())
_ATTRIBUTES: dict[tuple[str, str], tuple[bool, bool, bool, bool]] = {}


def judged(name: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    """(is hidden, has a role beside the content, is marked as the main part, has a name like boilerplate) of an element, by its attributes."""
    key = (name, attributes)
    if key not in _ATTRIBUTES:
        if len(_ATTRIBUTES) > 100_000:
            _ATTRIBUTES.clear()
        _ATTRIBUTES[key] = _judge(name, attributes)
    return _ATTRIBUTES[key]


def _judge(name: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    role, style = found.get("role", "").lower(), SPACE.sub("", found.get("style", "").lower())
    main = role == "main" or found.get("itemprop", "").lower() == "articlebody"
    hidden = found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style or bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes))
    if hidden or role in ROLES or name in ("html", "body", "article", "main", "h1", "h2"):
        return hidden, role in ROLES, main, False
    for names in (found.get("class", ""), found.get("id", "")):
        for one in names.split():
            words = {w.lower() for w in WORD.findall(one)}
            if words & BOILERPLATE and not words & NEUTRAL:
                return False, False, main, True
    return False, False, main, False


class Block:
    __slots__ = ("links", "low", "marks", "parent", "path", "size", "text")

    def __init__(self, text: str, links: int, parent: int, path, low: bool = False):
        self.text, self.links, self.parent, self.path, self.low = text, links, parent, path, low
        self.size = len(text)
        self.marks = sum(c in PUNCTUATION for c in text)

    def plain(self) -> bool:
        """Neither low nor mostly links."""
        return not self.low and self.links <= MOST_LINKS * self.size


class Page:
    """Blocks of a page that are shown, and the tree of block elements above them.

    Elements are numbered as they open, so what is below one is the range of numbers up to its ``ends``."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.parents, self.mains, self.named, self.beside, self.tags, self.paths = [-1], [False], [False], [""], [""], [0]
        self._path_of: dict[tuple[int, str], int] = {}
        self._names: list[str] = []
        self._count: dict[str, int] = {}
        self._out: list[bool] = []
        self._nodes: list[int] = []
        self._text: list[str] = []
        self._links, self._link = 0, False
        self._scan(html)
        self._flush()
        self.ends = [n + 1 for n in range(len(self.parents))]
        for n in range(len(self.parents) - 1, 0, -1):
            self.ends[self.parents[n]] = max(self.ends[self.parents[n]], self.ends[n])

    def holds(self, node: int, block: Block) -> bool:
        return node <= block.parent < self.ends[node]

    def below(self, values: list[int]) -> list[int]:
        """For each element the sum over the blocks in it."""
        out = [0] * len(self.parents)
        for b, v in zip(self.blocks, values):
            out[b.parent] += v
        for n in range(len(out) - 1, 0, -1):
            out[self.parents[n]] += out[n]
        return out

    def _scan(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            m = TOKEN.search(html, at)
            if m is None:
                self._add(html[at:])
                return
            if m.start() > at:
                self._add(html[at : m.start()])
            at = m.end()
            # the second form is a tag with a quote that is never closed: it ends at the next '>'
            slash, name, attributes = m.group(1, 2, 3) if m[2] is not None else m.group(4, 5, 6)
            if name is None:
                continue
            name = name.lower()
            if slash:
                self._close(name)
            elif name in RAW:
                if attributes.endswith("/") and name == "svg":
                    continue
                done = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                if name == "xmp":  # shown as it stands
                    self._flush()
                    if not (self._out and self._out[-1]):
                        self._text.append(html[at : done.start() if done else end])
                    self._flush()
                at = done.end() if done else end
            else:
                self._open(name, attributes)

    def _add(self, text: str) -> None:
        if not (self._out and self._out[-1]):
            text = unescape(text) if "&" in text else text
            self._text.append(text)
            if self._link:
                self._links += len(text.strip())

    def _flush(self) -> None:
        if self._text:
            text = SPACE.sub(" ", "".join(self._text)).strip()
            if text:
                node = self._nodes[-1] if self._nodes else 0
                self.blocks.append(Block(text, self._links, node, self.paths[node]))
            self._text, self._links = [], 0

    def _open(self, name: str, attributes: str) -> None:
        if name == "br" or name in VOID:
            if name == "hr":
                self._flush()
            elif name == "br":
                self._text.append(" ")
            return
        if name in INLINE:
            if name == "a":
                self._link = True
            if attributes and judged(name, attributes)[0] and not (self._out and self._out[-1]):
                self._push(name, True, False)
            return
        self._flush()
        if name in CLOSES_P and self._count.get("p"):
            self._pop("p", ("article", "section", "div", "td", "th", "li", "blockquote"))
        for other in SIBLINGS.get(name, ()):
            if self._count.get(other):
                self._pop(other, SCOPE[name])
        hidden, beside, main, named = judged(name, attributes) if attributes else (False,) * 4
        out = bool(self._out and self._out[-1]) or hidden or name == "head"
        beside = beside or name in ASIDE or name == "header" and not any(self._count.get(n) for n in MAIN)
        if name == "body":
            while self._count.get("head"):
                self._cut(len(self._names) - 1)
            out = hidden
        self._push(name, out, main or name in MAIN, named, name if beside else "")

    def _push(self, name: str, out: bool, main: bool, named: bool = False, beside: str = "") -> None:
        self.parents.append(self._nodes[-1] if self._nodes else 0)
        self.mains.append(main and not out)
        self.named.append(named)
        self.beside.append(beside)
        self.tags.append(name)
        above = self.paths[self.parents[-1]]
        self.paths.append(self._path_of.setdefault((above, name), len(self._path_of) + 1))
        self._names.append(name)
        self._count[name] = self._count.get(name, 0) + 1
        self._out.append(out)
        self._nodes.append(len(self.parents) - 1)

    def _cut(self, k: int) -> None:
        for name in self._names[k:]:
            self._count[name] -= 1
        del self._names[k:], self._out[k:], self._nodes[k:]

    def _pop(self, name: str, barriers: tuple[str, ...] = ()) -> None:
        """Close the nearest open ``name`` and all within it, unless a barrier stands between."""
        for k in range(len(self._names) - 1, -1, -1):
            if self._names[k] == name:
                self._cut(k)
                return
            if self._names[k] in barriers:
                return

    def _close(self, name: str) -> None:
        if name == "a":
            self._link = False
        if name in INLINE:
            if self._names and self._names[-1] == name:
                self._pop(name)
            return
        if name == "br":
            self._text.append(" ")
            return
        self._flush()
        if self._count.get(name):
            self._link = False
            self._pop(name, ("td", "th", "table") if name in ("div", "p", "li") else ())


def smoothed(values: list[float]) -> list[float]:
    """A three-point kernel; the ends repeat their value."""
    padded = [values[0], *values, values[-1]] if values else []
    return [sum(w * padded[i + k] for k, w in enumerate(KERNEL)) for i in range(len(values))]


def ratios(blocks: list[Block], keys: list) -> dict:
    """Of each key: text without links by node, and punctuation by node."""
    totals: dict = {}
    for key, b in zip(keys, blocks):
        t = totals.setdefault(key, [0, 0, 0])
        t[0] += max(0, b.size - b.links)
        t[1] += b.marks
        t[2] += 1
    return {key: (text / n, marks / n) for key, (text, marks, n) in totals.items()}


def scores(blocks: list[Block]) -> list[float]:
    """The fused ratio of each node: text by node of its path, weighted by punctuation by node, times the prior."""
    keys = [(b.path, b.low) for b in blocks]
    of = ratios(blocks, keys)
    text, marks = (smoothed([of[key][k] for key in keys]) for k in (0, 1))
    return [t * math.sqrt(1 + m) * (LOW if b.low else 1.0) for t, m, b in zip(text, marks, blocks)]


def threshold(blocks: list[Block], score: list[float]) -> float:
    """A share of the scores' standard deviation, but at most half of the best score outside low elements; nothing is content without one."""
    mean = sum(score) / len(score)
    deviation = math.sqrt(sum((s - mean) ** 2 for s in score) / len(score))
    best = max((s for s, b in zip(score, blocks) if not b.low), default=math.inf)
    return max(FLOOR, min(SHARE_OF_DEVIATION * deviation, best / 2) if best < math.inf else math.inf)


def weigh(page: Page) -> None:
    """Tell which blocks have the low prior."""
    blocks, parents = page.blocks, page.parents
    plain = [max(0, b.size - b.links) for b in blocks]
    held, total = page.below(plain), sum(plain)
    low, names = [False] * len(parents), [0] * len(parents)  # of an element and all above it: whether one is beside the content, how many are named
    for n in range(1, len(parents)):
        up = parents[n]
        low[n] = low[up] or bool(page.beside[n]) and not (page.beside[n] == "form" and held[n] >= FRAME * total)
        names[n] = names[up] + page.named[n]
    for b in blocks:
        b.low = low[b.parent]
    hints = [0 if b.low else names[b.parent] for b in blocks]
    if not any(hints):
        return
    keys = [(b.path, b.low, n) for b, n in zip(blocks, hints)]
    ratio = {key: text * math.sqrt(1 + marks) for key, (text, marks) in ratios(blocks, keys).items() if not key[1]}
    best = max(ratio.values())
    mass: dict = {}
    for key, n in zip(keys, plain):
        mass[key] = mass.get(key, 0) + n
    most = sum(n for n, b in zip(plain, blocks) if not b.low) / 2
    kept = [True] + [not named for named in page.named[1:]]
    seen: set[int] = set()
    for key, b, n in zip(keys, blocks, hints):
        if n and ratio[key] >= best and mass[key] >= most and b.links <= MOST_LINKS * b.size:
            at = b.parent
            while at > 0 and at not in seen:
                seen.add(at)
                kept[at], at = True, parents[at]
    for n in range(1, len(parents)):
        kept[n] = kept[n] and kept[parents[n]]
    for b in blocks:
        b.low = b.low or not kept[b.parent]


def containers(page: Page, score: list[float], limit: float, weight: list[int]) -> list[int]:
    """The main elements, none within another, that hold chosen text (``weight``) and have a mean score by text above the limit."""
    mains = [n for n in range(1, len(page.parents)) if page.mains[n] and weight[n]]
    inner: dict[int, list[int]] = {}
    open_: list[int] = []
    for n in mains:
        while open_ and page.ends[open_[-1]] <= n:
            open_.pop()
        inner.setdefault(open_[-1] if open_ else 0, []).append(n)
        open_.append(n)
    found = []
    for n in inner.get(0, []):
        base = at = n
        while True:
            below = [m for m in inner.get(at, []) if 10 * weight[m] >= 7 * weight[base]]
            if below:
                at = max(below, key=lambda m: weight[m])
            elif at == base:
                break
            else:
                base = at
        own = [k for k, b in enumerate(page.blocks) if page.holds(at, b)]
        if sum(score[k] * page.blocks[k].size for k in own) >= limit * sum(page.blocks[k].size for k in own if not page.blocks[k].low):
            found.append(at)
    return found


def home(page: Page, chosen: list[bool], weight: list[int]) -> int:
    """The deepest element with most of the chosen text, widened while all that a parent adds is content."""
    at = max((n for n in range(len(weight)) if 10 * weight[n] >= 7 * weight[0]), default=0)  # these are one below another
    text = page.below([b.size if b.plain() else 0 for b in page.blocks])
    children: dict[int, list[int]] = {}
    for n in range(1, len(page.parents)):
        if text[n]:
            children.setdefault(page.parents[n], []).append(n)
    while at > 0:
        up = page.parents[at]
        if not all(n == at or page.tags[n] in TEXTUAL or 2 * weight[n] >= text[n] for n in children.get(up, [])):
            break
        at = up
    return at


def main_text(html: str | None) -> str:
    page = Page(html or "")
    blocks = page.blocks
    if not blocks:
        return ""
    weigh(page)
    score = scores(blocks)
    limit = threshold(blocks, score)
    chosen = [s >= limit and b.links <= MOST_LINKS * b.size for s, b in zip(score, blocks)]
    weight = page.below([b.size if own else 0 for b, own in zip(blocks, chosen)])
    if not weight[0]:
        return ""
    inside = containers(page, score, limit, weight) or [home(page, chosen, weight)]
    return " ".join(b.text for b, own in zip(blocks, chosen) if (own or b.plain()) and any(page.holds(n, b) for n in inside))


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` without its html, with text and n_chars (code points)."""
    rest = [f for f in df.schema.fields if f.name not in (html, "text", "n_chars")]
    plain = [f"c{i}" for i in range(len(rest))]
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(plain, rest)), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def task(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(plain)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    named = df.select(*(F.col(f"`{f.name}`").alias(c) for f, c in zip(rest, plain)), F.col(f"`{html}`").alias("html"))
    return named.mapInArrow(task, schema).toDF(*[f.name for f in rest], "text", "n_chars")
