"""Main text of web pages by tag-path ratios.

A tolerant scanner, linear in the page, turns it into blocks of text with their root-to-leaf tag paths.
Per path, the text length and punctuation of its blocks are averaged. The two are fused on a
logarithmic scale with the share of link text, smoothed over neighbouring blocks, averaged per path
again, and shifted by what the path's elements are called: inside of an article or main element it
counts for more, in parts that pages mark as navigation, advert, comment or the like for less. Paths
whose score reaches a share of the best one are content, the others are not; only what no browser
shows (scripts, styles, templates, hidden elements) is left out beforehand.

Cases: null or empty html gives ''; unclosed tags, quotes, scripts and cut-off character
references are tolerated; elements may be nested to any depth; repeated pages are extracted alike;
extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>")
_ATTR = re.compile(r"([a-zA-Z:_-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: what is neither tag nor text, and how it ends
_ASIDES = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">"))
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
_UNSEEN = frozenset("head template noscript svg canvas object audio video".split())
_PARTS = frozenset("nav footer aside form button select option menu dialog fieldset".split())
_PART_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
#: words in a class or id of parts that are not the article
_PART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets related recommended share sharing social comment comments reply replies respond disqus discussion cookie cookies consent gdpr newsletter subscribe subscription footer masthead login signin signup pagination pager toolbar paywall guestbook popup modal overlay".split()
)
#: words that may as well name parts of the article
_DOUBTFUL_WORDS = frozenset("promotion notice notices notification search searchbox hidden alert legal copyright feedback".split())
_HEADERS = frozenset({"header", "topbar"})
_ROOTS = frozenset({"article", "main"})
#: elements that are text themselves rather than hold parts of the page
_TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split()) | _INLINE
#: an opening tag of the first kind ends an open element of the second, up to the third
_P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_ENDED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_ENDED |= dict.fromkeys(_P_ENDERS, (("p",), ("table", "td", "th", "button", "object"))) | {n: _ENDED[n] for n in _P_ENDERS & set(_ENDED)}
_PUNCT = re.compile(r"[.,;:!?¿¡…،。、！？]")


@dataclass(frozen=True)
class PathSettings:
    #: characters and marks of a block beyond which a path gains no more
    full_chars: int = 512
    full_marks: int = 31
    #: weight of each neighbouring block in the smoothing, its own being 1
    neighbour: float = 0.25
    #: bits that names add to a path's score
    in_root: float = 8.0
    part: float = -30.0
    part_word: float = -16.0
    doubtful_word: float = -10.0
    #: bits for paths outside of article and main, where these hold most of the content
    beside_root: float = -8.0
    #: share of the best score from which a path is content
    bar: float = 0.4


@dataclass(slots=True)
class _Open:
    """An open element: its block path, bits of its names, whether it is seen, in a link, in a root."""

    name: str
    path: int
    bits: float
    unseen: bool
    link: bool
    root: bool


@dataclass(slots=True)
class Block:
    """Text between two tags that are not inline, and the path of the element that holds it."""

    path: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


class Page:
    """The blocks of a page in order, and its paths: parent, label, bits of the names, inside of a root."""

    def __init__(self, page: str, s: PathSettings):
        self.s = s
        self.parent, self.label, self.bits, self.root = [-1], [""], [0.0], [False]
        self._known: dict[tuple[int, str, float, bool], int] = {}
        self._open: list[_Open] = [_Open("", 0, 0.0, False, False, False)]
        self._at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[Block] = [Block(0)]
        self._scan(page)

    def name(self, path: int) -> str:
        steps = []
        while path:
            steps.append(self.label[path])
            path = self.parent[path]
        return "/" + "/".join(reversed(steps))

    # the scanner: every step is linear, also in pages made to be slow

    def _scan(self, page: str) -> None:
        at = 0
        last = page.rfind(">")  # after it there can be no whole tag
        while at < len(page):
            start = page.find("<", at)
            self._text(page[at:] if start < 0 else page[at:start])
            at = len(page) if start < 0 else self._tag(page, start, last)

    def _tag(self, page: str, start: int, last: int) -> int:
        """Takes what begins with the `<` at start; the place after it."""
        for opening, closing in _ASIDES:
            if page.startswith(opening, start):
                found = page.find(closing, start + len(opening))
                return len(page) if found < 0 else found + len(closing)
        m = _TAG.match(page, start) if start < last else None
        if m is None:
            # a tag that the page's end cut off is markup, not text
            after = page[start + 1 : start + 2]
            if start >= last and (after == "/" or after.isascii() and after.isalpha()):
                return len(page)
            self._text("<")
            return start + 1
        name = m[2].lower()
        if name not in _INLINE:
            self._break()
        if m[1]:
            self._close(name)
        elif name in _RAW:
            ending = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, m.end())
            return ending.end() if ending else len(page)
        elif name == "br":
            self._text(" ")
        elif name not in _VOID and not (m[3].endswith("/") and name in ("path", "use")):
            self._start(name, m[3])
        return m.end()

    def _text(self, raw: str) -> None:
        top = self._open[-1]
        if raw and not top.unseen:
            text = html.unescape(raw)
            block = self.blocks[-1]
            block.pieces.append(text)
            if top.link:
                block.linked += len(text.strip())

    def _break(self) -> None:
        if self.blocks[-1].pieces:
            self.blocks.append(Block(0))

    def _pop(self, size: int) -> None:
        while len(self._open) > size:
            self._at[self._open.pop().name].pop()
        self._place()

    def _place(self) -> None:
        """Text that follows belongs to the innermost element that is not inline."""
        if not self.blocks[-1].pieces:
            self.blocks[-1].path = self._open[-1].path

    def _close(self, name: str) -> None:
        if self._at[name]:
            self._pop(self._at[name][-1])
        self._place()

    def _start(self, name: str, attrs: str) -> None:
        if name in _ENDED:
            ends, until = _ENDED[name]
            fence = max((self._at[n][-1] for n in until if self._at[n]), default=0)
            # at most one of each kind is open inside of the fence; a row ends its cells with itself
            inner = [self._at[n][-1] for n in ends if self._at[n] and self._at[n][-1] > fence]
            if inner:
                self._pop(min(inner))
        up = self._open[-1]
        bits, unseen = (0.0, True) if up.unseen else self._names(name, attrs, up.root)
        root = up.root or name in _ROOTS
        path = up.path
        if name not in _INLINE:
            path = self._path(up.path, name + self._class(attrs), min(up.bits, bits), root)
        self._at[name].append(len(self._open))
        self._open.append(_Open(name, path, min(up.bits, bits), unseen, up.link or name == "a", root))
        self._place()

    def _path(self, parent: int, label: str, bits: float, root: bool) -> int:
        key = (parent, label, bits, root)
        if key not in self._known:
            self._known[key] = len(self.parent)
            self.parent.append(parent)
            self.label.append(label)
            self.bits.append(bits)
            self.root.append(root)
        return self._known[key]

    @staticmethod
    def _class(attrs: str) -> str:
        m = re.search(r"\bclass\s*=\s*[\"']?\s*([a-zA-Z][a-zA-Z_-]*)", attrs) if attrs else None
        return "." + m[1].lower() if m else ""

    def _names(self, name: str, attrs: str, root: bool) -> tuple[float, bool]:
        """What the element's names say: bits, and whether it is never shown."""
        s = self.s
        bits, unseen = (s.part if name in _PARTS or name == "header" and not root else 0.0), name in _UNSEEN
        if not attrs or name in ("html", "body"):
            return bits, unseen
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                unseen = True
            elif key == "role" and value in _PART_ROLES:
                bits = min(bits, s.part)
            elif key in ("class", "id"):
                whole = set(value.split())
                # in a root, texts and the root itself are judged by whole names only
                words = whole if name in _ROOTS or root and name in _TEXTS else set(re.split(r"[^a-z]+", value))
                if words & _PART_WORDS or not root and words & _HEADERS:
                    bits = min(bits, s.part_word)
                elif words is not whole and words & _DOUBTFUL_WORDS:
                    bits = min(bits, s.doubtful_word)
        return bits, unseen

    # the ratios

    def table(self) -> dict[int, list[int]]:
        """Per path: blocks with text, their characters, punctuation marks and characters in links."""
        out: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for b in self.blocks:
            if text := b.text:
                for k, n in enumerate((1, len(text), len(_PUNCT.findall(text)), min(b.linked, len(text)))):
                    out[b.path][k] += n
        return out

    def scores(self) -> dict[int, float]:
        """Per path with text: its smoothed ratio in bits, and what its names add."""
        s, table = self.s, self.table()
        ratio = {}
        for path, (n, chars, marks, linked) in table.items():
            links = 0.0 if self.root[path] else linked / chars
            ratio[path] = (np.log2(1 + min(chars / n, s.full_chars)) + np.log2(1 + min(marks / n, s.full_marks))) * (1 - links)
        paths = [b.path for b in self.blocks if b.text]
        if not paths:
            return {}
        own = np.array([ratio[p] for p in paths])
        wide = np.concatenate([own[:1], own, own[-1:]])
        smooth = (own + s.neighbour * (wide[:-2] + wide[2:])) / (1 + 2 * s.neighbour)
        total: dict[int, float] = defaultdict(float)
        for p, x in zip(paths, smooth, strict=True):
            total[p] += x
        return {p: total[p] / table[p][0] + self.bits[p] + s.in_root * self.root[p] for p in table}

    def content(self) -> list[Block]:
        """The blocks of the paths that reach the bar."""
        scores = self.scores()
        best = max(scores.values(), default=0.0)
        if best <= 0:
            return []
        chosen = {p for p, x in scores.items() if x >= self.s.bar * best}
        size = defaultdict(int)
        for p, (_, chars, _, _) in self.table().items():
            size[p in chosen and self.root[p], p in chosen] += chars
        if size[True, True] >= size[False, True]:
            chosen = {p for p in chosen if self.root[p] or scores[p] + self.s.beside_root >= self.s.bar * best}
        return [b for b in self.blocks if b.path in chosen]


def main_text(page: str | None, s: PathSettings = PathSettings()) -> str:
    if not page:
        return ""
    return "\n".join(t for b in Page(page, s).content() if (t := b.text))


def extract_main_text(pages: DataFrame, s: PathSettings = PathSettings()) -> DataFrame:
    """page_id, url, text and its code points n_chars for each row of page_id, url, html."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x.as_py(), s) for x in batch.column(2)]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64())})

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
