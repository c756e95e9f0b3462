"""HTML to text and body cleaning, exact, as Arrow-batched functions.

The parser only records a page's events; what they mean is decided by one table of tag kinds, which
the generator `pieces` reads.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tags that start and end a line, and tags that betray HTML
LINE_TAGS = frozenset("address article blockquote br div footer h1 h2 h3 h4 h5 h6 header li p section table td th tr".split())
_MARKUP = re.compile(r"<(html|body|div|p|br|table|tr|td|th|span|style|script)\b", re.IGNORECASE)

LINE, LINK, HIDDEN = "line", "link", "hidden"
#: what a tag means; all others mean nothing
TAG_KINDS = dict.fromkeys(LINE_TAGS, LINE) | {"a": LINK, "script": HIDDEN, "style": HIDDEN}
#: targets that lead nowhere outside of the message
_INTERNAL = ("cid:", "data:")


class Event(NamedTuple):
    """Text (step 0), or a tag of a known kind that opens (1) or closes (-1)."""

    step: int
    kind: str = ""
    value: str = ""


class _Events(HTMLParser):
    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.seen: list[Event] = []
        self.feed(page)
        self.close()

    def handle_data(self, data: str) -> None:
        self.seen.append(Event(0, value=data))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if kind := TAG_KINDS.get(tag):
            # of an attribute given twice, the last counts
            href = [v for k, v in attrs if k == "href"] if kind == LINK else []
            self.seen.append(Event(1, kind, (href[-1] if href else None) or ""))

    def handle_endtag(self, tag: str) -> None:
        if kind := TAG_KINDS.get(tag):
            self.seen.append(Event(-1, kind))


def pieces(events: Iterable[Event]) -> Iterator[str]:
    """The visible text: hidden parts left out, lines broken, a link's target after its text."""
    depth, waiting = 0, []
    for step, kind, value in events:
        if kind == HIDDEN:
            depth = max(depth + step, 0)
        elif depth:
            continue
        elif not step:
            yield value
        elif kind == LINE:
            yield "\n"
        elif step > 0:
            waiting.append(value)
        elif waiting and (target := waiting.pop()) and not target.lower().startswith(_INTERNAL):
            yield f" <{target}>"


def html_to_text(page: str) -> str:
    return "".join(pieces(_Events(page).seen))


def looks_like_html(body: str, body_type: str | None) -> bool:
    return (body_type or "").casefold() == "html" or bool(_MARKUP.search(body))


def tidy(text: str) -> str:
    """No NUL, lines without blanks at the end and with single ones inside, runs of empty lines as one."""
    lines = (re.sub(r"[ \t]+", " ", line).rstrip() for line in text.translate({0: None}).splitlines())
    runs = itertools.groupby(lines, key=bool)
    return "\n".join("\n".join(run) if filled else "" for filled, run in runs).strip()


def clean_body(body: str | None, body_type: str | None = None) -> str:
    if not body:
        return ""
    return tidy(html_to_text(body) if looks_like_html(body, body_type) else html.unescape(body))


def clean_body_column(body: Column, body_type: Column) -> Column:
    @F.pandas_udf("string")
    def clean(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, types in parts:
            yield pd.Series([clean_body(b, t) for b, t in zip(bodies, types, strict=True)], dtype=object)

    return clean(body, body_type)
