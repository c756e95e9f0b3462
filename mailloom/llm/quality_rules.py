"""Line-first cleaning: judge every line, remove those that fail, reject texts that lose too much.

Lines and words count as equal only if their bytes are: hashes propose, a comparison decides.

Cases: a null or empty text has no words, fails the base test and cleans to ''; ties and repeated
rows are judged independently; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, classes_of, shingles, small_batches, sums_at, text_slices

WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the verdict on a text."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    #: marks of `noise` per word from which a line fails
    noise_per_word: float = 0.3
    noise: bytes = b"!#$%&*|<>@^~{}="
    #: a line of so many words needs a closing mark after one of them
    close_from: int = 12
    closing: str = ".!?:;,)\"'»”’…。！？"
    #: separators per word from which a line counts as navigation
    nav: bytes = b"|>"
    nav_per_word: float = 0.2
    boilerplate: bytes = rb"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|uses cookies|enable javascript|skip to (?:main )?content|sign in to continue|subscribe to our newsletter|click here to"
    #: a text is rejected when failing lines hold more than this share of its word characters
    max_loss: float = 0.5


def _table(marks: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(marks)] = True
    return t


_SYMBOLS = _table(b"#*$%&|<>")


def _ends_with(buf: np.ndarray, w: Words, marks: str) -> np.ndarray:
    """Which words end with one of the marks."""
    last = buf[w.end - 1] if len(w.end) else np.empty(0, np.uint8)
    out = _table("".join(m for m in marks if m < "\x80").encode())[last]
    other = np.flatnonzero(last >= 0x80)
    for m in (m.encode() for m in marks if m >= "\x80"):
        hit = other[w.end[other] - w.start[other] >= len(m)]
        for k, b in enumerate(reversed(m)):
            hit = hit[buf[w.end[hit] - 1 - k] == b]
        out[hit] = True
    return out


def _line_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nl = np.flatnonzero(buf == 10)
    start = np.sort(np.concatenate([off[:-1], nl + 1]), kind="stable")
    end = np.sort(np.concatenate([nl, off[1:]]), kind="stable")
    # each text has one more line than line feeds, so the order of starts gives the owner
    lines = 1 + np.searchsorted(nl, off[1:]) - np.searchsorted(nl, off[:-1])
    return start, end, np.concatenate([[0], np.cumsum(lines)])


def repeated(*keys: np.ndarray, first: bool) -> np.ndarray:
    """Which elements, equal in all keys, occur twice or more; without the first of each if not `first`."""
    order = np.lexsort(keys)
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    out = np.zeros(len(order), bool)
    out[order[1:]] = same
    if first:
        out[order[:-1]] |= same
    return out


def repeated_windows(word: np.ndarray, owner: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """First words of the windows of `size` words that occur twice or more in their text."""
    win, at = shingles(word.astype(np.uint64), owner, size)
    maybe = np.flatnonzero(repeated(win, doc[at], first=True))
    # the few windows of equal hashes, word by word
    columns = [word[at[maybe] + j] for j in range(size)]
    return at[maybe[repeated(*columns, doc[at[maybe]], first=True)]]


def judge(buf: np.ndarray, off: np.ndarray, r: LineRules) -> dict[str, np.ndarray]:
    """Measures of every text of a slice, and for its lines the bounds and whether they stay."""
    d = len(off) - 1
    w = Words(buf, off)
    n_words = np.diff(w.owner)
    points = ((buf & 0xC0) != 0x80) & ~w.space
    out = {"n_words": n_words, "word_chars": sums_at(points, off), "n_symbols": sums_at(_SYMBOLS[buf], off)}
    ls, le, lo = _line_bounds(buf, off)
    line_doc = np.repeat(np.arange(d), np.diff(lo))
    a, b = np.searchsorted(w.start, ls), np.searchsorted(w.start, le)
    has = np.flatnonzero(b > a)
    dup = has[repeated(classes_of(buf, ls[has], le[has]), line_doc[has], first=False)]
    out["n_dup_lines"] = np.bincount(line_doc[dup], minlength=d)
    hit = repeated_windows(classes_of(buf, w.start, w.end), w.owner, w.doc(), r.window)
    cover = np.zeros(len(w.start) + r.window + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + r.window, -1)
    out["n_repeat_words"] = sums_at(np.cumsum(cover)[: len(w.start)] > 0, w.owner)
    out["base_failed"] = (n_words < r.min_words) | (100 * out["n_repeat_words"] > r.max_repeat_percent * n_words)
    # line rules
    words = b - a
    count = lambda marks: sums_at_range(_table(marks)[buf], ls, le)
    fail_noise = count(r.noise) > r.noise_per_word * words
    fail_nav = count(r.nav) > r.nav_per_word * words
    closed = _ends_with(buf, w, r.closing)
    fail_close = (words >= r.close_from) & (sums_at_range(closed, a, b) == 0)
    fail_boiler = np.zeros(len(ls), bool)
    if r.boilerplate:
        found = [m.start() for m in re.finditer(rb"(?i)" + r.boilerplate, buf.tobytes())]
        fail_boiler[np.searchsorted(ls, found, "right") - 1] = True
    bad = (words > 0) & (fail_noise | fail_nav | fail_close | fail_boiler)
    weight = sums_at_range(points, ls, le)
    lost = np.bincount(line_doc[bad], weights=weight[bad], minlength=d)
    out["n_bad_lines"] = np.bincount(line_doc[bad], minlength=d)
    out["lost"] = lost / np.maximum(out["word_chars"], 1)
    out["kept"] = ~out["base_failed"] & (out["lost"] <= r.max_loss)
    return out | {"_lines": (ls, le, lo, bad)}


def sums_at_range(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]


_LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines"]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bad_lines long, base_failed boolean, kept boolean, lost double"


def line_clean(docs: DataFrame, rules: LineRules = LineRules(), with_text: bool = False) -> DataFrame:
    """Measures and verdict of every text; with_text adds clean_text, the lines that passed."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in text_slices(batch.column(1)):
                m = judge(buf, off, rules)
                cols = {"doc_id": batch.column(0).slice(a, b - a)}
                cols |= {k: pa.array(m[k].astype(np.int64)) for k in _LONGS}
                cols |= {"base_failed": pa.array(m["base_failed"]), "kept": pa.array(m["kept"]), "lost": pa.array(m["lost"].astype(np.float64))}
                if with_text:
                    ls, le, lo, bad = m["_lines"]
                    raw = buf.tobytes()
                    keep = [[raw[ls[i] : le[i]] for i in range(lo[k], lo[k + 1]) if not bad[i]] for k in range(b - a)]
                    cols["clean_text"] = pa.array([b"\n".join(x).decode("utf-8") for x in keep], pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + ", clean_text string" * with_text)
