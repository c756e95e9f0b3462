"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with FTRL-proximal (elastic net), calibrated with one temperature. Characters other than
letters count as a space and runs of spaces as one, so marks and numbers carry no weight. N-grams
of one to three characters are hashed to 2**`bits` features; a text's value of a feature is its
share among the text's n-grams times the feature's inverse document frequency.

Training reads a bounded sample (`per_class` texts of each language, in expectation, and the `most_classes`
most frequent languages, equal numbers in order of name); document frequencies are counted over every training text.

Cases: a null text, or one without letters, is `und` with score 0; null labels are not learned
from; without any training rows all texts are `und`; repeated rows are scored alike; extra columns
are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

UND = "und"


@dataclass(frozen=True)
class LanguageSettings:
    bits: int = 15
    #: bound of the training sample, texts of each language
    per_class: int = 700
    #: languages learned, the most frequent ones; a column of free text has any number of values
    most_classes: int = 256
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-4
    calibration_share: float = 0.25


@dataclass
class LanguageModel:
    classes: list[str]
    #: (features, classes): weight times inverse document frequency
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int


#: code points from here on hold no letters
_NO_LETTERS = 0x40000


@functools.cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter, by Unicode's categories; the last entry stands for all beyond."""
    return np.array([*(chr(c).isalpha() for c in range(_NO_LETTERS)), False])


def _features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of the texts, the bounds of each text's, and whether it has letters."""
    low = [(t or "").lower() for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    cp = np.frombuffer(" ".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    off = np.concatenate([[0], np.cumsum(size + 1)])
    letter = _letters()[np.minimum(cp, _NO_LETTERS)]
    lead = np.concatenate([[0], np.cumsum(letter)])
    ends = np.minimum(off[1:], len(cp))
    letters = lead[ends] - lead[off[:-1]] > 0
    # one space between runs of letters
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    bound = np.concatenate([place[off[:-1]], [place[-1]]])
    c = np.where(letter, cp, 32)[keep].astype(np.uint32)
    if len(c) < 3:
        c = np.concatenate([c, np.full(3 - len(c), 32, np.uint32)])
        bound[-1] = len(c)
    n = len(c)
    m1 = c * np.uint32(0x9E3779B1)
    m2, m3 = m1.copy(), m1.copy()
    m2[1:] ^= c[:-1] * np.uint32(0x85EBCA77)
    m2 = (m2 ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
    m3[2:] = m2[2:] ^ (c[:-2] * np.uint32(0xC2B2AE3D))
    m3 = (m3 ^ np.uint32(0x51ED270B)) * np.uint32(0x9E3779B1)
    grams = np.empty((n, 3), np.uint32)
    for k, m in enumerate((m1, m2, m3)):
        grams[:, k] = (m ^ (m >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - bits)
    return grams, bound, letters


def _chunks(texts: list[str | None], limit: int = 1 << 20):
    a, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= limit:
            yield a, texts[a : i + 1]
            a, held = i + 1, 0
    if a < len(texts):
        yield a, texts[a:]


def _ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, s: LanguageSettings) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal: per-coordinate rates, weights zero while the summed gradient is below l1."""
    dim = (1 << s.bits) + 1
    z, n = np.zeros((dim, classes)), np.zeros((dim, classes))

    def weight(i: np.ndarray) -> np.ndarray:
        zi, ni = z[i], n[i]
        return np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2))

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for k in order.permutation(len(x)):
            i, v = x[k]
            w = weight(i)
            p = v @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y[k]] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weight(np.arange(dim))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(u: float) -> float:
        a = logits / np.exp(u)
        a = a - a.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(a).sum(1)) - a[np.arange(len(y)), y]))

    lo, hi, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train_language(docs: DataFrame, s: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """Learn from all rows given, which have doc_id, text and lang."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    bits = s.bits

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for _, texts in _chunks(batch.column(0).to_pylist()):
                grams, bound, _ = _features(texts, bits)
                for k in range(len(texts)):
                    if bound[k + 1] > bound[k]:
                        df += np.bincount(grams[bound[k] : bound[k + 1]].ravel(), minlength=1 << bits) > 0
                total += len(texts)
        i = np.flatnonzero(df)
        if total:
            yield pa.RecordBatch.from_pydict({"f": pa.array(np.append(i, 1 << bits)), "n": pa.array(np.append(df[i], total))})

    # bounded by the number of features, at any size of the input
    counted = rows.select("text").mapInArrow(frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(s.most_classes)
    by_class = {r["lang"]: r["count"] for r in most.collect()}
    classes = sorted(by_class)
    if not classes:
        return LanguageModel([], np.zeros((1 << bits, 0)), np.zeros(0), 1.0, bits)
    df = np.zeros((1 << bits) + 1)
    df[counted["f"].to_numpy()] = counted["n"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    # a share of each language that leaves about per_class texts; all, if there are fewer
    share = docs.sparkSession.createDataFrame([(c, s.per_class / by_class[c]) for c in classes], "lang string, share double")
    u = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000)) / 1_000_000

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, lang in zip(pdf["text"], pdf["lang"], strict=True):
                grams, _, letters = _features([t], bits)
                if letters[0]:
                    i, n = np.unique(grams, return_counts=True)
                    out.append((lang, i.astype(np.uint32).tobytes(), (n / n.sum()).astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["lang", "i", "v"])

    sample = rows.join(F.broadcast(share), "lang").where(u < F.col("share")).select("text", "lang").mapInPandas(vectors, "lang string, i binary, v binary").toPandas()
    sample = sample.sort_values(["lang", "i", "v"], kind="stable").reset_index(drop=True)
    y = sample["lang"].map({c: k for k, c in enumerate(classes)}).to_numpy(int)
    x = []
    for i, v in zip(sample["i"], sample["v"], strict=True):
        i = np.frombuffer(i, np.uint32).astype(np.int64)
        v = np.frombuffer(v, np.float32) * idf[i]
        x.append((np.append(i, 1 << bits), np.append(v / max(np.linalg.norm(v), 1e-12) * 4, 1.0)))
    # scoring is additive over n-grams, so the scale of a text's vector goes into its logits
    late = np.random.default_rng(11).random(len(x)) < s.calibration_share
    early = [k for k in range(len(x)) if not late[k]] or list(range(len(x)))
    w, b = _ftrl([x[k] for k in early], y[early], len(classes), s)
    full = np.vstack([w, b[None]])
    held = np.flatnonzero(late)
    logits = np.array([x[k][1] @ full[x[k][0]] for k in held]).reshape(len(held), len(classes))
    return LanguageModel(classes, np.hstack([w * idf[:, None], (idf**2)[:, None]]).astype(np.float32), b, _temperature(logits, y[held]), bits)


def predict_language(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """lang_pred and score (calibrated probability) for each doc_id, text; keep: columns to pass through."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.classes)
        table, names = np.ascontiguousarray(m.weights[:, :k], dtype=np.float32), np.array([*m.classes, UND], dtype=object)
        idf = np.sqrt(m.weights[:, k]) if k else None
        for batch in batches:
            for a, texts in _chunks(batch.column(1).to_pylist()):
                pred, score = np.full(len(texts), k), np.zeros(len(texts))
                if k:
                    grams, bound, letters = _features(texts, m.bits)
                    for d in np.flatnonzero(letters):
                        count = np.bincount(grams[bound[d] : bound[d + 1]].ravel(), minlength=1 << m.bits) if bound[d + 1] - bound[d] > 4000 else None
                        if count is None:
                            i, n = np.unique(grams[bound[d] : bound[d + 1]], return_counts=True)
                        else:
                            i = np.flatnonzero(count)
                            n = count[i]
                        logit = 4 * (n @ table[i]) / max(float(np.linalg.norm(n * idf[i])), 1e-12) + m.bias
                        p = np.exp((logit - logit.max()) / m.temperature)
                        pred[d], score[d] = p.argmax(), p.max() / p.sum()
                same = {n: batch.column(n).slice(a, len(texts)) for n in ("doc_id", *keep)}
                yield pa.RecordBatch.from_pydict(same | {"lang_pred": pa.array(names[pred], pa.string()), "score": pa.array(score)})

    given = docs.select("doc_id", "text", *(c for c in keep if c != "text"))
    kept = "".join(f", `{c}` {given.schema[c].dataType.simpleString()}" for c in keep)
    return given.mapInArrow(run, f"doc_id long{kept}, lang_pred string, score double")
