"""Quality scoring by gated-attention multiple-instance learning.

A text is a bag of passages of `passage_words` words. Every passage is encoded: counts of byte
classes, word shapes and repeats, through one learned layer. Gated attention, learned from the
labels of whole texts, weighs the passages; the weighted mean is scored by a logistic unit.

Training reads a bounded sample (`per_class` texts of each label, in expectation).

Cases: null and empty texts have no passage and get the score of an all-zero representation;
without labels of both kinds every score is the share of label 1 (0.5 if there are none); a text
labelled twice counts twice, a null label not at all; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefix, Words, mix, small_batches, text_slices


@dataclass(frozen=True)
class QualitySettings:
    passage_words: int = 96
    #: bound of the training sample, texts of each label
    per_class: int = 3000
    #: passages that a text of the training sample gives at most, evenly spaced over all of it; scoring takes all
    train_passages: int = 256
    hidden: int = 24
    attention: int = 12
    epochs: int = 60
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 5


_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"!", b"?", b"|", b"#", b"*", b"$%", b"&", b"<>", b"@", b":;", b"-_", b"'\"", b"()[]{}", b"/\\", b"=+~^`"]
_CLASS = np.zeros(256, np.int64)
for _k, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _k + 1
_CLASS[0x80:0xC0] = len(_GROUPS) + 1
_CLASS[0xC0:] = len(_GROUPS) + 2
_N = len(_GROUPS) + 3
WIDTH = _N + 9


def encode_inputs(buf: np.ndarray, off: np.ndarray, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """(passages, WIDTH) raw features, and the bounds of each text's passages."""
    w = Words(buf, off)
    per_doc = np.diff(w.owner)
    cuts = -(-per_doc // words_each)
    bound = np.concatenate([[0], np.cumsum(cuts)])
    total = int(bound[-1])
    if not total:
        return np.zeros((0, WIDTH), np.float32), bound
    doc = np.repeat(np.arange(len(per_doc)), cuts)
    first = w.owner[doc] + (np.arange(total) - bound[doc]) * words_each
    last = np.minimum(first + words_each, w.owner[doc + 1])
    begin, stop = w.start[first], w.end[last - 1]
    size = (stop - begin).astype(np.float64)
    n = (last - first).astype(np.float64)
    # bytes between passages belong to the one before
    where = np.zeros(len(buf) + 1, np.int64)
    where[begin] = 1
    where = np.cumsum(where)[:-1]
    count = np.bincount(where * _N + _CLASS[buf], minlength=(total + 1) * _N).reshape(-1, _N)[1 : total + 1]
    out = np.zeros((total, WIDTH))
    out[:, :_N] = np.sqrt(count / np.maximum(size, 1)[:, None])
    length = w.end - w.start
    group = np.repeat(np.arange(total), last - first)
    pick = np.repeat(first - np.concatenate([[0], np.cumsum(last - first)[:-1]]), last - first) + np.arange(len(group))
    mean = lambda v: np.bincount(group, weights=v[pick], minlength=total) / n
    head, tail = buf[w.start], buf[w.end - 1]
    same = np.zeros(len(length), bool)
    key = Prefix(buf).of(w.start, w.end)
    same[1:] = key[1:] == key[:-1]
    kinds = mix(key[pick] + np.uint64(0x9E37) * group.astype(np.uint64))
    _, at = np.unique(kinds, return_index=True)
    out[:, _N] = mean(length) / 10
    out[:, _N + 1] = np.sqrt(np.maximum(mean(length.astype(float) ** 2) - mean(length) ** 2, 0)) / 10
    out[:, _N + 2] = mean((head >= 65) & (head <= 90))
    out[:, _N + 3] = mean((tail == 46) | (tail == 33) | (tail == 63))
    out[:, _N + 4] = mean(same)
    out[:, _N + 5] = np.bincount(group[at], minlength=total) / n
    out[:, _N + 6] = mean(length == 1)
    out[:, _N + 7] = np.log1p(n) / 5
    out[:, _N + 8] = np.log1p(per_doc[doc]) / 10
    return out.astype(np.float32), bound


def spaced(first: int, end: int, most: int) -> np.ndarray:
    """The numbers from first to before end, or `most` of them, evenly spaced."""
    n = int(end - first)
    return first + (np.arange(n) if n <= most else np.arange(most) * n // most)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    words_each: int

    def forward(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Score of each bag, and what the backward pass needs."""
        p, bags = self.p, len(bound) - 1
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"] + p["v"]), _sigmoid(h @ p["U"] + p["u"])
        raw = (t * g) @ p["w"]
        bag = np.repeat(np.arange(bags), np.diff(bound))
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, raw)
        a = np.exp(raw - top[bag])
        a /= np.bincount(bag, weights=a, minlength=bags)[bag]
        z = np.zeros((bags, h.shape[1]))
        np.add.at(z, bag, a[:, None] * h)
        return _sigmoid(z @ p["c"] + p["b"][0]), {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag}

    def gradient(self, y: np.ndarray, weight: np.ndarray, s: np.ndarray, k: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        p, bag, h, a = self.p, k["bag"], k["h"], k["a"]
        d = (s - y) * weight
        dz = d[:, None] * p["c"]
        out = {"c": k["z"].T @ d, "b": np.array([d.sum()])}
        each = (dz[bag] * h).sum(1)
        mean = np.bincount(bag, weights=a * each, minlength=len(y))
        draw = a * (each - mean[bag])
        tg = k["t"] * k["g"]
        out["w"] = tg.T @ draw
        dt = draw[:, None] * p["w"] * k["g"] * (1 - k["t"] ** 2)
        dg = draw[:, None] * p["w"] * tg * (1 - k["g"])
        out |= {"V": h.T @ dt, "v": dt.sum(0), "U": h.T @ dg, "u": dg.sum(0)}
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return out | {"E": k["x"].T @ dh, "e": dh.sum(0)}


def fit(bags: list[np.ndarray], y: np.ndarray, s: QualitySettings) -> QualityModel:
    r = np.random.default_rng(s.seed)
    draw = lambda *n: r.normal(0, 1 / np.sqrt(n[0]), n)
    p = {"E": draw(WIDTH, s.hidden), "e": np.zeros(s.hidden), "V": draw(s.hidden, s.attention), "v": np.zeros(s.attention), "U": draw(s.hidden, s.attention), "u": np.zeros(s.attention), "w": draw(s.attention), "c": draw(s.hidden), "b": np.zeros(1)}
    every = np.vstack([x for x in bags if len(x)] or [np.zeros((1, WIDTH))])
    m = QualityModel(every.mean(0).astype(np.float64), every.std(0).astype(np.float64) + 0.02, p, s.passage_words)
    if len(np.unique(y)) < 2:
        share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        p["c"][:], p["b"][0] = 0, np.log(share / (1 - share))
        return m
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(s.epochs):
        order = r.permutation(len(bags))
        rate = s.rate * 0.5 * (1 + np.cos(np.pi * epoch / s.epochs))
        for a in range(0, len(order), 128):
            pick = order[a : a + 128]
            bound = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
            score, kept = m.forward(np.vstack([bags[i] for i in pick]), bound)
            step += 1
            for name, g in m.gradient(y[pick], weight[pick], score, kept).items():
                g = g / len(pick) + s.decay * p[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                p[name] = p[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return m


def train_quality(docs: DataFrame, labels: DataFrame, s: QualitySettings = QualitySettings()) -> QualityModel:
    """docs: doc_id, text. labels: doc_id, label 0 or 1; only these rows are learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    labels = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    have = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    u = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("label") == 1, F.lit(s.per_class / max(1, have.get(1, 0)))).otherwise(F.lit(s.per_class / max(1, have.get(0, 0))))
    # about 2 * per_class rows of two numbers, whatever the table's size; the limit is the proof
    sample = F.broadcast(labels.where(u < share).limit(4 * s.per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in text_slices(batch.column(1)):
                x, bound = encode_inputs(buf, off, s.passage_words)
                some = [spaced(bound[k], bound[k + 1], s.train_passages) for k in range(b - a)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "label": batch.column(2).slice(a, b - a), "x": pa.array([x[k].tobytes() for k in some], pa.binary())})

    got: pd.DataFrame = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, x binary").toPandas()
    got = got.sort_values(["doc_id", "label", "x"], kind="stable")
    bags = [np.frombuffer(x, np.float32).reshape(-1, WIDTH) for x in got["x"]]
    return fit(bags, got["label"].to_numpy(float), s)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, buf, off in text_slices(batch.column(1)):
                x, bound = encode_inputs(buf, off, m.words_each)
                score, _ = m.forward(x, bound)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "score": pa.array(score), "n_passages": pa.array(np.diff(bound).astype(np.int64)), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, n_passages long, predicted int")
