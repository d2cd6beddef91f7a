"""Quality classifier: a generalised additive model with pairwise interactions, fitted by cyclic boosting.

Each feature owns a lookup table over its bins. Boosting visits the features in turn and adds, to one table at a time,
a shallow tree (three leaves) fitted to the current residuals; afterwards the pairs of features with the largest
remaining structure get two-dimensional tables, boosted the same way with one cut on either axis. A score is the sum
of the table entries a document falls into, so scoring is a bin search and an addition for each table.

The model is fitted on a bounded sample of labelled rows (``sample``, by hash order of the ids); its features are
measured on whole texts. Every row is scored on its whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm._spark import ship
from gridweave.llm._text import LOWER, UPPER, raw

#: Labelled rows that a model is fitted on at most.
SAMPLE = 20_000
THRESHOLD = 0.7
FEATURES = ("words", "word_length", "upper", "digits", "punctuation", "symbols", "top_symbol", "different_words", "repeats", "top_word", "wordless", "line_words", "different_lines", "ended_lines", "short_words", "capitals", "sentence_words", "different_pairs", "beyond_ascii", "long_words")
_UPPER, _LOWER, _DIGITS = UPPER.encode(), LOWER.encode(), b"0123456789"
_ENDS, _MARKS, _SYMBOLS = b".,;:!?'\"()-", b"!?", b"#$%&*+/<=>@[\\]^_`{|}~"


def features(text: bytes) -> list[float]:
    """What a text looks like, by shares that do not name a word, a language or a source; zeros for an empty text."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    count = lambda these: size - len(text.translate(None, these))
    upper, letters = count(_UPPER), count(_UPPER + _LOWER)
    symbols = count(_SYMBOLS + _MARKS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    often = Counter(words)
    sizes = [len(w) for w in words]
    short = sum(s <= 3 for s in sizes)
    return [
        np.log1p(n),
        sum(sizes) / n,
        upper / max(1, letters),
        count(_DIGITS) / size,
        count(_ENDS) / n,
        symbols / n,
        max(text.count(bytes([c])) for c in _SYMBOLS + _MARKS) / n if symbols else 0.0,
        len(often) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        max(often.values()) / n,
        sum(not any(c > 64 for c in w) for w in often) / len(often),
        np.log1p(n / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines) / max(1, len(lines)),
        short / n,
        sum(w[:1].isupper() for w in words) / n,
        np.log1p(n / (1 + text.count(b".") + text.count(b"!") + text.count(b"?"))),
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        sum(len(w) - len(w.decode(errors="ignore")) for w in often) / max(1, sum(map(len, often))),
        sum(s > 20 for s in sizes) / n,
    ]


@dataclass
class AdditiveModel:
    """cuts: each feature's bin edges. single: a table each. pairs: (i, j, table) over coarse bins of two features."""

    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def decide(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for i, (cuts, table) in enumerate(zip(self.cuts, self.single, strict=True)):
            out += table[np.searchsorted(cuts, x[:, i], side="right")]
        for i, j, table in self.pairs:
            out += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.decide(x), -30, 30)))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) if len(v) else np.zeros(0)


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The gain and place of the best cut of a histogram of gradients and curvatures."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of at most three leaves over a feature's bins, as the value of each bin."""
    leaves = [(0, len(g))]
    for _ in range(2):
        cuts = [(*_best_cut(g[a:b], h[a:b], ridge), a, b) for a, b in leaves]
        gain, at, a, b = max(cuts)
        if gain <= 1e-12:
            break
        leaves = [x for x in leaves if x != (a, b)] + [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut on one axis with one cut of its own on either side along the other: gain and values."""
    best = (0.0, np.zeros(g.shape))
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, a.shape[0]):
            values, gain = np.zeros(a.shape), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                gs, hs = a[part].sum(axis=0), b[part].sum(axis=0)
                more, at = _best_cut(gs, hs, ridge)
                gain += more + gs.sum() ** 2 / (hs.sum() + ridge)
                for side in (slice(0, at), slice(at, None)):
                    values[part, side] = gs[side].sum() / (hs[side].sum() + ridge)
            if gain > best[0]:
                best = (gain, values if axis == 0 else values.T)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 30, pairs: int = 6, bins: int = 64, coarse: int = 8, rate: float = 0.1, ridge: float = 2.0) -> AdditiveModel:
    """A model of y (0 or 1) on x. With no rows, or one class only, it scores the class's (smoothed) share everywhere."""
    width = x.shape[1]
    model = AdditiveModel([_edges(x[:, i], bins) for i in range(width)], [_edges(x[:, i], coarse) for i in range(width)])
    share = (y.sum() + 1) / (len(y) + 2)
    model.base = float(np.log(share / (1 - share)))
    model.single = [np.zeros(len(c) + 1) for c in model.cuts]
    if not len(y) or y.min() == y.max():
        return model
    at = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(model.cuts)]
    f = np.full(len(y), model.base)
    slope = lambda: (y - (p := 1 / (1 + np.exp(-f))), np.maximum(p * (1 - p), 1e-6))
    for _ in range(rounds):
        for i in range(width):
            g, h = slope()
            n = len(model.single[i])
            step = rate * _tree(np.bincount(at[i], g, n), np.bincount(at[i], h, n), ridge)
            model.single[i] += step
            f += step[at[i]]
    low = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(model.coarse)]
    shape = lambda i, j: (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        s = shape(i, j)
        return np.bincount(low[i] * s[1] + low[j], v, s[0] * s[1]).reshape(s)

    g, h = slope()
    chosen = sorted(combinations(range(width), 2), key=lambda p: -_cross(sums(*p, g), sums(*p, h), ridge)[0])[:pairs]
    tables = {p: np.zeros(shape(*p)) for p in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            g, h = slope()
            step = rate * _cross(sums(i, j, g), sums(i, j, h), ridge)[1]
            tables[i, j] += step
            f += step[low[i], low[j]]
    model.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return model


def _matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = _matrix(raw(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), b.column("quality"), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(x.shape[1]))], ["id", "th", "quality", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """Fits on labelled rows of ``docs`` whose crc32(doc_id as text) mod 4 is not 2, ``sample`` of them at most.

    Only the sample's ids (a bounded number) are broadcast, and only the measured features of ``sample`` rows reach the
    driver, however many rows share an id. Labels that are null, or whose id is null or missing in ``docs``, teach
    nothing; of repeated labels each counts, of rows with one id and one text the first.
    """
    ship(docs.sparkSession)
    learn = labels.filter("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("double").alias("quality"))
    learn = learn.filter(F.crc32(F.col("__id").cast("string")) % 4 != 2).orderBy(F.xxhash64("__id"), "__id", "quality").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = rows.join(F.broadcast(learn), "__id").select(F.col("__id").alias("id"), F.xxhash64("text").alias("th"), "text", "quality")
    seen = met.mapInArrow(_measured, "id long, th long, quality double, " + ", ".join(f"{f} double" for f in FEATURES)).withColumn("__of", F.xxhash64("id", "th"))
    once = seen.join(F.broadcast(learn.groupBy(F.col("__id").alias("id"), "quality").agg(F.count("*").alias("times"))), ["id", "quality"])
    once = once.dropDuplicates(["id", "th", "quality"]).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    got = once.orderBy("__of", "id", "th", "quality").limit(sample).select("quality", *FEATURES).toArrow()
    table = np.stack([c.to_numpy() for c in got.columns], axis=1) if got.num_rows else np.zeros((0, len(FEATURES) + 1))
    table = table[np.lexsort(table.T)]  # the same fit for any order of the rows
    return fit(table[:, 1:], table[:, 0])


def _scored(batches: Iterable[pa.RecordBatch], model: AdditiveModel, text: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        score = model.score(_matrix(raw(b.column(text))))
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in b.schema.names), pa.array(score)], [*b.schema.names, "__score"])


def with_score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """``docs`` with ``__score``: between 0 and 1, higher where label 1 is likelier. Nulls score as empty texts."""
    ship(docs.sparkSession)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", __score double"
    return docs.mapInArrow(lambda it: _scored(it, model, "text"), schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold`` on) for every row of ``docs``.

    A null doc_id is held out, as no label can be its own. Repeated rows score alike. With no usable labels every row
    scores one half. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_score(rows, train(docs, labels, sample))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))
