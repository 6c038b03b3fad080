"""Quality scores by a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins and each chosen pair of features has one over pairs of coarser bins.
The tables are learned by cyclic boosting: feature by feature, a shallow tree is fitted to the current residuals and
its leaf values are added to the table. A score is the logistic of the sum of the looked-up values.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learns, map_texts

#: Labelled rows that the model is fitted on: those with the smallest hash of the id.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 200, 60, 0.15
THRESHOLD = 0.7

FEATURES = [
    "log_chars", "log_words", "word_length", "upper", "digit", "punctuation", "bang", "bar", "symbol", "high_byte", "newline",
    "stop_marks", "unique_words", "repeated_words", "unique_lines", "line_words", "short_words", "long_words", "upper_words", "marked_words",
]
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
_MARKS = np.zeros(256, bool)
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SYMBOLS = [ord(c) for c in "#$%&*<>=@^~\\_{}[]"]


def features(texts: list[str | None]) -> np.ndarray:
    """One row of FEATURES for each text; all zero for a null or empty one. Whole texts are read."""
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        raw = text.encode()
        n = len(raw)
        h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words, lines = text.split(), text.split("\n")
        k = max(1, len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        marks = h[_MARKS].sum()
        row[:] = (
            np.log1p(n), np.log1p(len(words)), lengths.sum() / k, h[_UPPER].sum() / n, h[_DIGIT].sum() / n, marks / n, h[33] / n, h[124] / n, h[_SYMBOLS].sum() / n, h[128:].sum() / n, h[10] / n,
            (h[46] + h[44]) / k, len(set(words)) / k, sum(map(eq, words, words[1:])) / k, len(set(lines)) / len(lines), k / len(lines), (lengths <= 3).sum() / k, (lengths >= 12).sum() / k, sum(map(str.isupper, words)) / k, marks / k,
        )
    return out


@dataclass
class Model:
    """Bin edges and tables; score() is vectorised over rows."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, j], side="right")]
        for (a, b), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray) -> int:
    """Best number of bins left of a split, 0 if no split gains."""
    if len(g) < 2:
        return 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    best = int(np.argmax(gains))
    return best + 1 if gains[best] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value for each bin of a tree of the given depth over one feature's histogram."""
    at = _split(g, h) if depth else 0
    if not at:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf value for each cell of a tree that cuts one axis and then each half along the other; and its gain."""
    best, most = np.zeros_like(g), -1.0
    for turn in (0, 1):
        a, b = (g, h) if not turn else (g.T, h.T)
        at = _split(a.sum(1), b.sum(1)) or 1
        values, gain = np.empty_like(a), 0.0
        for rows in (slice(0, at), slice(at, len(a))):
            ga, hb = a[rows].sum(0), b[rows].sum(0)
            cut = _split(ga, hb)
            for cols in (slice(0, cut), slice(cut, a.shape[1])):
                values[rows, cols] = _leaf(ga[cols].sum(), hb[cols].sum())
                gain += _gain(ga[cols].sum(), hb[cols].sum())
        if gain > most:
            best, most = (values if not turn else values.T), gain
    return best, most


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting over bounded rows; without both labels the model is constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(bias=float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    m = x.shape[1]
    model.edges = [_edges(x[:, j], BINS) for j in range(m)]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.bias)
    for _ in range(ROUNDS):
        for j in range(m):
            p = 1 / (1 + np.exp(-total))
            k = len(model.tables[j])
            step = RATE * _tree(np.bincount(binned[j], y - p, k), np.bincount(binned[j], p * (1 - p), k))
            model.tables[j] += step
            total += step[binned[j]]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(m)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    widths = [len(e) + 1 for e in model.pair_edges]

    def cells(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        at = coarse[a] * widths[b] + coarse[b]
        shape = (widths[a], widths[b])
        return at, np.bincount(at, y - p, widths[a] * widths[b]).reshape(shape), np.bincount(at, p * (1 - p), widths[a] * widths[b]).reshape(shape)

    gains = {(a, b): _pair_tree(*cells(a, b)[1:])[1] for a in range(m) for b in range(a + 1, m)}
    model.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]
    model.pair_tables = [np.zeros((widths[a], widths[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for values, (a, b) in zip(model.pair_tables, model.pairs, strict=True):
            at, g, h = cells(a, b)
            step = RATE * _pair_tree(g, h)[0]
            values += step
            total += step.ravel()[at]
    return model


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id and its features (array of double) for each row of docs (doc_id, text)."""
    return map_texts(docs.select("doc_id", "text"), lambda rows: {"doc_id": rows["doc_id"], "x": list(features(rows["text"]))}, "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `rows` labelled documents (doc_id, text; doc_id, quality), chosen by a hash of their ids.

    Ids are chosen without texts; null labels and unlabelled documents don't count, an id with both labels counts as 0.
    """
    marked = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    wanted = {r.doc_id: r.quality for r in chosen.collect()}
    if not wanted:
        return Model()
    ids = docs.sparkSession.createDataFrame([(i,) for i in wanted], "doc_id long")  # bounded by `rows`
    found = feature_rows(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")).collect()
    found = sorted(found, key=lambda r: (r.doc_id, r.x))
    return fit(np.array([r.x for r in found]), np.array([float(wanted[r.doc_id] > 0) for r in found]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (1 from the threshold on) for each row of docs (doc_id, text).

    Null and empty texts are scored like any other, by features that are all zero. Repeated rows are scored each; an
    empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: dict[str, list]) -> dict[str, list]:
        s = shared.value.score(features(rows["text"])).tolist()
        return {"doc_id": rows["doc_id"], "score": s, "predicted": [int(x >= threshold) for x in s]}

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def train_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score() for all rows, trained on those that may be learned from; adds held_out."""
    model = train(docs.where(learns()), labels.where(learns()))
    return score(docs, model).withColumn("held_out", ~learns()).select("doc_id", "held_out", "score", "predicted")
