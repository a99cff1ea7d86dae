"""Quality by a generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles, one feature at a time, on quantile-binned features; the sum
of a feature's trees is a lookup table over its bins. Then pairs are ranked by the gain of a
four-leaf tree on the residuals, and the best ones get two-dimensional tables in the same way.
A document's score is the logistic of the added bin values: one gather per table, for a whole
batch at once.

Features are counts of characters, words, sentences and lines of the whole text, nothing else.
Defined cases: null and empty texts get the features of an empty text; without two classes of
labels every score is the base rate (or 1 without labels, so nothing is rejected); repeated rows
get the same score; an id with labels of both classes is left out of training, and of training
rows with one id one is taken; texts of any length are read whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, crc_mod, held_out, labelled_sample, map_rows, share, shared_value, sigmoid

#: At most so many labelled rows (and SAMPLE_BYTES bytes of them) are fetched to fit the model.
TRAIN_ROWS = 6000
BINS, PAIR_BINS = 24, 6
ROUNDS, PAIR_ROUNDS, RATE, PAIRS = 120, 60, 0.15, 6
THRESHOLD = 0.7
RESULT = "doc_id long, score double, predicted int"

FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "bars", "exclaims", "stops", "commas", "wide",
    "word_variety", "pair_variety", "sentence_variety", "sentence_words", "line_variety", "line_words", "longest_word",
)
# Classes of bytes, by value: upper, digit, symbol, bar, exclamation, stop, comma, beyond ASCII.
BYTE_CLASS = np.zeros(256, np.uint8)
BYTE_CLASS[65:91] = 1
BYTE_CLASS[48:58] = 2
BYTE_CLASS[list(b"#$%&*+<=>@\\^_`{}~[]/")] = 3
BYTE_CLASS[list(b"|")] = 4
BYTE_CLASS[list(b"!")] = 5
BYTE_CLASS[list(b".?")] = 6
BYTE_CLASS[list(b",;:")] = 7
BYTE_CLASS[128:] = 8


def variety(parts: list) -> float:
    return len(set(parts)) / len(parts) if parts else 1.0


def describe(text: str | None) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    n = max(1, len(raw))
    counts = np.bincount(BYTE_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) / n
    words = raw.split()
    sentences = [s for s in raw.replace(b"\n", b".").split(b".") if s]
    lines = [s for s in raw.split(b"\n") if s]
    n_words = max(1, len(words))
    return [
        np.log1p(len(words)), (len(raw) - raw.count(b" ")) / n_words, *counts[1:],
        variety(words), variety(list(zip(words, words[1:]))), variety(sentences), len(words) / max(1, len(sentences)),
        variety(lines), len(words) / max(1, len(lines)), float(max(map(len, words), default=0)),
    ]


@dataclass
class Tables:
    """Bin edges and lookup tables: all that scoring needs."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    single: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.single):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return sigmoid(total)


def quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Best splits of the ordered bins into at most ``leaves`` leaves, greedily; values by bin."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    gain_of = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = gain_of(a, k) + gain_of(k, b) - gain_of(a, b)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), int(k[at]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best four-leaf tree over a grid: one cut along either axis. Gain and values by cell."""
    cg = np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    ch = cg.copy()
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best = (-1.0, np.zeros_like(g))
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            gs = (cg[i, j], cg[i, -1] - cg[i, j], cg[-1, j] - cg[i, j], cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j])
            hs = (ch[i, j], ch[i, -1] - ch[i, j], ch[-1, j] - ch[i, j], ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j])
            gain = sum(a * a / (b + 1.0) for a, b in zip(gs, hs))
            if gain > best[0]:
                v = [leaf(a, b) for a, b in zip(gs, hs)]
                values = np.empty_like(g)
                values[:i, :j], values[:i, j:], values[i:, :j], values[i:, j:] = v
                best = (gain, values)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Tables:
    if not len(y):
        return Tables(base=35.0)
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Tables(base=float(np.log(rate / (1 - rate))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [quantile_edges(x[:, j], BINS) for j in range(x.shape[1])]
    model.pair_edges = [quantile_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.single = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j, own in enumerate(binned):
            p = sigmoid(total)
            n = len(model.single[j])
            step = RATE * shallow_tree(np.bincount(own, y - p, n), np.bincount(own, p * (1 - p), n))
            model.single[j] += step
            total += step[own]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        cell = coarse[a] * shape[1] + coarse[b]
        p = sigmoid(total)
        size = shape[0] * shape[1]
        return cell, np.bincount(cell, y - p, size).reshape(shape), np.bincount(cell, p * (1 - p), size).reshape(shape)

    ranked = sorted(((quadrants(*grids(a, b)[1:])[0], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
    chosen = [(a, b) for gain, a, b in ranked[:PAIRS] if gain > 0]
    tables = {pair: np.zeros((len(model.pair_edges[pair[0]]) + 1, len(model.pair_edges[pair[1]]) + 1)) for pair in chosen}
    for _ in range(PAIR_ROUNDS):
        for pair in chosen:
            cell, g, h = grids(*pair)
            step = RATE * quadrants(g, h)[1]
            tables[pair] += step
            total += step.ravel()[cell]
    model.pairs = [(a, b, t) for (a, b), t in tables.items()]
    return model


class Score:
    def __init__(self, shared):
        self.shared = shared

    def start(self):
        model = shared_value(self.shared)

        def work(doc_id, text):
            score = model.score(np.array([describe(t) for t in text]))
            return {"doc_id": doc_id, "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

        return work


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Tables:
    rows = labelled_sample(docs, labels, "quality", ~crc_mod("doc_id", 4, 2), limit)
    x = np.array([describe(t) for t, _, _ in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([y for _, y, _ in rows], float))


def score(docs: DataFrame, model: Tables) -> DataFrame:
    shared = share(docs.sparkSession, model)
    return map_rows(columns(docs, doc_id="long", text="string"), Score(shared), RESULT)


def quality(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """Fit on labelled rows outside the held-out quarter, then score all rows."""
    plain = columns(docs, doc_id="long", text="string")
    model = train(plain, columns(labels, doc_id="long", quality="int"), limit)
    return score(plain, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


class Keep:
    """Passes the rows that the model accepts, with all their columns."""

    def __init__(self, shared, names: list[str]):
        self.shared, self.names = shared, names

    def start(self):
        model = shared_value(self.shared)

        def work(**cols):
            score = model.score(np.array([describe(t) for t in cols["text"]]))
            at = np.flatnonzero(score >= THRESHOLD).tolist()
            return {name: [values[k] for k in at] for name, values in cols.items()}

        return work


def keep_good(docs: DataFrame, model: Tables) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``THRESHOLD``, columns unchanged."""
    return map_rows(docs, Keep(share(docs.sparkSession, model), docs.columns), docs.schema)
