"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; boosting goes round the features, fitting a
shallow tree to the current residuals of one feature at a time and adding it to that
feature's lookup table.  The strongest pairs of features then get small
two-dimensional tables in the same way.  A score is the sum of looked-up values.

The model is fitted on a bounded sample of labelled rows (``max_train``, by hash of
the id), whose features are small and go to the driver; all documents are scored
where they are, by vectorised binning and table additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import as_bytes, in_parts, remainder, training_rows
from ._words import chunks, window_hashes, word_hashes

#: Labelled documents of each class that the model is fitted on.
MAX_TRAIN = 10_000
BINS, ROUNDS, RATE, LEAVES, PAIRS, PAIR_BINS, PAIR_ROUNDS = 48, 120, 0.1, 4, 6, 8, 40

FEATURES = ["log_words", "word_bytes", "symbols", "capitals", "digits", "exclamations", "punctuation", "bars", "distinct", "repeated", "repeated_lines", "words_per_line", "short_words", "doubled"]

#: Fixed character classes of the ratio features.
_CLASSES = {"symbols": b"#*$%&<>", "capitals": bytes(range(65, 91)), "digits": b"0123456789", "exclamations": b"!", "punctuation": b".,;:?", "bars": b"|"}


def _tables() -> np.ndarray:
    out = np.zeros((len(_CLASSES), 256), np.uint8)
    for k, members in enumerate(_CLASSES.values()):
        out[k, list(members)] = 1
    return out


_MEMBERS = _tables()


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row of FEATURES for each text; all zero for a text without words."""
    out = np.zeros((len(texts), len(FEATURES)))
    for at, run in chunks(texts):
        h, first = word_hashes(run)
        buf = np.frombuffer(b"\n".join(run) + b"\n", np.uint8)
        starts = np.r_[0, np.cumsum([len(t) + 1 for t in run])[:-1]]
        n = np.diff(first)
        counts = [np.add.reduceat(m[buf], starts, dtype=np.int64) for m in _MEMBERS]
        white = np.add.reduceat(((buf == 32) | ((buf >= 9) & (buf <= 13))).view(np.uint8), starts, dtype=np.int64)
        inside = np.array([len(t) for t in run]) + 1 - white
        for i, t in enumerate(run):
            if not n[i]:
                continue
            w = h[first[i] : first[i + 1]]
            lines = [x for x in t.split(b"\n") if x.strip()]
            three = window_hashes(w, 3)
            _, c = np.unique(three, return_counts=True)
            row = out[at + i]
            row[0], row[1] = np.log1p(n[i]), inside[i] / n[i]
            row[2:8] = [counts[k][i] / max(1, inside[i]) for k in range(6)]
            row[8] = len(np.unique(w)) / n[i] ** 0.9
            row[9] = c[c > 1].sum() / max(1, len(three))
            row[10] = 1 - len(set(lines)) / max(1, len(lines))
            row[11] = n[i] / max(1, len(lines))
            row[12] = sum(len(x) <= 3 for x in t.split()) / n[i]
            row[13] = (w[1:] == w[:-1]).sum() / n[i]
    return out


class Additive:
    """Tables of the fitted model."""

    def __init__(self, edges: list[np.ndarray], base: float, single: list[np.ndarray], pair_edges: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]]):
        self.edges, self.base, self.single, self.pair_edges, self.pairs = edges, base, single, pair_edges, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.single):
            total += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], "right") for i, j, _ in self.pairs for f in (i, j)}
        for i, j, table in self.pairs:
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between quantiles, so that many equal values make one bin."""
    q = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1), method="nearest"))
    return (q[1:] + q[:-1]) / 2


def _tree(g: np.ndarray, w: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Leaf value of each bin: up to ``leaves`` intervals, each cut where the gain is largest."""
    G, W = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(w)]
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (W[b] - W[a] + 1.0)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = None
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            cut = np.arange(a + 1, b)
            ok = (W[cut] - W[a] >= least) & (W[b] - W[cut] >= least)
            if ok.any():
                got = np.where(ok, gain(a, cut) + gain(cut, b) - gain(a, b), -1)
                c = int(got.argmax())
                if got[c] > 1e-9 and (best is None or got[c] > best[0]):
                    best = (got[c], k, int(cut[c]))
        if best is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (G[b] - G[a]) / (W[b] - W[a] + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Additive:
    """Cyclic boosting on logistic loss; deterministic."""
    weight = np.ones(len(y)) if weight is None else weight
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else 3.0 * (2 * y.max() - 1)
        return Additive([np.zeros(0)] * x.shape[1], base, [np.zeros(1)] * x.shape[1], [], [])
    edges = [_edges(x[:, f], BINS) for f in range(x.shape[1])]
    bins = [np.searchsorted(edges[f], x[:, f], "right") for f in range(x.shape[1])]
    single = [np.zeros(len(e) + 1) for e in edges]
    mean = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    total = np.full(len(y), base)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            r, h = residuals()
            step = RATE * _tree(np.bincount(b, r, len(single[f])), np.bincount(b, h, len(single[f])), LEAVES, 1.0)
            single[f] += step
            total += step[b]
    coarse_edges = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    coarse = [np.searchsorted(coarse_edges[f], x[:, f], "right") for f in range(x.shape[1])]

    def grid(i: int, j: int) -> tuple[np.ndarray, tuple[int, int], np.ndarray, float]:
        shape = (len(coarse_edges[i]) + 1, len(coarse_edges[j]) + 1)
        r, h = residuals()
        cell = coarse[i] * shape[1] + coarse[j]
        g, w = np.bincount(cell, r, shape[0] * shape[1]), np.bincount(cell, h, shape[0] * shape[1])
        return cell, shape, g / (w + 5.0), (g**2 / (w + 5.0)).sum()

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -grid(*p)[3])[:PAIRS]
    pairs = {p: None for p in ranked}
    for _ in range(PAIR_ROUNDS):
        for i, j in ranked:
            cell, shape, step, _ = grid(i, j)
            total += RATE * step[cell]
            pairs[i, j] = RATE * step.reshape(shape) + (0 if pairs[i, j] is None else pairs[i, j])
    return Additive(edges, base, single, coarse_edges, [(i, j, t) for (i, j), t in pairs.items()])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held_mod: int = 5, held_at: int = 0, max_train: int = MAX_TRAIN) -> Additive:
    """Fit on at most ``max_train`` labelled documents of each class outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            x = features(as_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    sample = docs.sparkSession.createDataFrame(training_rows(labels, label, held_mod, held_at, max_train).collect(), "doc_id long, y int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = rows.mapInArrow(run, "doc_id long, y int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit(np.array([r["r"]["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["r"]["y"] for r in rows], float))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", held_mod: int = 5, held_at: int = 0, max_train: int = MAX_TRAIN, threshold: float = 0.3) -> DataFrame:
    """The documents with held_out, score (0 to 1) and predicted (1 from ``threshold`` on) added.

    Null and empty texts have all features zero and are scored by the same tables.
    Null ids, repeated rows and unlabelled documents are scored like any other; an
    empty table gives an empty result; existing columns of the three names are
    replaced.  Without labels of both classes every score is the same.
    """
    docs = docs.drop("held_out", "score", "predicted")
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, held_mod, held_at, max_train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            s = model.value.score(features(as_bytes(b.column("text"))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.mapInArrow(run, f"{fields}, score double")
    return out.withColumns({"held_out": remainder("doc_id", held_mod) == held_at, "predicted": (F.col("score") >= threshold).cast("int")})
