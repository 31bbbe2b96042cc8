"""Histogram gradient boosting for squared error.

Features are binned once to a byte each.  Trees grow level by level from sums of
gradients and counts per node, feature and bin.

* Up to ROWS_IN_TASK rows, a number that bounds memory, a fold's table is one task's
  work: numpy histograms, the larger sibling by subtraction.
* Beyond that, the table stays where it is: each level is a job whose tasks pass on
  partial histograms; sums, running sums and the best split of every node are an
  aggregate, a window and an aggregate, so that only splits reach the driver.  After
  each tree, predictions are written with the rows: what is lost is a level at most.

Both give the same trees, but for the order in which doubles are added.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: Rows of up to 28 bytes of bins that one task holds.
ROWS_IN_TASK = 2_000_000
#: A split must gain more than this.
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Parameters:
    rounds: int = 200
    depth: int = 8
    step: float = 0.05
    least_rows: int = 5
    row_share: float = 0.8
    column_share: float = 0.8
    ridge: float = 1.0
    bins: int = 256
    seed: int = 42


@dataclass
class Trees:
    """Trees as full binary arrays: node k has kids 2k + 1 (below the cut) and 2k + 2; feature -1 is a leaf."""

    names: list[str]
    base: float
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cuts: list[np.ndarray] = field(default_factory=list)

    def predict(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        """Predictions for rows of raw features."""
        out, trees = np.empty(len(x)), np.arange(len(self.feature))
        for at in range(0, len(x), block):
            part = x[at : at + block]
            node, rows = np.zeros((len(part), len(trees)), np.int64), np.arange(len(part))[:, None]
            for _ in range(self.depth):
                f = self.feature[trees, node]
                right = part[rows, np.maximum(f, 0)] >= self.cut[trees, node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            out[at : at + block] = self.base + self.value[trees, node].sum(axis=1)
        return out

    def nodes(self) -> list[tuple[int, int, str | None, float, float]]:
        """(tree, node, feature, cut, value) of all nodes that rows can reach."""
        out = []
        for t in range(len(self.feature)):
            live = [0]
            while live:
                k = live.pop()
                f = int(self.feature[t, k])
                out.append((t, k, self.names[f] if f >= 0 else None, float(self.cut[t, k]), float(self.value[t, k])))
                if f >= 0:
                    live += [2 * k + 1, 2 * k + 2]
        return out


def quantile_cuts(table: DataFrame, names: list[str], bins: int) -> list[np.ndarray]:
    """Cuts between bins of about equal numbers of rows, by mergeable sketches in one aggregate."""
    at = [k / bins for k in range(1, bins)]
    told = table.agg(*(F.percentile_approx(F.col(c).cast("double"), at, 20_000).alias(c) for c in names)).first()
    return [np.unique(np.array(told[c] or [], float)) for c in names]


def binned(table: DataFrame, names: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """Rows (row, target, bins) from rows (row, target, features): bin k holds values from cut k - 1 to below cut k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.empty((b.num_rows, len(names)), np.uint8)
            for f, c in enumerate(cuts):
                codes[:, f] = np.searchsorted(c, b.column(2 + f).to_numpy(zero_copy_only=False).astype(float), side="right")
            yield pa.record_batch([b.column(0), b.column(1).cast(pa.float64()), pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(names)), b.num_rows, [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())], ["row", "target", "bins"])

    return table.select("row", "target", *names).mapInArrow(run, "row long, target double, bins binary")


def _codes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def chosen_rows(row: np.ndarray, tree: int, p: Parameters) -> np.ndarray:
    """Which rows a tree learns from: by hash of the row's number, so alike wherever the row is."""
    with np.errstate(over="ignore"):
        h = row.astype(np.uint64) + np.uint64((p.seed * 1_000_003 + tree) % (1 << 64)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h >> np.uint64(11)).astype(float) / float(1 << 53) < p.row_share


def chosen_columns(width: int, tree: int, p: Parameters) -> np.ndarray:
    return np.sort(np.random.default_rng([p.seed, tree]).choice(width, max(1, int(p.column_share * width)), replace=False))


def best_splits(g: np.ndarray, n: np.ndarray, p: Parameters) -> tuple[np.ndarray, ...]:
    """Per node of histograms (node, column, bin): gain, column, last bin on the left, and the left's sums; ties to the first."""
    gl, nl = np.cumsum(g, axis=2), np.cumsum(n, axis=2)
    total, rows = gl[:, :1, -1:], nl[:, :1, -1:]
    gr, nr = total - gl, rows - nl
    gain = gl * gl / (nl + p.ridge) + gr * gr / (nr + p.ridge) - total * total / (rows + p.ridge)
    gain = np.where((nl >= p.least_rows) & (nr >= p.least_rows), gain, -np.inf).reshape(len(g), -1)
    at = gain.argmax(axis=1)
    i = np.arange(len(g))
    return gain[i, at], at // g.shape[2], at % g.shape[2], gl.reshape(len(g), -1)[i, at], nl.reshape(len(g), -1)[i, at]


def fit_rows(row: np.ndarray, target: np.ndarray, bins: np.ndarray, base: float, p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, last left bin and value of every node, by tree, from rows in memory."""
    size, width = (2 << p.depth) - 1, bins.shape[1]
    feature, last, value = np.full((p.rounds, size), -1, np.int16), np.zeros((p.rounds, size), np.int16), np.zeros((p.rounds, size))
    columns, told = np.ascontiguousarray(bins.T), np.full(len(target), base)
    for t in range(p.rounds):
        use, g = chosen_columns(width, t, p), told - target
        sample = np.flatnonzero(chosen_rows(row, t, p))
        # A row's place among the nodes of its level; rows out of the sample follow, but aren't counted.
        node, gs = np.zeros(len(target), np.int64), g[sample]
        frontier = np.array([0])
        sums_g, sums_n = np.array([gs.sum()]), np.array([float(len(sample))])
        grown = None
        for depth in range(p.depth + 1):
            if depth == p.depth or not len(frontier):
                break
            at = node[sample]

            def histogram(which: np.ndarray, at=at, gs=gs, sample=sample, use=use) -> tuple[np.ndarray, np.ndarray]:
                """Sums of the nodes of the frontier that are named."""
                place = np.full(len(which), -1)
                place[which] = np.arange(which.sum())
                mine = place[np.maximum(at, 0)]
                keep = (at >= 0) & (mine >= 0)
                rows, key0, w = sample[keep], (mine[keep] << 8), gs[keep]
                hg, hn = np.empty((which.sum(), len(use), 256)), np.empty((which.sum(), len(use), 256))
                for j, f in enumerate(use):
                    key = key0 + columns[f][rows]
                    hg[:, j] = np.bincount(key, w, which.sum() << 8).reshape(-1, 256)
                    hn[:, j] = np.bincount(key, minlength=which.sum() << 8).reshape(-1, 256)
                return hg, hn

            if grown is None:
                hg, hn = histogram(np.ones(1, bool))
            else:  # kids stand in pairs: count the smaller one, take it from the parent for the other
                few = np.zeros(len(frontier), bool)
                few[np.arange(0, len(frontier), 2) + (sums_n[1::2] < sums_n[::2])] = True
                part_g, part_n = histogram(few)
                hg, hn = np.repeat(grown[0], 2, axis=0), np.repeat(grown[1], 2, axis=0)
                other = np.flatnonzero(few) ^ 1
                hg[other] -= part_g
                hn[other] -= part_n
                hg[few], hn[few] = part_g, part_n
            gain, column, bin_, gl, nl = best_splits(hg, hn, p)
            go = gain > LEAST_GAIN
            value[t, frontier[~go]] = -p.step * sums_g[~go] / (sums_n[~go] + p.ridge)
            feature[t, frontier[go]], last[t, frontier[go]] = use[column[go]], bin_[go]
            kids = np.stack((2 * frontier[go] + 1, 2 * frontier[go] + 2), axis=1).ravel()
            sums_g, sums_n = np.stack((gl, sums_g - gl), axis=1)[go].ravel(), np.stack((nl, sums_n - nl), axis=1)[go].ravel()
            place = np.where(go, np.cumsum(go) - 1, -1)
            inside = np.flatnonzero(node >= 0)
            was = node[inside]
            right = columns[np.maximum(feature[t, frontier[was]], 0), inside] > last[t, frontier[was]]
            node[inside] = np.where(place[was] >= 0, 2 * place[was] + right, -1)
            grown, frontier = (hg[go], hn[go]), kids
        value[t, frontier] = -p.step * sums_g / (sums_n + p.ridge)
        told += value[t, walk(feature[t], last[t], columns, p.depth)]
    return feature, last, value


def walk(feature: np.ndarray, last: np.ndarray, columns: np.ndarray, depth: int) -> np.ndarray:
    """The node of one tree at which each row of binned columns ends so far."""
    node, rows = np.zeros(columns.shape[1], np.int64), np.arange(columns.shape[1])
    for _ in range(depth):
        f = feature[node]
        node = np.where(f < 0, node, 2 * node + 1 + (columns[np.maximum(f, 0), rows] > last[node]))
    return node


def _packed(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, *arrays)
    return out.getvalue()


def _fit_in_task(table: DataFrame, width: int, base: float, p: Parameters) -> tuple[np.ndarray, ...]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), _codes(b.column(2), width)) for b in batches if b.num_rows]
        row, target, bins = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(row, kind="stable")
        yield pa.record_batch([pa.array([_packed(*fit_rows(row[order], target[order], bins[order], base, p))], pa.binary())], ["trees"])

    made = table.repartition(1).mapInArrow(run, "trees binary").first()["trees"]
    return tuple(np.load(io.BytesIO(bytes(made))).values())


def _fit_in_jobs(table: DataFrame, width: int, base: float, p: Parameters, space: Workspace) -> tuple[np.ndarray, ...]:
    size = (2 << p.depth) - 1
    feature, last, value = np.full((p.rounds, size), -1, np.int16), np.zeros((p.rounds, size), np.int16), np.zeros((p.rounds, size))
    rows = space.save(table.withColumn("told", F.lit(base)))
    for t in range(p.rounds):
        use, level, tree, cut = chosen_columns(width, t, p), {0}, feature[t].copy(), last[t].copy()
        for depth in range(p.depth):

            def sums(batches: Iterator[pa.RecordBatch], tree=tree.copy(), cut=cut.copy(), use=use, depth=depth, t=t) -> Iterator[pa.RecordBatch]:
                first = (1 << depth) - 1  # nodes of this level stand next to one another
                hg, hn = (np.zeros((len(use), 256 << depth)) for _ in range(2))
                for b in batches:
                    columns = np.ascontiguousarray(_codes(b.column(2), width).T)
                    node = walk(tree, cut, columns, depth)
                    keep = np.flatnonzero(chosen_rows(b.column(0).to_numpy(), t, p) & (node >= first))
                    g = (b.column(3).to_numpy() - b.column(1).to_numpy())[keep]
                    for j, f in enumerate(use):
                        key = (node[keep] - first << 8) + columns[f][keep]
                        hg[j] += np.bincount(key, g, 256 << depth)
                        hn[j] += np.bincount(key, minlength=256 << depth)
                j, key = np.nonzero(hn)
                yield pa.record_batch({"node": (key >> 8) + first, "feature": use[j].astype(np.int32), "bin": (key & 255).astype(np.int32), "g": hg[j, key], "n": hn[j, key]})

            told = rows.mapInArrow(sums, "node long, feature int, bin int, g double, n double").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
            one = Window.partitionBy("node", "feature").orderBy("bin")
            all_ = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            told = told.select("node", "feature", "bin", F.sum("g").over(one).alias("gl"), F.sum("n").over(one).alias("nl"), F.sum("g").over(all_).alias("g"), F.sum("n").over(all_).alias("n"))
            score = lambda g, n: F.expr(f"({g}) * ({g}) / ({n} + {p.ridge}D)")
            gain = F.when((F.col("nl") >= p.least_rows) & (F.col("n") - F.col("nl") >= p.least_rows), score("gl", "nl") + score("g - gl", "n - nl") - score("g", "n"))
            told = told.withColumn("gain", gain).groupBy("node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "nl", "g", "n")).alias("best"))
            level = set()
            for r in told.collect():  # at most a row per node of the level
                k, s = r["node"], r["best"]
                value[t, k] = -p.step * s["g"] / (s["n"] + p.ridge)
                if s["gain"] is not None and s["gain"] > LEAST_GAIN:
                    tree[k], cut[k] = -s["f"], -s["b"]
                    for kid, g, n in ((2 * k + 1, s["gl"], s["nl"]), (2 * k + 2, s["g"] - s["gl"], s["n"] - s["nl"])):
                        value[t, kid] = -p.step * g / (n + p.ridge)
                        level.add(kid)
            if not level:
                break
        feature[t], last[t] = tree, cut

        def add(batches: Iterator[pa.RecordBatch], tree=tree, cut=cut, leaf=value[t].copy()) -> Iterator[pa.RecordBatch]:
            for b in batches:
                node = walk(tree, cut, np.ascontiguousarray(_codes(b.column(2), width).T), p.depth)
                yield pa.record_batch([*b.columns[:3], pa.array(b.column(3).to_numpy() + leaf[node])], b.schema.names)

        rows = space.save(rows.mapInArrow(add, rows.schema))
        space.drop(space.n - 1)
    return feature, last, value


def fit(table: DataFrame, names: list[str], p: Parameters, space: Workspace, rows_in_task: int = ROWS_IN_TASK) -> Trees:
    """Trees for rows (row, target, features), of which none is null; row: any number that tells rows apart.

    An empty table gives trees that predict 0.
    """
    cuts = quantile_cuts(table, names, p.bins)
    n, base = table.agg(F.count("*"), F.avg("target")).first()
    size = (2 << p.depth) - 1
    feature, last, value = np.full((p.rounds, size), -1, np.int16), np.zeros((p.rounds, size), np.int16), np.zeros((p.rounds, size))
    if n:
        codes = binned(table, names, cuts)
        feature, last, value = _fit_in_task(codes, len(names), base, p) if n <= rows_in_task else _fit_in_jobs(codes, len(names), base, p, space)
    cut = np.zeros(feature.shape)
    for f, c in enumerate(cuts):
        cut[feature == f] = c[last[feature == f]]
    return Trees(names, float(base or 0.0), p.depth, feature, cut, value, cuts)
