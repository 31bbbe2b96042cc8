"""Embedding near-dedup: all pairs of equal label with cosine >= threshold, by cover trees traversed in pairs.

* Equal vectors of a label are one class with a weight.
* Classes are dealt to chunks of bounded size by nearest pivot (pivots: a bounded
  sample, farthest first), by ring of distance from it, and at random within a ring.
* Every chunk gets a cover tree: nested levels, centres of the finer level among them
  the coarser one's, radii halving, each node with its true covering radius.
* Two chunks meet only if their rings' distance bounds allow; then their trees are
  traversed together, and a pair of nodes is dropped when the distance of their
  centres exceeds both covering radii and the search radius together.  What is left
  is tested exactly, in double precision.
* A meeting returns links counted per class and a spanning forest of the links, so
  groups of near copies never leave as all their pairs.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, components

THRESHOLD = 0.98
CHUNK, LEAF = 768, 8
#: Classes sampled for pivots, over all labels.
SAMPLE, MOST_PIVOTS, RING = 4096, 48, 0.25
_SLACK = 1e-7


class Node:
    __slots__ = ("centre", "radius", "kids", "points")

    def __init__(self, centre: int, radius: float, kids: list, points: np.ndarray):
        self.centre, self.radius, self.kids, self.points = centre, radius, kids, points


def build(x: np.ndarray, points: np.ndarray | None = None, centre: int | None = None) -> Node:
    """Cover tree over unit vectors."""
    points = np.arange(len(x)) if points is None else points
    centre = int(points[0]) if centre is None else centre
    d = np.sqrt(np.maximum(2 - 2 * (x[points] @ x[centre]), 0))
    radius = float(d.max())
    if len(points) <= LEAF or radius < 1e-9:
        return Node(centre, radius, [], points)
    level = 2.0 ** (math.ceil(math.log2(radius)) - 1)
    kids, left, dist, c = [], points, d, centre
    while True:
        near = dist <= level
        kids.append((c, left[near]))
        left = left[~near]
        if not len(left):
            break
        c = int(left[dist[~near].argmax()])
        dist = np.sqrt(np.maximum(2 - 2 * (x[left] @ x[c]), 0))
    return Node(centre, radius, [build(x, p, c) for c, p in kids], points)


def traverse(a: Node, b: Node, x: np.ndarray, y: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into x, into y) that may be within ``reach``; for a tree with itself each pair once, i < j."""
    own = a is b
    out: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        if not p.kids and not q.kids:
            d = np.maximum(2 - 2 * (x[p.points] @ y[q.points].T), 0)
            i, j = np.nonzero(d <= (reach + _SLACK) ** 2)
            i, j = p.points[i], q.points[j]
            if own:
                keep = i != j if p is not q else i < j
                i, j = np.minimum(i, j)[keep], np.maximum(i, j)[keep]
            out.append((i, j))
            continue
        ps, qs = p.kids or [p], q.kids or [q]
        d = np.sqrt(np.maximum(2 - 2 * (x[[k.centre for k in ps]] @ y[[k.centre for k in qs]].T), 0))
        bound = np.array([k.radius for k in ps])[:, None] + np.array([k.radius for k in qs]) + reach + _SLACK
        for i, j in np.argwhere(d <= bound):
            if not (own and p is q) or i <= j:
                stack.append((ps[i], qs[j]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def exact(i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs whose cosine, in double precision, reaches the threshold."""
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 20_000):
        p, q = x[i[at : at + 20_000]], y[j[at : at + 20_000]]
        keep[at : at + 20_000] = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))) >= threshold
    return i[keep], j[keep]


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which changes no digit, so that squares neither overflow nor vanish."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])


def _unit(raw: np.ndarray) -> np.ndarray:
    big = np.abs(raw).max(axis=1, keepdims=True)
    z = raw / big
    return z / np.sqrt((z * z).sum(axis=1, keepdims=True))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(u), find(v)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((u, v))
    return out


def links(df: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero or hold a null or non-finite component, and
    vectors without a label, link with nothing; so do vectors of different length.
    Repeated rows and rows that share an id are vectors of their own, and link if
    similar.  A null id takes part like any other, links that lead through it count;
    its row bears the component of its partners and is kept only if alone.  An empty table gives an empty result.
    Other columns are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    e = F.col("embedding").cast("array<double>")
    good = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = df.select("vec_id", "label", "embedding", good.alias("good"))
    key = [F.when(F.col("good"), F.xxhash64("label", "embedding", F.lit(k))).alias(f"k{k}") for k in (1, 2)]
    rows = rows.select("*", *key)
    classes = rows.where("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = scratch.save(classes.withColumn("group", F.struct(F.col("label").cast("string").alias("label"), F.size("embedding").alias("dim"))))
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("k1", "k2"), "k1").limit(SAMPLE).select("group", "embedding").collect()
    by: dict[tuple, list] = {}
    for r in sample:
        by.setdefault((r["group"]["label"], r["group"]["dim"]), []).append(r["embedding"])
    pivots: dict[tuple, np.ndarray] = {}
    for g, got in by.items():
        x = _unit(np.array(got, np.float64))
        want = min(MOST_PIVOTS, len(x), max(1, round(len(x) / max(1, len(sample)) * total / chunk)))
        picked, near = [0], 2 - 2 * (x @ x[0])
        while len(picked) < want:
            picked.append(int(near.argmax()))
            near = np.minimum(near, 2 - 2 * (x @ x[picked[-1]]))
        pivots[g] = x[picked]
    # At most SAMPLE vectors: a bounded broadcast.
    pivots_ref = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups, vectors = b.column("group").to_pylist(), b.column("embedding").to_pylist()
            pivot, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            where: dict[tuple, list[int]] = {}
            for i, g in enumerate(groups):
                where.setdefault((g["label"], g["dim"]), []).append(i)
            for g, at in where.items():
                x, p = _unit(np.array([vectors[i] for i in at], np.float64)), pivots_ref.value.get(g)
                if p is None:
                    p = np.eye(1, x.shape[1])
                d = np.sqrt(np.maximum(2 - 2 * (x @ p.T), 0))
                pivot[at], far[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("k1", "k2", "weight", "group", "embedding")), pa.array(pivot), pa.array(far)], ["k1", "k2", "weight", "group", "embedding", "pivot", "far"])

    kind = classes.schema["embedding"].dataType.simpleString()
    placed = classes.mapInArrow(place, f"k1 long, k2 long, weight long, group struct<label:string,dim:int>, embedding {kind}, pivot int, far double")
    placed = scratch.save(placed.withColumn("ring", F.floor(F.col("far") / RING).cast("int")))
    rings = placed.groupBy("group", "pivot", "ring").agg(F.ceil(F.count("*") / chunk).cast("int").alias("salts"))
    cell = placed.join(rings, ["group", "pivot", "ring"]).withColumn("salt", F.pmod(F.xxhash64("k2", "k1"), F.col("salts")).cast("int"))
    cell = cell.withColumn("chunk", F.xxhash64("group", "pivot", "ring", "salt"))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k1")
        raw = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        far = pdf["far"].to_numpy()
        data = pickle.dumps((pdf["k1"].to_numpy(), pdf["weight"].to_numpy(), raw.astype(np.float32) if kind == "array<float>" else raw, build(_unit(raw))), protocol=5)
        g = pdf.iloc[0]["group"]
        return pd.DataFrame({"chunk": [int(key[0])], "label": [g["label"]], "dim": [int(g["dim"])], "pivot": [int(pdf.iloc[0]["pivot"])], "near": [float(far.min())], "far": [float(far.max())], "data": [data]})

    packs = scratch.save(cell.select("k1", "weight", "group", "embedding", "pivot", "far", "chunk").groupBy("chunk").applyInPandas(grow, "chunk long, label string, dim int, pivot int, near double, far double, data binary"))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    heads = packs.drop("data")
    gaps = [(g[0], g[1], i, j, float(np.sqrt(max(0.0, 2 - 2 * float(p[i] @ p[j]))))) for g, p in pivots.items() for i in range(len(p)) for j in range(len(p))]
    gaps = spark.createDataFrame(gaps, "label string, dim int, pivot int, pivot_b int, gap double") if gaps else spark.createDataFrame([], "label string, dim int, pivot int, pivot_b int, gap double")
    other = heads.select("label", "dim", F.col("chunk").alias("chunk_b"), F.col("pivot").alias("pivot_b"), F.col("near").alias("near_b"), F.col("far").alias("far_b"))
    met = heads.join(other, ["label", "dim"]).where("chunk <= chunk_b").join(F.broadcast(gaps), ["label", "dim", "pivot", "pivot_b"], "left").fillna(0.0, ["gap"])
    # Triangle inequality on distances from both pivots.
    met = met.where(f"gap - far - far_b <= {reach + _SLACK} AND near_b - far - gap <= {reach + _SLACK} AND near - far_b - gap <= {reach + _SLACK}")
    sides = met.select(F.struct("chunk", "chunk_b").alias("meeting"), F.explode(F.array_distinct(F.array("chunk", "chunk_b"))).alias("chunk"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [pickle.loads(d) for d in pdf.sort_values("chunk")["data"]]
        (ka, wa, xa, ta), (kb, wb, xb, tb) = got[0], got[-1]
        xa, xb = _scaled(xa.astype(np.float64)), _scaled(xb.astype(np.float64))
        own = len(got) == 1
        i, j = exact(*traverse(ta, ta if own else tb, _unit(xa), _unit(xb), reach), xa, xb, threshold)
        n = pd.concat([pd.DataFrame({"a": ka[i], "n": wb[j]}), pd.DataFrame({"a": kb[j], "n": wa[i]})]).groupby("a", as_index=False)["n"].sum()
        edges = pd.DataFrame(_forest(ka[i], kb[j]), columns=["a", "b"])
        return pd.concat([n.assign(b=0, edge=False), edges.assign(n=0, edge=True)]).astype({"a": "int64", "b": "int64", "n": "int64", "edge": bool})[["a", "b", "n", "edge"]]

    found = sides.join(packs.select("chunk", "data"), "chunk").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "meeting").groupBy("meeting").applyInPandas(meet, "a long, b long, n long, edge boolean")
    found = scratch.save(found)
    degree = found.where("not edge").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("k1"), "n")
    # Components of classes; each bears its smallest id.
    comp = components(scratch.save(found.where("edge").select("a", "b")), scratch)
    told = classes.select("k1", "weight", "low").join(degree, "k1", "left").join(comp.select(F.col("id").alias("k1"), "component"), "k1", "left")
    told = scratch.save(told.select("k1", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "k1").alias("all"), "low"))
    told = told.drop("low").join(told.groupBy("all").agg(F.min("low").alias("component_id")), "all").drop("all")
    out = rows.select("vec_id", "k1").join(told, "k1", "left")
    comp_id = F.coalesce("component_id", "vec_id").cast("long")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.col("vec_id").eqNullSafe(comp_id).alias("kept"))
