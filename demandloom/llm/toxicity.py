"""Toxicity by class-conditional Kneser-Ney models.

Two models over the bytes of the lower-cased text, toxic and ordinary, score every
text; the score is the difference of their length-normalised log-likelihoods,
mapped to 0..1 by a logistic curve.  Bytes rather than words, so that inflected and
newly coined expressions of a family share evidence.

* The highest order (six bytes) has counts of its own per class, with absolute
  discounting by n1 / (n1 + 2 n2), so that a gram seen once keeps evidence.  The
  class models are fitted on a bounded sample of labelled rows, up to ``max_train``
  documents of each class by hash of the id.  A class with more rows knows more
  contexts, and pays more where a text leaves one; over whole texts the evidence of
  all rows outweighs that (README), but a text of a few words of the larger class in
  an unknown order may look like the smaller one.
* What a class has not seen backs off to lower orders that both share: Kneser-Ney
  continuation counts over *all* documents.  A rare expression that neither class
  has seen thus says nothing about toxicity.
* All tables are hashed.  Distinct contexts are counted by linear counting in bitmaps,
  which merge by OR; counts merge by addition.  Tables are four times as large until
  no more than ``MOST_LOAD`` of their cells are in use, so that unlike grams seldom
  meet whatever the vocabulary.  A first pass over all texts marks which of a fixed
  few cells of each table are in use at every size, and so finds that size; should
  the counted tables be fuller still, they are counted again.
* Tasks emit compressed pieces of the tables, which are merged piece by piece in
  sorted streams, first by salt, then all: no task holds more than a batch of pieces,
  however many tasks there are, and the driver gets the finished tables only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import as_bytes, in_parts, remainder, training_rows
from ._words import chunks, mix

ORDER = 6
GRAMS, CONTEXTS, LOW, LOW_CONTEXTS, PIECE = 1 << 21, 1 << 19, 1 << 18, 1 << 16, 1 << 13
#: Share of cells in use beyond which tables grow, and salts of the first merge.
MOST_LOAD, SALTS = 0.5, 64
#: Cells of each table that are watched to find its size (so many times the size), and the largest size they can tell.
WATCHED, MOST_SCALE = 1 << 13, 4**4
#: Documents of each class that the models are fitted on, and of both that the curve is fitted on.
MAX_TRAIN, MAX_CURVE = 10_000, 4_000
#: The absolute discount where the counts hold no singletons or no doubletons to estimate it from, and its bounds.
DISCOUNT, DISCOUNTS = 0.75, (0.1, 0.95)
#: At least so many bytes count as a text's length, so that a few bytes don't decide.
LEAST_BYTES = 100
#: The same for a word, and the log-likelihood differences from which an expression is a strong one.
LEAST_WORD_BYTES, STRONG = 6, (2.5, 5.0)



def tables(scale: int = 1) -> list[tuple[str, int, bool]]:
    """(table, entries, merged by OR). low: left neighbours of a 4-gram; around: neighbours on both sides of a 3-gram (4 words of bits each)."""
    own = [(f"{name}{c}", size * scale, ored) for c in (0, 1) for name, size, ored in (("gram", GRAMS, False), ("context", CONTEXTS, False), ("after", CONTEXTS, True))]
    return [("low", LOW * scale, True), ("around", 4 * LOW_CONTEXTS * scale, True), *own]


def load(t: dict[str, np.ndarray]) -> float:
    """The largest share of cells in use."""
    return max(float((t[name].reshape(-1, 4 if name == "around" else 1).any(axis=1)).mean()) for name in t if name != "after0" and name != "after1")


def _cell(x: np.ndarray, size: int) -> np.ndarray:
    return (mix(x) >> np.uint64(24)).astype(np.int64) & (size - 1)


class Grams:
    """Cells of every position of a run of texts that ends a gram of ORDER bytes inside one text."""

    def __init__(self, texts: list[bytes], scale: int = 1):
        # Each text stands after ORDER - 1 zero bytes, so that its first bytes have contexts too.
        pad = bytes(ORDER - 1)
        buf = np.frombuffer(b"".join(pad + t.lower() for t in texts), np.uint8).astype(np.uint64)
        self.length = np.array([len(t) for t in texts], np.int64)
        n = max(0, len(buf) - ORDER + 1)
        gram = np.zeros(n, np.uint64)
        for k in range(ORDER):
            gram = (gram << np.uint64(8)) | buf[k : k + n]
        begin = np.cumsum(self.length + ORDER - 1) - self.length - (ORDER - 1)
        keep = np.zeros(n + 1, np.int64)
        np.add.at(keep, begin[self.length > 0], 1)
        np.add.at(keep, (begin + self.length)[self.length > 0], -1)
        gram = gram[np.cumsum(keep)[:n] > 0]
        self.first = np.r_[0, np.cumsum(self.length)]
        low4, low3 = gram & np.uint64(0xFFFFFFFF), (gram >> np.uint64(8)) & np.uint64(0xFFFFFF)
        self.gram, self.context = _cell(gram, GRAMS * scale), _cell(gram >> np.uint64(8), CONTEXTS * scale)
        self.low, self.around = _cell(low4, LOW * scale), _cell(low3, LOW_CONTEXTS * scale)
        self.next, self.left = gram & np.uint64(0xFF), (gram >> np.uint64(32)) & np.uint64(0xFF)


def _bit(x: np.ndarray) -> np.ndarray:
    return np.uint64(1) << (mix(x + np.uint64(1)) & np.uint64(63))


class Counts:
    """Tables of one task."""

    def __init__(self, scale: int = 1):
        self.t = {name: np.zeros(size, np.uint64) for name, size, _ in tables(scale)}

    def add(self, g: Grams, labels: list[int | None]) -> None:
        """Texts, and for each its label if it is a training text."""
        np.bitwise_or.at(self.t["low"], g.low, _bit(g.left))
        both = mix(g.left * np.uint64(256) + g.next)
        np.bitwise_or.at(self.t["around"], 4 * g.around + (both & np.uint64(3)).astype(np.int64), _bit(both))
        for i, y in enumerate(labels):
            if y in (0, 1):
                # Once a document, so that no single document's repetitions weigh.
                _, once = np.unique(g.gram[g.first[i] : g.first[i + 1]], return_index=True)
                s = g.first[i] + once
                np.add.at(self.t[f"gram{y}"], g.gram[s], np.uint64(1))
                np.add.at(self.t[f"context{y}"], g.context[s], np.uint64(1))
                np.bitwise_or.at(self.t[f"after{y}"], g.context[s], _bit(g.next[s]))

    def pieces(self) -> Iterator[tuple[str, int, bytes]]:
        for name in self.t:
            for at in range(0, len(self.t[name]), PIECE):
                x = self.t[name][at : at + PIECE]
                if x.any():
                    yield name, at, zlib.compress(x.tobytes(), 1)


class Watched:
    """Which watched cells are in use: those whose low bits are 0, in tables MOST_SCALE times as large, which fold to smaller ones."""

    SHIFTS = {name: (size // WATCHED).bit_length() - 1 for name, size in (("low", LOW), ("around", LOW_CONTEXTS), ("gram0", GRAMS), ("gram1", GRAMS), ("context0", CONTEXTS), ("context1", CONTEXTS))}

    def __init__(self):
        self.t = {name: np.zeros(WATCHED * MOST_SCALE, bool) for name in self.SHIFTS}

    def _mark(self, name: str, cells: np.ndarray) -> None:
        shift = self.SHIFTS[name]
        self.t[name][cells[cells & ((1 << shift) - 1) == 0] >> shift] = True

    def add(self, g: Grams, labels: list[int | None]) -> None:
        """As Counts.add; g at MOST_SCALE."""
        self._mark("low", g.low)
        self._mark("around", g.around)
        for i, y in enumerate(labels):
            if y in (0, 1):
                self._mark(f"gram{y}", g.gram[g.first[i] : g.first[i + 1]])
                self._mark(f"context{y}", g.context[g.first[i] : g.first[i + 1]])

    def pieces(self) -> Iterator[tuple[str, int, bytes]]:
        for name, used in self.t.items():
            words = np.packbits(used).view(np.uint64)
            for at in range(0, len(words), PIECE):
                if words[at : at + PIECE].any():
                    yield name, at, zlib.compress(words[at : at + PIECE].tobytes(), 1)


def scale_of(words: dict[str, np.ndarray]) -> int:
    """The size at which no table has more than MOST_LOAD of its watched cells in use, by their packed bits."""
    used, scale = [np.unpackbits(x.view(np.uint8)) for x in words.values()], 1
    while scale < MOST_SCALE and max(u.reshape(-1, WATCHED * scale).any(axis=0).mean() for u in used) > MOST_LOAD:
        scale *= 4
    return scale


def merge(batches: Iterator[pa.RecordBatch], all_ored: bool = False) -> Iterator[pa.RecordBatch]:
    """One piece from each run of equal (name, at)."""
    ored = {name for name, _, o in tables() if o or all_ored}
    key, total = None, np.zeros(0, np.uint64)
    out = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["name", "at", "data"])
    for b in batches:
        for name, at, data in zip(*(b.column(c) for c in ("name", "at", "data")), strict=True):
            x = np.frombuffer(zlib.decompress(data.as_py()), np.uint64)
            if key == (name.as_py(), at.as_py()):
                total = total | x if key[0] in ored else total + x
            else:
                if key:
                    yield out()
                key, total = (name.as_py(), at.as_py()), x
    if key:
        yield out()


def _distinct(bits: np.ndarray) -> np.ndarray:
    """Linear counting: how many distinct values set these bits."""
    set_ = np.unpackbits(bits.view(np.uint8)).reshape(-1, 64).sum(axis=1)
    return -64 * np.log(np.maximum(64 - set_, 0.5) / 64)


def discount(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2), above 0 and below 1 whatever the counts: what a gram loses to backoff."""
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return float(np.clip(n1 / (n1 + 2 * n2), *DISCOUNTS)) if n1 and n2 else DISCOUNT


class Model:
    """What scoring needs, as float32 tables."""

    def __init__(self, t: dict[str, np.ndarray]):
        self.low = _distinct(t["low"]).astype(np.float32)
        self.around = np.maximum(_distinct(t["around"]).reshape(-1, 4).sum(axis=1), 1).astype(np.float32)
        self.gram, self.free = [], []
        # One discount for both classes, so that the same count weighs the same in both.
        d = discount(np.concatenate([t["gram0"], t["gram1"]]))
        for c in (0, 1):
            context = np.maximum(t[f"context{c}"].astype(np.float64), 1)
            self.gram.append((np.maximum(t[f"gram{c}"].astype(np.float64) - d, 0)).astype(np.float32))
            self.free.append((context.astype(np.float32), np.where(t[f"context{c}"] > 0, np.minimum(d * np.maximum(_distinct(t[f"after{c}"]), 1) / context, 1), 1).astype(np.float32)))

    def features(self, g: Grams) -> np.ndarray:
        """For each text: the difference of the log-likelihoods per byte of the whole text, the largest one of its
        expressions (words) per byte, and the excess of strongly toxic over strongly ordinary expressions."""
        # The lowest order spreads what continuation leaves over all byte values.
        shared = 0.9 * np.minimum(self.low[g.low] / self.around[g.around], 1) + 0.1 / 256
        p = [self.gram[c][g.gram] / self.free[c][0][g.context] + self.free[c][1][g.context] * shared for c in (0, 1)]
        out = np.zeros((len(g.length), 2 + len(STRONG)))
        if not len(shared):
            return out
        ratio = np.log(p[1].astype(np.float64)) - np.log(p[0].astype(np.float64))
        begins = (g.next == 32) | ((g.next >= 9) & (g.next <= 13))
        some = g.length > 0
        begins[g.first[:-1][some]] = True
        at = np.flatnonzero(begins)
        word = np.add.reduceat(ratio, at)
        each = word / np.maximum(np.diff(np.r_[at, len(ratio)]), LEAST_WORD_BYTES)
        text = np.searchsorted(at, g.first[:-1][some])
        out[some, 0] = np.add.reduceat(ratio, g.first[:-1][some]) / np.maximum(g.length[some], LEAST_BYTES)
        out[some, 1] = np.maximum.reduceat(each, text)
        for k, strong in enumerate(STRONG):
            excess = np.maximum(word - strong, 0) - np.maximum(-word - strong, 0)
            out[some, 2 + k] = np.arcsinh(np.add.reduceat(excess, text))
        return out


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of y on x by Newton's method, lightly regularised: intercept and slopes, and the scales."""
    scale = np.maximum(x.std(axis=0), 1e-9) if len(x) else np.ones(x.shape[1])
    beta = np.zeros(x.shape[1] + 1)
    if not len(y) or y.min() == y.max():
        beta[0] = 0.0 if not len(y) else 3.0 * (2 * y.max() - 1)
        return beta, scale
    z = np.c_[np.ones(len(x)), x / scale]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((z * w[:, None]).T @ z + 1e-2 * np.eye(len(beta)), z.T @ (y - p) - 1e-2 * beta)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return beta, scale


def curve(x: np.ndarray, fitted: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    beta, scale = fitted
    return 1 / (1 + np.exp(-np.clip(beta[0] + (x / scale) @ beta[1:], -30, 30)))


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_mod: int = 4, held_at: int = 2, max_train: int = MAX_TRAIN, max_curve: int = MAX_CURVE, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1) and predicted (1 from ``threshold`` on).

    Null and empty texts get the score of a text that speaks for neither class.
    Null ids, repeated rows and unlabelled documents are scored like any other; an
    empty table gives an empty result.  Without labels of both classes every score
    is the same.  Only id and text of documents are read; ids that are not bigint
    meet their labels as far as they can be cast to it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(doc_id).try_cast("long").alias("label_id"))
    # The bounded sample, at most 2 * (max_train + max_curve) small rows, goes to the driver and from there to all tasks.
    found = training_rows(labels, label, held_mod, held_at, max_train + max_curve // 2).collect()
    by = {y: [r["doc_id"] for r in found if r["y"] == y] for y in (0, 1)}
    share = max_curve / (2 * max_train + max_curve)
    fold = {i: zlib.crc32(b"curve%d" % i) < share * 2**32 for y in by for i in by[y]}
    train = {i: y for y in by for i in by[y] if not fold[i]}
    test = {i: y for y in by for i in by[y] if fold[i]}
    train_ref = spark.sparkContext.broadcast(train)

    def gathered(scale: int, sizes: dict[str, int], made: type[Counts] | type[Watched]) -> dict[str, np.ndarray]:
        """The tables of all texts, by name: Counts at scale, or Watched."""
        watch = made is Watched

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, some = Watched() if watch else Counts(scale), False
            for b in in_parts(batches):
                ids = b.column("label_id").to_pylist()
                for at, run in chunks(as_bytes(b.column("text"))):
                    some = True
                    counts.add(Grams(run, scale), [train_ref.value.get(i) for i in ids[at : at + len(run)]])
            if some:
                for name, at, data in counts.pieces():
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int32()), pa.array([data], pa.binary())], ["name", "at", "data"])

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return merge(batches, watch)

        kind = "name string, at int, data binary"
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        pieces = docs.mapInArrow(count, kind).withColumn("salt", F.spark_partition_id() % SALTS)
        pieces = pieces.repartition(parts, "name", "at", "salt").sortWithinPartitions("name", "at").select("name", "at", "data").mapInArrow(merged, kind)
        pieces = pieces.repartition(parts, "name", "at").sortWithinPartitions("name", "at").mapInArrow(merged, kind)
        out = {name: np.zeros(size, np.uint64) for name, size in sizes.items()}
        for r in pieces.collect():  # the finished tables: some 50 MB before compression
            x = np.frombuffer(zlib.decompress(r["data"]), np.uint64)
            out[r["name"]][r["at"] : r["at"] + len(x)] = x
        return out

    scale = scale_of(gathered(MOST_SCALE, dict.fromkeys(Watched.SHIFTS, WATCHED * MOST_SCALE // 64), Watched))
    while load(found_tables := gathered(scale, {name: size for name, size, _ in tables(scale)}, Counts)) > MOST_LOAD:
        scale *= 4
    model = spark.sparkContext.broadcast(Model(found_tables))

    def features(b: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([model.value.features(Grams(run, scale)) for _, run in chunks(as_bytes(b.column("text")))])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("label_id"), pa.array(list(features(b)), pa.list_(pa.float64()))], ["doc_id", "x"])

    keep = spark.createDataFrame([(i,) for i in test], "known long")
    rows = docs.join(F.broadcast(keep), F.col("label_id") == F.col("known"), "left_semi").mapInArrow(sample, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    fitted = fit_curve(np.array([r["x"] for r in rows]).reshape(-1, 2 + len(STRONG)), np.array([test[r["doc_id"]] for r in rows], float))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            if b.num_rows:
                s = curve(features(b), fitted)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    out = docs.mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", (remainder("doc_id", held_mod) == held_at).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
