"""Removal of word windows that also start in an earlier document, by level-wise doubling.

Levels: windows of half the target length are looked at first, and only those
that repeat in another document are extended to twice that length.

* Level 1 need not index every short window: any target window holds
  ``window // 2 + 1`` of them, and the one with the smallest hash is chosen by
  content alone, so equal target windows choose equal short windows.  Only the
  chosen ones (about 2 in ``window // 2``) are counted.
* Level 2 extends the survivors to target length.  Within a batch every window
  is settled at once against the batch's smallest document, so a window leaves a
  batch at most once however many documents hold it; the rest are held against the
  smallest document of their hash.
* Doubling ends at the target length, where removal is defined, or as soon as no
  candidate survives.

Whole documents that equal an earlier one skip both levels: each of their windows
starts there too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, as_bytes, fresh, map_batches
from ._words import each_text, sequence_hash, window_hashes

WINDOW = 50


def _chosen(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all short windows, and for each target window the index of the short one it chooses (leftmost smallest)."""
    half = window // 2
    short = window_hashes(h, half)
    span = window - half + 1
    if len(short) < span:
        return short, np.zeros(0, np.int64)
    return short, np.lib.stride_tricks.sliding_window_view(short, span).argmin(axis=1) + np.arange(len(short) - span + 1)


def _batch(columns: dict[str, pa.Array | np.ndarray | list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], list(columns))


def covered_spans(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, spans): array of (seq, start, length) word spans to remove, seq telling texts under one id apart.

    Only documents with something to remove have a row.  Ids must be integers;
    a document with a null id is neither smaller nor larger than others.
    """
    spark, half = docs.sparkSession, window // 2
    scratch = Scratch(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * window - 1))

    def level1(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = b.column("doc_id").to_numpy()
        out: dict[str, list] = {"h": [], "doc_id": [], "n": []}
        for i, h in each_text(as_bytes(b.column("text"))):
            if len(h) < window:
                continue
            short, pick = _chosen(h, window)
            got = np.unique(short[np.unique(pick)]).view(np.int64)
            out["h"] += [np.array([sequence_hash(h)]), got]
            out["doc_id"].append(np.full(len(got) + 1, ids[i]))
            out["n"].append(np.concatenate(([len(h)], np.zeros(len(got), np.int64))))
            if len(out["h"]) > 4000:
                yield _batch({k: np.concatenate(v) for k, v in out.items()})
                out = {k: [] for k in out}
        if out["h"]:
            yield _batch({k: np.concatenate(v) for k, v in out.items()})

    # n > 0: the whole document; n = 0: a chosen short window.
    marks = scratch.save(map_batches(docs, level1, "h long, doc_id long, n long"))
    repeated = marks.groupBy("h", "n").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    # A document's surviving marks; first: no smaller document has the same words.
    alive = marks.join(repeated, ["h", "n"]).groupBy("doc_id").agg(
        F.collect_list(F.when((F.col("n") > 0) & (F.col("doc_id") > F.col("low")), F.col("h"))).alias("copies"),
        F.collect_list(F.when(F.col("n") == 0, F.col("h"))).alias("short"),
    )
    alive = scratch.save(alive)
    scratch.drop(marks)
    scratch.release()
    state = alive.agg(F.count("*")).first()[0]
    empty = spark.createDataFrame([], "doc_id long, spans array<struct<seq:long,start:int,length:int>>")
    if not state:
        return empty

    def level2(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, copies, shorts = b.column("doc_id").to_numpy(), b.column("copies").to_pylist(), b.column("short")
        cols: list[list[np.ndarray]] = [[], [], [], []]
        done: list[tuple[int, int, int, int]] = []
        for i, h in each_text(as_bytes(b.column("text"))):
            seq = sequence_hash(h)
            if len(h) < window:
                continue
            if seq in copies[i]:
                done.append((ids[i], seq, 0, len(h)))
                continue
            short, pick = _chosen(h, window)
            live = np.asarray(shorts[i].values.to_numpy(zero_copy_only=False), np.int64)
            start = np.flatnonzero(np.isin(short.view(np.int64), live)[pick])
            for c, v in zip(cols, (window_hashes(h, window)[start].view(np.int64), np.full(len(start), ids[i]), np.full(len(start), seq), start.astype(np.int32)), strict=True):
                c.append(v)
        h, d, q, s = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
        order = np.lexsort((d, h))
        h, d, q, s = h[order], d[order], q[order], s[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        low = d[new][np.cumsum(new) - 1] if len(h) else d
        # Settled here: removed whatever other batches hold. Only the smallest document's windows go on.
        local = d > low
        mine = ~local
        for at in range(0, int(mine.sum()), 200_000):
            k = np.flatnonzero(mine)[at : at + 200_000]
            yield _batch({"h": pa.array(h[k]), "doc_id": pa.array(d[k]), "seq": pa.array(q[k]), "start": pa.array(s[k].astype(np.int32)), "length": pa.array(np.zeros(len(k), np.int32))})
        runs = pd.DataFrame({"d": d[local], "q": q[local], "s": s[local].astype(np.int64)}).sort_values(["d", "q", "s"])
        if len(runs):
            same = (runs["d"].diff() == 0) & (runs["q"].diff() == 0) & (runs["s"].diff() == 1)
            g = runs.groupby((~same).cumsum()).agg(d=("d", "first"), q=("q", "first"), s=("s", "first"), n=("s", "size"))
            done += list(zip(g["d"], g["q"], g["s"], g["n"] + window - 1, strict=True))
        if done:
            d, q, s, n = (np.array(x) for x in zip(*done, strict=True))
            yield _batch({"h": pa.array((q ^ s).astype(np.int64)), "doc_id": pa.array(d.astype(np.int64)), "seq": pa.array(q.astype(np.int64)), "start": pa.array(s.astype(np.int32)), "length": pa.array(n.astype(np.int32))})

    # Written before the next shuffles, so that those of the texts don't add up.
    wide = scratch.save(map_batches(docs.join(alive, "doc_id"), level2, "h long, doc_id long, seq long, start int, length int"))
    scratch.release()
    # The smallest document of each window is found by partial minima, so a window that many documents hold is no hot key.
    open_ = wide.where("length = 0")
    low = open_.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h", "low")
    later = open_.join(low, "h").where("doc_id > low").select("doc_id", "seq", "start", F.lit(window).alias("length"))
    spans = later.union(wide.where("length > 0").select("doc_id", "seq", "start", "length"))
    spans = scratch.save(spans.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "start", "length")).alias("spans")))
    scratch.drop_others(spans)
    return spans


def remove(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with ``text`` rid of covered words and columns n_words, n_removed (long) and kept_sha256 added.

    Texts that lose nothing are returned unchanged; others as kept words joined
    by one space.  Null text stays null, with no words.  Repeated rows and rows
    that share an id are separate documents that never cover one another.
    Existing columns of the three names are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    span_id, held = fresh(docs, "span_id", "spans")
    spans = covered_spans(docs, window, doc_id, text).select(F.col("doc_id").alias(span_id), F.col("spans").alias(held))
    joined = docs.join(spans, docs[doc_id].cast("long") == spans[span_id], "left").drop(span_id)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, n_words long, n_removed long, kept_sha256 string"

    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kept_text, n_words, n_removed, digests = [], [], [], []
        for raw, spans in zip(as_bytes(b.column(text)), b.column(held).to_pylist(), strict=True):
            words = (raw or b"").split()
            keep = None
            if spans:
                h = next(iter(each_text([raw])))[1]
                seq = sequence_hash(h)
                keep = np.ones(len(words), bool)
                for x in spans:
                    if x["seq"] == seq:
                        keep[x["start"] : x["start"] + x["length"]] = False
            n_words.append(len(words))
            if keep is None or keep.all():
                n_removed.append(0)
                kept_text.append(raw)
            else:
                n_removed.append(int((~keep).sum()))
                words = [words[k] for k in np.flatnonzero(keep)]
                kept_text.append(b" ".join(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        new = {text: pa.array(kept_text, pa.binary()).cast(pa.string())}
        columns = [new.get(f.name, b.column(i)) for i, f in enumerate(b.schema) if f.name != held]
        names = [f.name for f in b.schema if f.name != held]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests)], [*names, "n_words", "n_removed", "kept_sha256"])

    return map_batches(joined, cut, schema)
