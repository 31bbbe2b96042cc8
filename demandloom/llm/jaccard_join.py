"""Exact Jaccard join on word shingles with a size-aware heavy-light split.

* Documents with equal shingle sets are one class; everything below works on classes.
* All sets are ordered by one global order: frequent shingles last, by how frequent
  they are, all others by hash.  Frequencies are counted within tasks and summed over
  all of them; as any global order is valid, they decide cost only.
  Two sets with J >= t share an element of their prefixes of n - ceil(t n) + 1, and
  two elements of the prefixes one longer.
* Light sets (small) enumerate all 2-element subsets of the longer prefix: the
  subset is the key, so only sets that share two prefix elements ever meet.  Heavy
  sets put their prefix elements into inverted lists, and so do light sets large
  enough to have a heavy partner.  The boundary is where enumerating a set's subsets
  would cost more rows than scanning its lists, whose mean length is measured.
* Every posting says how many elements of its set stand before the key: if the key is
  the first that two sets share, these are in one of them only, which bounds the
  overlap (positional filter).
* Lists are read as a sorted stream, members with the fewest elements before the key
  first.  First every list's members are compared with its leader only, the first of
  about its size: the common original of near copies, which has next to no elements of
  its own.  Links become components.  Then the lists that still hold more than one
  component are gone through in full, pairs inside a component left out: they can't
  change the result, so no link between components is lost and no group of copies is
  ever expanded into all pairs.  A copy that isn't linked with its original has too
  many elements of its own to pass the positional filter with other copies, unless it
  shares some of those with them.
* A pair is first tested by counts in hashed cells, which bound the symmetric
  difference from below, then exactly on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, as_bytes, components, in_parts, map_batches
from ._words import each_text, mix, window_hashes

WIDTH = 5
THRESHOLD = Fraction(3, 4)
#: A shingle is reported once a task has met it this often in different sets; reported this often in all, it is ordered last; at most so many are.
HOT_IN_TASK, HOT, HOT_MOST = 3, 12, 1 << 19
#: Signatures that a task remembers, so that copies are counted once.
SEEN_MOST = 1 << 17
#: Up to so many ids are broadcast (8 bytes each); beyond that the join shuffles.
BROADCAST_IDS = 1_000_000
SUBSET_COST, SCAN_COST = 1.0, 1.0


def shingles(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes; shorter texts are one shingle, empty ones none."""
    return np.unique(window_hashes(h, min(width, len(h)))) if len(h) else np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> int:
    """64-bit hash of a set."""
    return int(mix(np.array([mix(s).sum() ^ np.uint64(len(s)), 0], np.uint64))[:1].view(np.int64)[0]) if len(s) else 0


def cells(s: np.ndarray) -> np.ndarray:
    """How many elements fall into each of a power of two of cells, about one for two elements; 255 stands for more."""
    size = 1 << max(6, (len(s) // 2).bit_length())
    return np.minimum(np.bincount((mix(s + np.uint64(77)) & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8)


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """Lower bound of the symmetric difference of two sets from their cells; the finer ones are folded (unless they may have overflowed)."""
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y) and x.max(initial=0) == 255:
        return 0
    x = x.astype(np.int32).reshape(-1, len(y)).sum(axis=0)
    return int(np.abs(np.minimum(x, 255) - y).sum())


class Frequencies:
    """About how often values were added lately, at bounded memory: the smaller of two hashed cells, all halved from time to time."""

    BITS, HALVE_AFTER = 24, 6_000_000

    def __init__(self):
        self.cells, self.added = np.zeros((2, 1 << self.BITS), np.uint8), 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Add distinct values so many times; their counts so far."""
        self.added += len(values)
        if self.added > self.HALVE_AFTER:
            self.cells >>= 1
            self.added = len(values)
        got = []
        for cells, h in zip(self.cells, (values, values << np.uint64(self.BITS)), strict=True):
            at = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
            cells[at] = np.minimum(cells[at] + counts, 255)
            got.append(cells[at])
        return np.minimum(*got)


def prefix_length(n: int, t: Fraction = THRESHOLD) -> int:
    return n - -(-n * t.numerator // t.denominator) + 1


def boundary(mean_list: float, t: Fraction = THRESHOLD) -> int:
    """Largest size whose 2-subsets cost no more rows than scanning its inverted lists."""
    n = 1
    while n < 10_000:
        p = prefix_length(n + 1, t)
        if (p + 1) * p / 2 * SUBSET_COST > p * (1 + mean_list) * SCAN_COST:
            break
        n += 1
    return n


def _rows(columns: list[tuple[str, list[np.ndarray]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for _, v in columns], [k for k, _ in columns])


def _some(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is among ids; null keys match, and ids are broadcast only when they are few enough."""
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return df.join(few, df[key].eqNullSafe(few[key]), "left_semi")


def classes(docs: DataFrame, scratch: Scratch, threshold: Fraction = THRESHOLD, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, links): one row (doc_id, n, sig) per document, n the size and sig the class of its set (n = 0: none),
    and linked pairs (a, b) of classes that connect every component of classes."""
    spark, t = docs.sparkSession, threshold
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = Frequencies(), set()
        for b in in_parts(batches):
            n, sig, bits, every, prefix = [], [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for _, h in each_text(as_bytes(b.column("text")), lower=True):
                s = shingles(h, width)
                n.append(len(s))
                sig.append(signature(s))
                bits.append(cells(s).tobytes() if len(s) else None)
                if len(s) and sig[-1] not in seen:
                    seen.add(sig[-1])
                    every.append(s)
                    prefix.append(s[: prefix_length(len(s), t)])
            if len(seen) > SEEN_MOST:
                seen.clear()
            rows = len(n)
            value, count = np.unique(np.concatenate(every), return_counts=True)
            hot = often.add(value, count) >= HOT_IN_TASK
            value, count = value[hot].view(np.int64), count[hot]
            flat = np.concatenate(prefix)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(bits, pa.binary()), pa.array(np.zeros(rows, np.int32))], ["doc_id", "n", "sig", "bits", "kind"])
            for v, c, kind in [(value, count, 1), (np.array([len(flat)]), np.array([len(np.unique(flat))]), 2)]:
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)), pa.array(c.astype(np.int64)), pa.nulls(len(v), pa.int64()), pa.nulls(len(v), pa.binary()), pa.array(np.full(len(v), kind, np.int32))], ["doc_id", "n", "sig", "bits", "kind"])

    told = scratch.save(docs.mapInArrow(describe, "doc_id long, n long, sig long, bits binary, kind int"))
    rows = told.where("kind = 0").drop("kind", "bits")
    hot = told.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("c")).where(F.col("c") >= HOT)
    hot = scratch.save(hot.select("doc_id", F.floor(4 * F.log2("c")).cast("int").alias("level")))
    # The most frequent levels that together are few enough, whatever the number of documents.
    least, room = None, HOT_MOST
    for level, c in hot.groupBy("level").count().orderBy(F.desc("level")).collect():
        room -= c
        if room < 0:
            break
        least = level
    found = hot.where(F.col("level") >= least).collect() if least is not None else []
    hot_list, hot_level = np.array([r[0] for r in found], np.int64).view(np.uint64), np.array([r[1] for r in found], np.int64)
    hot_order = np.argsort(hot_list)
    hot_list, hot_level = hot_list[hot_order], hot_level[hot_order]
    all_, distinct = told.where("kind = 2").agg(F.sum("doc_id"), F.sum("n")).first()
    edge = boundary((all_ or 0) / max(1, distinct or 1), t)

    def postings(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, cids, sizes, skips, before, between, seen = [], [], [], [], [], [], set()
        for _, h in each_text(as_bytes(b.column("text")), lower=True):
            s = shingles(h, width)
            if len(s) < 2:
                continue
            c = signature(s)
            if c in seen:
                continue
            seen.add(c)
            n = len(s)
            if len(hot_list):
                at = np.minimum(np.searchsorted(hot_list, s), len(hot_list) - 1)
                is_hot = hot_list[at] == s
                last = s[is_hot]
                s = np.concatenate((s[~is_hot], last[np.argsort(hot_level[at[is_hot]], kind="stable")]))
            p = prefix_length(n, t)
            key, skip, back = [], [], np.r_[np.uint64(0), s]  # back[i] stands before s[i]
            if n > edge or n * t.denominator > edge * t.numerator:
                key.append(s[:p])
                skip.append(np.arange(p))
                before.append(back[:p].view(np.int64))
                between.append(np.r_[np.uint64(0), back[: p - 1]].view(np.int64))
            if n <= edge:
                i, j = np.triu_indices(min(n, p + 1), 1)
                low, high = np.minimum(s[i], s[j]), np.maximum(s[i], s[j])
                key.append(mix(low * np.uint64(3) + mix(high)))
                skip.append(j - 1)
                before.append(back[i].view(np.int64))
                between.append(np.where(j - 1 > i, back[j], np.uint64(0)).view(np.int64))
            key = np.concatenate(key)
            keys.append(key.view(np.int64))
            skips.append(np.concatenate(skip).astype(np.int32))
            cids.append(np.full(len(key), c))
            sizes.append(np.full(len(key), n, np.int32))
        if keys:
            yield _rows([("key", keys), ("cid", cids), ("n", sizes), ("skip", skips), ("before", before), ("between", between)])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # skip: how many elements stand before the key, or between its two; before: the last that stands before it;
    # between: the one before the second element of a pair, unless that is its first, or, for single elements, the
    # last but one before it. 0: none.
    posting = "key long, cid long, n int, skip int, before long, between long"

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by (key, skip, n, cid). Keeps postings of lists with two classes at least, each with its leader:
        the first member of the list whose size allows a link with it. A member that begins with few
        elements of its own comes first, so a group's common original leads its copies."""
        held: list[np.ndarray] | None = None
        state: tuple[int, list[tuple[int, int, int]]] | None = None  # the last list's key and its leaders
        for b in batches:
            rows = [b.column(x).to_numpy() for x in ("key", "cid", "n", "skip", "before", "between")]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            k, c = rows[:2]
            keep = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
            rows = [x[keep] for x in rows]
            held = [x[-1:] for x in rows]  # its list may go on
            got, state = lead(*(x[:-1] for x in rows), rows[0][-1], state)
            if got is not None:
                yield got
        if held is not None:
            got, _ = lead(*held, None, state)
            if got is not None:
                yield got

    def lead(k, c, n, skip, before, between, after, state):
        if not len(k):
            return None, state
        goes_on = state is not None and k[0] == state[0]
        new = np.r_[not goes_on, k[1:] != k[:-1]]
        multi = np.r_[k[1:] == k[:-1], after == k[-1]] | ~new
        leader = np.zeros((3, len(k)), np.int64)
        size_ok = lambda x, y: (x * t.denominator >= y * t.numerator) & (y * t.denominator >= x * t.numerator)
        big, free, leaders = n.astype(np.int64), np.ones(len(k), bool), list(state[1]) if goes_on else []
        for one in leaders:
            at = np.flatnonzero(free & (k == k[0]))
            at = at[size_ok(big[at], one[1])]
            leader[:, at], free[at] = np.array(one)[:, None], False
        if k[-1] != k[0]:
            leaders = []
        # Leaders of a list differ by a quarter in size, so this takes few turns.
        while free.any():
            at = np.flatnonzero(free)
            first = at[np.r_[True, k[at][1:] != k[at][:-1]]]
            mine = first[np.searchsorted(first, at, "right") - 1]
            ok = size_ok(big[at], big[mine])
            leader[:, at[ok]], free[at[ok]] = np.stack([c[mine[ok]], big[mine[ok]], skip[mine[ok]]]), False
            if k[first[-1]] == k[-1]:
                leaders.append((int(c[first[-1]]), int(big[first[-1]]), int(skip[first[-1]])))
        ok = np.minimum(big - skip, leader[1] - leader[2]) * (t.numerator + t.denominator) >= (big + leader[1]) * t.numerator
        out = pa.RecordBatch.from_arrays([pa.array(x[multi]) for x in (k, c, n, skip, before, between, leader[0], ok)], ["key", "cid", "n", "skip", "before", "between", "leader", "ok"])
        return (out if multi.any() else None), (k[-1], leaders)

    posted = map_batches(docs, postings, posting).repartition(parts, "key").sortWithinPartitions("key", "skip", "n", "cid")
    shared = scratch.save(posted.mapInArrow(lists, f"{posting}, leader long, ok boolean"))

    one = told.where("kind = 0 AND n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("bits").alias("bits"), F.first("n").alias("n"))
    one = scratch.save(one)
    scratch.release()

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) of class ids that are links."""
        side = lambda x: one.select(F.col("sig").alias(x), F.col("bits").alias(f"bits_{x}"), F.col("n").alias(f"n_{x}"))

        def near(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            na, nb = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
            vectors = zip(b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist(), strict=True)
            least = np.array([apart(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) for x, y in vectors], np.int64)
            # J >= t means at most (1 - t) / (1 + t) of both sizes' sum differs.
            ok = least * (t.numerator + t.denominator) <= (na + nb) * (t.denominator - t.numerator)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])

        few = scratch.save(map_batches(pairs.join(side("a"), "a").join(side("b"), "b"), near, "a long, b long"))
        ends = few.select(F.col("a").alias("sig")).union(few.select(F.col("b").alias("sig"))).distinct()
        reps = scratch.save(one.join(ends, "sig", "left_semi").select("doc_id"))

        def full(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            got = [shingles(h, width) for _, h in each_text(as_bytes(b.column("text")), lower=True)]
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], ["sig", "items"])

        # Rows that share an id with a representative may come along; they are classes of their own, or repeated.
        sets = scratch.save(map_batches(_some(docs, reps, "doc_id"), full, "sig long, items binary").join(ends, "sig", "left_semi").dropDuplicates(["sig"]))
        a, b_ = sets.select(F.col("sig").alias("a"), F.col("items").alias("items_a")), sets.select(F.col("sig").alias("b"), F.col("items").alias("items_b"))

        def exact(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ok = []
            for x, y in zip(b.column("items_a").to_pylist(), b.column("items_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                ok.append(both * t.denominator >= (len(x) + len(y) - both) * t.numerator)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], ["a", "b"])

        out = scratch.save(map_batches(few.join(b_, "b").join(a, "a"), exact, "a long, b long"))
        scratch.drop(few, reps, sets)
        scratch.release()
        return out

    star = shared.where("leader <> cid").groupBy(F.col("leader").alias("a"), F.col("cid").alias("b")).agg(F.max("ok").alias("ok"))
    star = scratch.save(star)
    links = linked(star.where("ok").select("a", "b"))
    comp = scratch.save(components(links, scratch))
    label = lambda df, c: df.join(comp.select(F.col("id").alias(c), F.col("component").alias(f"{c}_comp")), c, "left").withColumn(f"{c}_comp", F.coalesce(f"{c}_comp", c))
    # Lists with more than one component: some member isn't in its leader's, or there is more than one leader.
    parted = label(label(star, "a"), "b").where("a_comp <> b_comp").select(F.col("a").alias("leader"), F.col("b").alias("cid"))
    keys = shared.join(parted, ["leader", "cid"], "left_semi").select("key").union(shared.groupBy("key").agg(F.min("leader").alias("x"), F.max("leader").alias("y")).where("x <> y").select("key")).distinct()
    members = scratch.save(label(shared.join(keys, "key", "left_semi").drop("leader", "ok"), "cid"))
    scratch.drop(shared, comp)
    scratch.release()
    counts = members.groupBy("key", "cid_comp").agg(F.count("*").alias("c"))
    largest = counts.groupBy("key").agg(F.max(F.struct("c", "cid_comp"))["cid_comp"].alias("major"), F.count("*").alias("comps")).where("comps > 1")
    named = lambda x: ["key", F.col("cid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "skip", "before", "between")), F.col("cid_comp").alias(f"{x}_comp")]
    other = members.select(*named("b"))
    minor = members.join(largest, "key").where("cid_comp <> major").select(*named("a"), "major")
    size_ok = f"n_a * {t.denominator} >= n_b * {t.numerator} AND n_b * {t.denominator} >= n_a * {t.numerator}"
    # What stands before a pair's first common key is in one set only.
    room_ok = f"least(n_a - skip_a, n_b - skip_b) * {t.numerator + t.denominator} >= (n_a + n_b) * {t.numerator}"
    # Among these an equal one is a common element before: the pair meets under an earlier key, too.
    first = "NOT (before_a <> 0 AND before_a IN (before_b, between_b)) AND NOT (between_a <> 0 AND between_a IN (before_b, between_b))"
    cross = minor.join(other, "key").where(f"a_comp <> b_comp AND (b_comp = major OR a < b) AND {size_ok} AND {room_ok} AND {first}")
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = star.where("ok").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = scratch.save(cross.join(tried, ["a", "b"], "left_anti"))
    scratch.drop(members, star)
    scratch.release()
    more = linked(cross)
    scratch.drop(cross)
    return rows, links.union(more)


def near_duplicates(docs: DataFrame, threshold: Fraction = THRESHOLD, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Null and empty texts and texts of white space have no shingles and are linked
    with nothing.  Rows that repeat an id are separate documents; equal texts are
    linked.  A document with a null id is compared like any other, links that lead
    through it count, and it bears the component of its partners, or null.  An empty
    table gives an empty result.  Other columns are ignored.  Only links that
    connect components are computed: neither all linked pairs nor their number is given.
    """
    scratch = Scratch(docs.sparkSession)
    rows, links = classes(docs, scratch, threshold, width, doc_id, text)
    # Components of classes; each bears its smallest doc_id.
    comp = scratch.save(components(scratch.save(links), scratch))
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sig")).alias("sig")).join(comp.select(F.col("id").alias("sig"), "component"), "sig", "left")
    rows = scratch.save(rows.select("doc_id", "n_shingles", F.coalesce("component", "sig").alias("group")))
    low = rows.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("low"))
    out = scratch.save(rows.join(low, "group", "left").select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id")))
    scratch.drop_others(out)
    return out
