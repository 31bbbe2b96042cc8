"""Spelling variant grouping: each word's neighbours at one edit, its likely form, and the root that forms lead to.

* Words are counted over whole texts, with partial sums before the shuffle, so a
  frequent word costs one row a task.
* The vocabulary is dealt by ranges to shards of bounded size; each becomes a compact
  trie, in which chains of single children are one node.
* Shards are broadcast in waves of checked size.  The automaton of each word at
  Levenshtein distance one (an exact position, and positions after an insertion, a
  replacement and a deletion) is run against every shard of the wave, depth first:
  a branch ends where no position is left.  What it accepts is emitted and reduced to
  counts and the best form by word.
* Roots come from pointer jumping over forms, whose counts at least double at each
  step, so chains are short and have no cycles.

Null texts have no words; a null id counts as the empty text; rows that share an id
are counted each.  An empty table has no rows.  A word of any length is one word.
Other columns are not read.
"""

from __future__ import annotations

import collections
import os
import pickle
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, in_parts

LETTERS = r"[A-Za-zÀ-ÿ]"
#: A shard ends at so many words or code points, a wave at so many bytes of tries.
SHARD_WORDS, SHARD_CHARS, WAVE_BYTES = 131_072, 4 << 20, 16 << 20
#: A task passes its partial counts on at so many words, and reads a text in pieces of so many code points.
HELD_WORDS, PIECE = 400_000, 1 << 20
#: Words a task runs against a wave.
TASK_WORDS = 8192

#: Each node's label, its (word, count) if a word ends there, and its kids by first code point.
Trie = tuple[list[str], list[tuple[str, int] | None], list[dict[str, int] | None]]


def build(words: list[str], counts: list[int]) -> Trie:
    """A compact trie of words in code-point order."""
    labels, ends, kids = [""], [None], [None]
    path, before = [(0, 0)], ""

    def kid(parent: int, label: str, end: tuple[str, int] | None) -> int:
        labels.append(label)
        ends.append(end)
        kids.append(None)
        if kids[parent] is None:
            kids[parent] = {}
        kids[parent][label[0]] = len(labels) - 1
        return len(labels) - 1

    for word, count in zip(words, counts, strict=True):
        same, last = len(os.path.commonprefix((before, word))), 0
        while path[-1][1] > same:
            last = path.pop()[0]
        top, depth = path[-1]
        if depth < same:  # the last node left ends further down than the common part: cut it in two
            top = kid(top, labels[last][: same - depth], None)
            labels[last] = labels[last][same - depth :]
            kids[top] = {labels[last][0]: last}
            path.append((top, same))
        path.append((kid(top, word[same:], (word, count)), len(word)))
        before = word
    return labels, ends, kids


def neighbours(trie: Trie, word: str) -> list[tuple[str, int]]:
    """Words of the trie at exactly one edit, with their counts, by a depth-first walk with the word's automaton.

    After d code points of a branch the automaton is ``exact`` if they are the word's
    first d, and in ``more``, ``other``, ``less`` if one edit makes them its first d - 1,
    d or d + 1.  Once it is no longer exact, a label keeps a position alive only if it
    stands in the word from there on, and only kids that begin so are met.
    """
    labels, ends, kids = trie
    size, goes, out, stack = len(word), word.startswith, [], []
    node, d, more, other, less = 0, 0, False, False, size > 0
    while node >= 0:  # the exact path; all that leaves it is put on the stack
        if ends[node] and ((more and d - 1 == size) or (other and d == size) or (less and d + 1 == size)):
            out.append(ends[node])
        below, on = kids[node], -1
        for x, kid in below.items() if below else ():
            label = labels[kid]
            if d < size and x == word[d]:
                exact, m, o, p, at = True, more, other, less, d
                for y in label:
                    same = exact and at < size and word[at] == y
                    m, o, p = (
                        exact or (m and at <= size and word[at - 1] == y),
                        (exact and at < size and not same) or (o and at < size and word[at] == y),
                        (same and at + 1 < size) or (p and at + 1 < size and word[at + 1] == y),
                    )
                    exact, at = same, at + 1
                    if not (exact or m or o or p):
                        break
                else:
                    if exact:
                        on, ahead = kid, (at, m, o, p)
                    else:
                        stack.append((kid, at, m, o, p))
            else:
                m, o, p = True, d < size, less and d + 1 < size and word[d + 1] == x
                if len(label) > 1:
                    rest = label[1:]
                    m, o, p = goes(rest, d), o and goes(rest, d + 1), p and goes(rest, d + 2)
                if m or o or p:
                    stack.append((kid, d + len(label), m, o, p))
        node = on
        if on >= 0:
            d, more, other, less = ahead
    while stack:
        node, d, more, other, less = stack.pop()
        end, below = ends[node], kids[node]
        if end and ((more and d - 1 == size) or (other and d == size) or (less and d + 1 == size)):
            out.append(end)
        if below:
            one = word[d - 1] if more and d <= size else None
            two = word[d] if other and d < size else None
            three = word[d + 1] if less and d + 1 < size else None
            for x in (one, two if two != one else None, three if three != two and three != one else None):
                if x in below:
                    kid = below[x]
                    label = labels[kid]
                    m, o, p = more and goes(label, d - 1), other and goes(label, d), less and goes(label, d + 1)
                    if m or o or p:
                        stack.append((kid, d + len(label), m, o, p))
    return out


def _pieces(text: str, gap: re.Pattern) -> Iterator[str]:
    """The text in pieces of about PIECE code points, cut where no word is."""
    at = 0
    while len(text) - at > PIECE:
        found = gap.search(text, at + PIECE)
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", typo_every: int = 97, letters: str = LETTERS) -> DataFrame:
    """Rows (word, n) over whole texts: runs of letters with A-Z lower-cased.

    From a run whose crc32 with its document's id is divisible by typo_every, one code
    point is dropped, as a slip of the pen would; 0 leaves all runs alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, gap, total = re.compile(f"{letters}+"), re.compile(f"[^{letters[1:-1]}]"), {}
        told = lambda: pa.record_batch({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})
        for b in in_parts(batches):
            for one, whole in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{one}:".encode())
                for piece in _pieces(whole, gap):
                    # As bytes, only A-Z have a lower case.
                    for word, n in collections.Counter(runs.findall(piece.encode().lower().decode())).items():
                        if typo_every and (h := zlib.crc32(word.encode(), start)) % typo_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        total[word] = total.get(word, 0) + n
                    if len(total) > HELD_WORDS:
                        yield told()
                        total.clear()
        yield told()

    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), text)
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_shards(words: DataFrame, n: int) -> DataFrame:
    """Rows (shard, trie) of words (word, n), in ranges of code-point order."""

    def packed(held: list[tuple[str, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([pickle.dumps(build(*map(list, zip(*held, strict=True))))], pa.binary())], ["trie"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for word, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((word, count))
                size += len(word)
                if len(held) >= SHARD_WORDS or size >= SHARD_CHARS:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    ranges = words.select("word", "n").repartitionByRange(max(1, n // SHARD_WORDS), "word").sortWithinPartitions("word")
    return ranges.mapInArrow(run, "trie binary").withColumn("shard", F.monotonically_increasing_id())


_LOADED: dict[str, list[Trie]] = {}


def _tries(wave: str, shards: list[bytes]) -> list[Trie]:
    """The tries of a wave, which a worker's later tasks find loaded."""
    if wave not in _LOADED:
        _LOADED.clear()
        _LOADED[wave] = [pickle.loads(s) for s in shards]
    return _LOADED[wave]


def accepted(words: DataFrame, shards: list[bytes]) -> DataFrame:
    """Rows (word, near, near_n): every word with every word of the shards at one edit from it."""
    sent, wave = words.sparkSession.sparkContext.broadcast(shards), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = _tries(wave, sent.value)
        for b in batches:
            found: list[tuple[str, str, int]] = []
            for word in b.column(0).to_pylist():
                found.extend((word, near, n) for t in tries for near, n in neighbours(t, word))
            if found:
                yield pa.record_batch([pa.array(c) for c in zip(*found, strict=True)], ["word", "near", "near_n"])

    return words.select("word").mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (word, root) from rows (word, form): where the chain of forms that starts at word ends."""
    told = scratch.save(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not told.where("open").isEmpty():
        on = told.select(F.col("word").alias("root"), F.col("root").alias("next"))
        old, told = told, scratch.save(told.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")))
        scratch.drop(old)
    return told.select("word", "root")


def group_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """words (word, n) with n_near, form, form_n and root.

    The form is the near word of largest n (ties: the first in code-point order), where
    that n is at least ``factor`` (2 or more) times the word's own.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2")
    scratch = Scratch(words.sparkSession)
    words = scratch.save(words.select("word", "n"))
    n = words.count()
    shards = scratch.save(build_shards(words, n))
    # One row per shard, so per 131,072 words.
    sizes = shards.select("shard", F.octet_length("trie").alias("bytes")).orderBy("shard").collect()
    dealt = scratch.save(words.repartition(max(1, -(-n // TASK_WORDS)), "word"))
    found, wave, size = [], [], 0
    for at, r in enumerate(sizes):
        wave, size = [*wave, r["shard"]], size + r["bytes"]
        if at + 1 == len(sizes) or size + sizes[at + 1]["bytes"] > WAVE_BYTES:
            tries = [bytes(x["trie"]) for x in shards.where(F.col("shard").isin(wave)).select("trie").collect()]
            found.append(scratch.save(accepted(dealt, tries).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))))
            wave, size = [], 0
    if not found:
        return words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"), F.col("word").alias("root"))
    near = found[0]
    for f in found[1:]:
        near = near.union(f)
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    strong = -F.col("best.minus") >= factor * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n")
    )
    told = scratch.save(told)
    return told.join(roots(told.where("form IS NOT NULL"), scratch), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, typo_every: int = 97) -> DataFrame:
    """Variant groups of the words of whole texts: word, n, n_near, form, form_n, root."""
    counted = count_words(docs, doc_id, text, typo_every)
    return group_variants(counted.where((F.char_length("word") >= least_length) & (F.col("n") >= least_count)))
