"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

1. Every text is tokenised (tokenizers library, local file), an end id is added,
   and only documents longer than a sequence are cut.
2. Pieces are dealt at random to shards of bounded size.  A full piece is a
   sequence of its own.  Each shard is evolved by several islands: a genome is a
   set of bins; crossover injects whole well-filled bins of one parent into the
   other, bins that now hold an item twice are dissolved, and displaced items
   return by best fit, after one or two items of a bin have given way to a displaced
   one that fills it better.  After each epoch every island receives its neighbour's
   elite genome.  An island stops early once it meets the lower bound.
3. The best genome of each shard places the pieces.

No task holds more than one shard, whatever the number of documents.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, fresh, map_batches

CAPACITY = 2048
SHARD_ITEMS = 4096
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 4, 4
#: Words kept with their ids in a worker, once more as many from before: beyond that the older half goes, but for words met since.
MEMO_WORDS = 500_000
_LETTERS = f"A-Za-z{chr(0xC0)}-{chr(0xD6)}{chr(0xD8)}-{chr(0xF6)}{chr(0xF8)}-{chr(0x24F)}"
#: White space and a word cut before punctuation; white space and what else stands before the next white space; white space at the end.
_WORD = re.compile(rf"[ \t\n\v\f\r]*[{_LETTERS}]+(?=[.,:;!?|%*$&#])|[ \t\n\v\f\r]*[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+")
#: White space that only some libraries count as such: texts with it are tokenised whole.
_ODD = re.compile("[" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")


#: Texts without any of these are cut at single blanks and line ends by the methods of str, which are faster than a regular expression.
_UNEVEN = ("  ", " \n", "\n ", "\n\n", "\0", "\t", "\v", "\f", "\r")
#: What may follow a word of letters, and is tokenised apart from it.
_MARKS, _LETTER = ".,:;!?|%*$&#", re.compile(f"[{_LETTERS}]")


class _Tokens:
    """Ids of texts as little-endian uint32 bytes, with a bounded memo of words.

    A word with the white space before it, and the punctuation after it, are
    tokenised by themselves: the byte-level pre-tokenizer never joins a
    non-space with a white space after it, nor a letter with such punctuation.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.memo, self.older = Tokenizer.from_file(path), {}, {}
        #: Texts that hold one of these are tokenised whole, as the library treats them.
        added = self.tok.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        #: An added token that takes no white space around it: text on both sides of it is tokenised apart.
        self.border = next(((i, t.content) for i, t in added.items() if not (t.lstrip or t.rstrip or t.single_word)), None)
        #: Whether an id stands for bytes that begin with a blank or a line end, in the byte-level alphabet.
        vocab = self.tok.get_vocab()
        self.begins = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t[:1] in (chr(0x120), chr(0x10A))]] = True

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """As _plain, many words in one call of the library, which takes far longer to begin than for a word."""
        if self.border is None:
            return self._plain(words)
        token, mark = self.border
        runs = [mark.join(words[k : k + 256]) for k in range(0, len(words), 256)]
        out: list[bytes] = []
        for ids in self._plain(runs):
            x = np.frombuffer(ids, "<u4")
            cuts = np.flatnonzero(x == token)
            out += [ids[4 * i : 4 * j] for i, j in zip([0, *(cuts + 1)], [*cuts, len(x)], strict=True)]
        return out

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Of parts as _cut gives them: those that begin with a blank or a line end, and hold no other, run
        on as one text, in which an id that begins so begins a part; all others as words."""
        out: dict[str, bytes] = {}
        plain = [p for p in parts if p not in ("", "\n") and p[0] != "\0"]
        rest = [p for p in parts if p in ("", "\n") or p[0] == "\0"]
        runs = [plain[k : k + 256] for k in range(0, len(plain), 256)]
        whole = self._plain(["".join(p if p[0] == "\n" else " " + p for p in run) for run in runs])
        for run, ids in zip(runs, whole, strict=True):
            cuts = (4 * np.flatnonzero(self.begins[np.frombuffer(ids, "<u4")])).tolist()
            if len(cuts) == len(run) and cuts[0] == 0:
                out.update(zip(run, [ids[i:j] for i, j in zip(cuts, [*cuts[1:], len(ids)], strict=True)], strict=True))
            else:  # another kind of tokenizer
                rest += run
        out.update(zip(rest, self._words([p[1:] if p[:1] == "\0" else p if p[:1] == "\n" else " " + p for p in rest]), strict=True))
        return [out[p] for p in parts]

    def _cut(self, text: str) -> list[str] | None:
        """A text's words, each with the white space before it, or None for a text to be tokenised whole.

        Of an even text: NUL and what stands before the first blank or line end; what follows
        a blank, without it; a line end and what follows it.
        """
        if _ODD.search(text) or any(a in text for a in self.added):
            return None
        if any(x in text for x in _UNEVEN):
            return ["\0" + w for w in _WORD.findall(text)]
        return ("\0" + text).replace("\n", " \n").split(" ")

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 64):
            run = [self._cut(t) for t in texts[at : at + 64]]
            if len(self.memo) > MEMO_WORDS:
                self.memo, self.older = {}, self.memo
            memo, older = self.memo, self.older
            new = set(filterfalse(memo.__contains__, chain.from_iterable(words for words in run if words)))
            memo.update((w, older[w]) for w in new if w in older)
            # A word with punctuation after it has the ids of both.
            two = {w: (stem, "\0" + w[len(stem) :]) for w in new if w not in older and w[-1:] in _MARKS and (stem := w.rstrip(_MARKS)) and _LETTER.match(stem[-1])}
            new = [w for w in {*new.difference(two), *chain.from_iterable(two.values())} if w not in memo]
            memo.update(zip(new, self._parts(new), strict=True))
            memo.update((w, memo[stem] + memo[mark]) for w, (stem, mark) in two.items())
            for t, words in zip(texts[at : at + 64], run, strict=True):
                yield self._plain([t])[0] if words is None else b"".join(map(memo.__getitem__, words))


@lru_cache(maxsize=2)
def _tokens(path: str) -> _Tokens:
    return _Tokens(path)


def pieces(df: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): every document's ids and end id, cut only if longer than ``capacity``.

    Null text counts as empty (one piece, the end id); rows with the same or a
    null id are separate documents; an empty table gives an empty result.  Strings
    that are added tokens of the tokenizer get their ids, as in the library.  Other
    columns are left out.
    """
    end = np.array([end_id], "<u4").tobytes()
    id_type = df.schema[doc_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tok, ids = _tokens(tokenizer_file), batch.column("doc_id").to_pylist()
        rows: list[list] = [[], [], [], [], []]
        for i, got in zip(ids, tok.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
            got += end
            n = len(got) // 4
            cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                for column, v in zip(rows, (i, k, a, b - a, zlib.crc32(got[4 * a : 4 * b])), strict=True):
                    column.append(v)
        kinds = [batch.column("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


# --- the genetic algorithm on one shard: sizes in descending order, a genome is an int array item -> bin ---


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound: no packing has fewer bins."""
    if not len(sizes):
        return 0
    up = np.sort(sizes).astype(np.int64)
    upto = np.r_[0, np.cumsum(up)]
    k = np.unique(up[up <= capacity // 2])
    half, big, least = np.searchsorted(up, capacity // 2, "right"), np.searchsorted(up, capacity - k, "right"), np.searchsorted(up, k)
    room = (big - half) * capacity - (upto[big] - upto[half])
    more = np.maximum(0, -(-(upto[half] - upto[least] - room) // capacity))
    return int(max(-(-upto[-1] // capacity), (len(up) - half + more).max(initial=0)))


def _best_fit(sizes: list[int], items: list[int], bins: list[list[int]], fills: list[int], capacity: int) -> None:
    """Put items, largest first, each into the fullest bin that still takes it."""
    room = sorted((capacity - f, b) for b, f in enumerate(fills) if f < capacity)
    for i in sorted(items, key=lambda x: -sizes[x]):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
            fills.append(0)
        bins[b].append(i)
        fills[b] += sizes[i]
        if left > sizes[i]:
            insort(room, (left - sizes[i], b))


def _replace(sizes: list[int], displaced: list[int], bins: list[list[int]], fills: list[int], capacity: int) -> list[int]:
    """One or two items of a bin give way to a displaced one that fills it better; what is displaced then."""
    free = sorted((sizes[i], i) for i in displaced)
    for b, items in enumerate(bins):
        if not free or len(items) > 8:
            continue
        small = sorted(items, key=lambda i: sizes[i])
        for out in [*((i,) for i in small), *((i, j) for k, i in enumerate(small) for j in small[k + 1 :])]:
            taken = sum(sizes[i] for i in out)
            at = bisect_left(free, (taken + capacity - fills[b] + 1, -1)) - 1
            if at >= 0 and free[at][0] > taken:
                size, i = free.pop(at)
                bins[b] = [x for x in items if x not in out] + [i]
                fills[b] += size - taken
                for x in out:
                    insort(free, (sizes[x], x))
                break
    return [i for _, i in free]


def _genome(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for b, items in enumerate(bins):
        out[items] = b
    return out


def _bins(genome: np.ndarray) -> list[list[int]]:
    order = np.argsort(genome, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(genome[order])) + 1)]


def fitness(genome: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the bins: fewer bins, and among equals more uneven ones, are better."""
    fill = np.bincount(genome, weights=sizes) / capacity
    return float((fill**2).sum() / max(1, len(fill)))


def _cross(a: np.ndarray, b: np.ndarray, sizes: list[int], capacity: int, rng: np.random.Generator) -> np.ndarray:
    full = [(sum(sizes[i] for i in x), x) for x in _bins(b)]
    full.sort(key=lambda x: -x[0])
    well = full[: max(1, len(full) // 2)]
    take = [x for keep, (_, x) in zip(rng.random(len(well)) < 0.5, well, strict=True) if keep] or [well[0][1]]
    inside = {i for x in take for i in x}
    bins, fills, displaced = [list(x) for x in take], [sum(sizes[i] for i in x) for x in take], []
    kept = []
    for x in _bins(a):
        if inside.isdisjoint(x):
            kept.append(x)
        else:
            displaced += [i for i in x if i not in inside]
    kept.sort(key=lambda x: -sum(sizes[i] for i in x))
    drop = max(1, len(kept) // 20) if kept else 0  # mutation: the emptiest bins are dissolved too
    for x in kept[len(kept) - drop :]:
        displaced += x
    for x in kept[: len(kept) - drop]:
        bins.append(list(x))
        fills.append(sum(sizes[i] for i in x))
    displaced = _replace(sizes, displaced, bins, fills, capacity)
    _best_fit(sizes, displaced, bins, fills, capacity)
    return _genome(bins, len(a))


def evolve(sizes: np.ndarray, capacity: int, seed: int, population: list[np.ndarray] | None, generations: int, size: int) -> list[np.ndarray]:
    """One epoch of one island; genomes best first. Stops as soon as the lower bound is met."""
    plain, rng, n = sizes.tolist(), np.random.default_rng(seed), len(sizes)
    if not population:
        population = []
        for k in range(size):
            bins, fills = [], []
            order = range(n) if not k else rng.permutation(n)[: n // 5].tolist()
            if k:  # a random start, the rest by best fit
                for i in order:
                    if fills and fills[-1] + plain[i] <= capacity:
                        bins[-1].append(i)
                        fills[-1] += plain[i]
                    else:
                        bins.append([i])
                        fills.append(plain[i])
            rest = set(order) if k else set()
            _best_fit(plain, [i for i in range(n) if i not in rest], bins, fills, capacity)
            population.append(_genome(bins, n))
            if int(population[-1].max()) + 1 <= lower_bound(sizes, capacity):
                break
    score = lambda g: -fitness(g, sizes, capacity)
    population.sort(key=score)
    bound = lower_bound(sizes, capacity)
    for _ in range(generations):
        if int(population[0].max()) + 1 <= bound or len(population) < 2:
            break
        children = []
        for _ in range(max(1, size // 2)):
            a, b = rng.choice(len(population), 2, replace=False)
            children.append(_cross(population[a], population[b], plain, capacity, rng))
        population = sorted(population + children, key=score)[:size]
    return population


def _sizes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i4")


def pack(placed: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, seed: int = 7) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``capacity``; other columns pass through.

    Rows of equal length are interchangeable.  An empty table gives an empty
    result.  The input is written once to the shared folder, so that shards are
    dealt from stable rows.
    """
    spark = placed.sparkSession
    tasks = lambda n: max(1, min(n, 20_000))  # noqa: E731  shards are few bytes and much work: one task each
    scratch = Scratch(spark)
    placed = placed.drop("sequence_id", "offset")
    row_no, shard = fresh(placed, "row_no", "shard")
    # Row numbers are written: computed again they would follow how files are dealt to tasks, and so the number of cores.
    base = scratch.save(placed.withColumn(row_no, F.monotonically_increasing_id()))
    shards = max(1, -(-base.where(F.col("length") < capacity).count() // shard_items))
    full = base.where(F.col("length") >= capacity).select("*", (-1 - F.col(row_no)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).drop(row_no)
    open_ = base.where(F.col("length") < capacity).withColumn(shard, F.pmod(F.xxhash64(row_no), F.lit(shards)))

    def start(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = np.sort(pdf["length"].to_numpy())[::-1].astype("<i4")
        rows = []
        for island in range(islands):
            got = evolve(sizes, capacity, seed + 1000 * int(key[0]) + island, None, generations, population)
            rows.append((int(key[0]), island, sizes.tobytes(), [g.astype("<i4").tobytes() for g in got]))
            if int(got[0].max()) + 1 <= lower_bound(sizes, capacity):
                break  # the other islands can't do better
        return pd.DataFrame(rows, columns=["shard", "island", "sizes", "genomes"])

    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        sizes, known = _sizes(r["sizes"]), [np.frombuffer(g, "<i4") for g in [*r["genomes"], *([r["elite"]] if r["elite"] else [])]]
        got = evolve(sizes, capacity, seed + 1000 * int(r["shard"]) + 100 * int(r["epoch"]) + int(r["island"]), known, generations, population)
        return pd.DataFrame([(int(r["shard"]), int(r["island"]), r["sizes"], [g.astype("<i4").tobytes() for g in got])], columns=["shard", "island", "sizes", "genomes"])

    state = "shard long, island int, sizes binary, genomes array<binary>"
    pop = scratch.save(open_.select(F.col(shard).alias("shard"), "length").repartition(tasks(shards), "shard").groupBy("shard").applyInPandas(start, state))
    for epoch in range(1, epochs):
        # Elite migration on a ring: each island gets the best genome of the one before it.
        elite = pop.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("genomes")[0].alias("elite"))
        moved = pop.join(elite, ["shard", "island"], "left").withColumn("epoch", F.lit(epoch))
        pop = scratch.save(moved.repartition(tasks(shards * islands), "shard", "island").groupBy("shard", "island").applyInPandas(again, state))

    def place(key: tuple, items: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", row_no], ascending=[False, True], kind="stable")
        sizes = items["length"].to_numpy()
        best = max((np.frombuffer(g, "<i4") for x in found["genomes"] for g in x), key=lambda g: (-int(g.max()), fitness(g, sizes, capacity)))
        order = np.argsort(best, kind="stable")
        filled = np.cumsum(sizes[order])
        bins = best[order]
        first = np.r_[True, bins[1:] != bins[:-1]]
        begin = np.maximum.accumulate(np.where(first, filled - sizes[order], 0))
        offset = np.empty(len(items), np.int64)
        offset[order] = filled - sizes[order] - begin
        return items.assign(sequence_id=int(key[0]) * (1 << 20) + best.astype(np.int64), offset=offset).drop(columns=[row_no, shard])

    out = open_.groupBy(shard).cogroup(pop.groupBy("shard")).applyInPandas(place, full.schema)
    return full.unionByName(out)
