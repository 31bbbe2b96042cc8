"""Line dedup: exact set-similarity self-join of lines, later matches removed.

DataFrame functions only.  A line's tokens are its distinct words, lower-cased.
A line goes if an earlier line, by (doc_id, place in the text), has Jaccard
similarity of at least ``threshold`` with it; earlier lines count whether or not they
go themselves.

* Tokens are hashed and ordered by rarity: by the count of their bucket in a table of
  fixed size over all documents, then by hash.  Any such order is a valid global one,
  so buckets shared by chance cost time only.
* Lines with equal token sets are one class, kept by its earliest line.  A line whose
  set equals a class's in one 64-bit hash but not in another stays.
* Groups of near copies are mostly settled first: lines that agree in a pair of
  minimum hashes, one of four, are compared with the earliest of them alone.  Only
  classes that this leaves go through the join, against all classes.
* What a class needs in the join goes through a shuffle once, a share at a time; which
  classes are settled is told to all passes before them.
* The join meets on tokens of the prefix (n - ceil(t n) + 1 rarest).  Length and
  positional filters and a parity bitmap, which bounds the symmetric difference from
  below, run inside the join; what is left is verified on the token sets.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, fresh

THRESHOLD = Fraction(3, 4)
KEYS = ["k0", "k1", "k2", "k3"]
#: Passes of the prefix join, each over its share of the tokens: the shuffle files of one pass are on disk at a time.
PASSES = 4
BUCKETS = 1 << 18
#: The lines are grouped into classes in so many shares, for the same reason.
SHARES = 2
WHITE = " \t\n\v\f\r"
#: Up to so many ids (8 bytes each), or a quarter as many places of lines, are broadcast; beyond that the join shuffles.
BROADCAST_IDS = 1_000_000


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _words(text: Column) -> Column:
    """Words, and an empty one at each end of white space that stands beside more; a split at one character needs no regular expression."""
    for c in WHITE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.split(text, " ")


def _hashes(line: Column) -> Column:
    """Sorted hashes of the distinct words of a lower-cased line that has a word."""
    return F.sort_array(F.array_distinct(F.transform(F.array_remove(_words(line), ""), lambda w: F.xxhash64(w))))


def _few(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def rarity(docs: DataFrame, buckets: int = BUCKETS) -> Column:
    """Literal array: for each bucket a rank, times 2^53, that grows with the count of its words in all documents."""
    words = docs.select(F.explode(_words(F.lower("text"))).alias("w")).where("w <> ''")
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(_long(buckets - 1)).alias("b")).count()
    ranks = counts.groupBy(F.shiftright("b", 8).alias("part")).agg(F.collect_list(F.struct("b", F.floor(8 * F.log2("count")).cast("int").alias("r"))).alias("of"))
    rank = [0] * buckets
    for row in ranks.toLocalIterator():  # ``buckets`` small numbers, whatever the corpus
        for b, r in row["of"]:
            rank[b] = r << 53
    return F.split(F.lit(",".join(map(str, rank))), ",").cast("array<bigint>")


def _by_rarity(hashes: str, ranks: Column, buckets: int) -> Column:
    """The hashes as numbers that sort by rarity: 10 bits of rank (as ranks has them), then 53 bits of hash."""
    rank = lambda h: F.get(ranks, h.bitwiseAND(_long(buckets - 1)).cast("int"))
    return F.sort_array(F.transform(hashes, lambda h: rank(h).bitwiseOR(F.shiftrightunsigned(h, 11))))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line_no, line), lower-cased, of lines with a word; th tells texts under one id apart."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(F.lower("text"), "\n")).alias("line_no", "line"))
    return lines.where(F.btrim("line", F.lit(WHITE)) != "")


def _parity(hashes: Column) -> Column:
    """64 cells, each the parity of the hashes that fall into it."""
    one = lambda x: F.call_function("shiftleft", _long(1), x.bitwiseAND(_long(63)).cast("int"))
    return F.aggregate(hashes, _long(0), lambda a, x: a.bitwiseXOR(one(x)))


def _prefix(t: Fraction) -> Column:
    """n - ceil(t n) + 1 for n tokens."""
    return F.expr(f"n - cast((n * {t.numerator} + {t.denominator - 1}) div {t.denominator} as int) + 1")


def removed_lines(docs: DataFrame, threshold: Fraction = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, th, line_no) of the lines to remove; th is xxhash64 of the text."""
    scratch, t = Scratch(docs.sparkSession), threshold
    ranks = rarity(docs, buckets)
    lines = _lines(docs).select("doc_id", "th", "line_no", _hashes(F.col("line")).alias("h"))
    # Negative hashes, which are sorted first, and others have a parity bitmap each: 128 cells in all.
    lines = lines.select("*", F.size("h").alias("n"), F.size(F.filter("h", lambda x: x < 0)).alias("below"), _by_rarity("h", ranks, buckets).alias("t"))
    # The two smallest and largest of either half: four pairs of minimum hashes, each from other tokens.
    ends = [(F.lit(0), F.lit(1)), (F.col("below") - 1, F.col("below") - 2), (F.col("below"), F.col("below") + 1), (F.col("n") - 1, F.col("n") - 2)]
    wide = lines.select(
        "doc_id", "th", "line_no", "n",
        F.xxhash64("h", F.lit(1)).alias("sig"),
        F.xxhash64("h", F.lit(2)).alias("sig2"),
        # 31 bits of hash: words that share them cost time only, as do equal keys.
        F.transform(F.slice("t", F.lit(1), _prefix(t)), lambda x: x.bitwiseAND(_long((1 << 31) - 1)).cast("int")).alias("prefix"),
        _parity(F.slice("h", F.lit(1), F.col("below"))).alias("bits"),
        _parity(F.slice("h", F.col("below") + 1, F.col("n") - F.col("below"))).alias("bits2"),
        *(F.hash(F.get("h", x), F.get("h", y)).alias(f"k{k}") for k, (x, y) in enumerate(ends)),
    )
    wide = scratch.save(wide)
    place = F.struct("doc_id", "th", "line_no")
    shares = []
    for k in range(SHARES):
        of = wide.where(F.pmod("sig", _long(SHARES)) == k).groupBy("sig")
        shares.append(scratch.save(of.agg(F.min(place).alias("place"), F.min(F.struct("sig2", "n", "bits", "bits2", *KEYS, "prefix")).alias("x")).select("sig", "place", "x.*")))
        scratch.release()
    classes = docs.sparkSession.read.schema(shares[0].schema).parquet(*(x.scratch_path for x in shares))
    every = scratch.save(wide.select("doc_id", "th", "line_no", "sig", "sig2"))
    scratch.drop(wide)

    def similar(pairs: DataFrame) -> DataFrame:
        """sig of those later members b of pairs (a, b) whose token sets are similar enough to a's."""
        ends = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
        where = scratch.save(classes.join(_few(ends, BROADCAST_IDS), "sig", "left_semi").select("sig", "place.*"))
        ids, at = _few(where.select("doc_id").distinct(), BROADCAST_IDS), _few(where, BROADCAST_IDS // 4)
        lines = _lines(docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi"))
        on = [lines["doc_id"].eqNullSafe(at["doc_id"]), lines["th"] == at["th"], lines["line_no"] == at["line_no"]]
        sets = scratch.save(lines.join(at, on).select("sig", _hashes(F.col("line")).alias("t")).dropDuplicates(["sig"]))
        both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("t").alias("ta")), "a").join(sets.select(F.col("sig").alias("b"), F.col("t").alias("tb")), "b")
        common = F.size(F.array_intersect("ta", "tb"))
        out = scratch.save(both.where(common * t.denominator >= (F.size("ta") + F.size("tb") - common) * t.numerator).select(F.col("b").alias("sig")).distinct())
        scratch.drop(where, sets, pairs)
        scratch.release()
        return out

    near = lambda a, b: f"(bit_count({a}.bits ^ {b}.bits) + bit_count({a}.bits2 ^ {b}.bits2)) * {t.numerator + t.denominator} <= ({a}.n + {b}.n) * {t.denominator - t.numerator} AND {a}.n * {t.denominator} >= {b}.n * {t.numerator} AND {b}.n * {t.denominator} >= {a}.n * {t.numerator}"
    # A group's leader is its earliest line, so it comes before all others.
    seen, stars = F.struct("n", "bits", "bits2"), []
    for k in KEYS:
        first = classes.groupBy(k).agg(F.min(F.struct("place", "sig", seen.alias("aa"))).alias("first"), F.count("*").alias("c")).where("c > 1")
        met = classes.select(k, F.col("sig").alias("b"), seen.alias("bb")).join(first.select(k, F.col("first.sig").alias("a"), F.col("first.aa").alias("aa")), k)
        stars.append(scratch.save(met.where(F.expr(f"a <> b AND {near('aa', 'bb')}")).select("a", "b")))
        scratch.release()
    star = scratch.save(reduce(DataFrame.union, stars).distinct())
    scratch.drop(*stars)
    gone = similar(star)

    known = classes.select("sig", "n", "bits", "bits2", "prefix").join(_few(gone.withColumn("done", F.lit(1)), BROADCAST_IDS), "sig", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    if gone.count() > BROADCAST_IDS:
        known = scratch.save(known)  # one shuffle of the classes, not one in every pass
        scratch.release()
    posting = known.select("sig", "n", "bits", "bits2", "done", F.posexplode("prefix").alias("pos", "token"))
    # Pairs of a class that is left and one that is done, and, once, of two that are left. As neither side
    # can be filtered before the join, they are the same rows, and one exchange serves both.
    once = "(x.done < y.done OR (x.done + y.done = 0 AND x.sig < y.sig))"
    # The overlap that is still possible if this is their first common token, against the one needed.
    most = "least(x.n - x.pos, y.n - y.pos)"
    reach = f"({most}) * {t.numerator + t.denominator} >= (x.n + y.n) * {t.numerator}"
    found = []
    for k in range(PASSES):
        part = posting.where(F.pmod("token", F.lit(PASSES)) == k)
        part = part.alias("x").join(part.alias("y"), "token").where(F.expr(f"{once} AND {reach} AND {near('x', 'y')}"))
        found.append(scratch.save(part.select(F.col("x.sig").alias("p"), F.col("y.sig").alias("q"), (F.col("y.done") == 0).alias("both")).distinct()))
        scratch.release()
    pairs = reduce(DataFrame.union, found).distinct()
    order = lambda x: classes.select(F.col("sig").alias(x), F.col("place").alias(f"{x}_at"))
    pairs = pairs.join(order("p"), "p").join(order("q"), "q").where("q_at < p_at OR both")
    later = F.col("q_at") < F.col("p_at")
    pairs = pairs.select(F.when(later, F.col("q")).otherwise(F.col("p")).alias("a"), F.when(later, F.col("p")).otherwise(F.col("q")).alias("b"))
    pairs = scratch.save(pairs)
    scratch.drop(*found)
    gone = scratch.save(gone.union(similar(pairs)))
    # All lines of a class that goes, and all but the first of one that stays.
    marked = every.join(classes.select("sig", "place", F.col("sig2").alias("same")), "sig").where("sig2 = same").join(gone.withColumn("gone", F.lit(True)), "sig", "left")
    out = scratch.save(marked.where(F.col("gone").isNotNull() | (F.struct("doc_id", "th", "line_no") != F.col("place"))).select("doc_id", "th", "line_no"))
    scratch.drop_others(out)
    return out


def dedup(docs: DataFrame, threshold: Fraction = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The documents with ``text`` rid of near-repeated lines, and n_lines and n_removed_lines (long) added.

    Lines are parts between newlines; lines without a word always stay.  Null text
    stays null with no lines; a text that loses all its lines becomes empty.  Rows
    equal in id and text are one document: they keep and lose the same lines.  Rows
    that share an id are ordered by a hash of the text, and null ids come first.
    An empty table gives an empty result.  Existing columns of the two names are
    replaced, others pass through.  Ids must be castable to bigint.
    """
    docs = docs.drop("n_lines", "n_removed_lines")
    gone = removed_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), threshold, buckets)
    id_, th, no, parts, kept = fresh(docs, "id", "th", "gone", "lines", "kept")
    gone = gone.groupBy("doc_id", "th").agg(F.collect_set("line_no").alias(no)).select(F.col("doc_id").alias(id_), F.col("th").alias(th), no)
    on = docs["doc_id"].cast("long").eqNullSafe(gone[id_]) & (F.xxhash64(docs["text"]) == gone[th])
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.coalesce(no, F.array().cast("array<int>")))
    out = docs.join(gone, on, "left").drop(id_, th).withColumn(parts, F.split("text", "\n")).withColumn(kept, left)
    text = F.when(F.col(no).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    n = F.greatest(F.coalesce(F.size(parts), F.lit(0)), F.lit(0)).cast("long")
    return out.withColumns({"text": text, "n_lines": n, "n_removed_lines": F.greatest(F.coalesce(F.size(no), F.lit(0)), F.lit(0)).cast("long")}).drop(parts, kept, no)
