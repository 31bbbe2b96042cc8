"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio against trusted text.

DataFrame functions only.  Unigrams and bigrams are hashed into two multinomials of
fixed size, one over a trusted target (labelled documents), one over all documents.
A document's value is the mean log ratio of its n-grams under both; it is kept if the
base rules hold and the value reaches a fixed threshold, so every document's verdict
is deterministic.  The table of log ratios has ``2 * buckets`` entries, whatever the
corpus, and travels as a literal; scoring shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import fresh

BUCKETS = 1 << 15
#: Up to so many trusted ids are broadcast; beyond that texts and ids are shuffled by id. The counts are the same.
MOST_BROADCAST = 1_000_000
ALPHA = 1.0
#: A document whose n-grams are, on average, this much rarer in trusted text than in the corpus is rejected.
THRESHOLD = -0.5
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def grams(w: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of every word, then of every pair of neighbours (from ``buckets`` on)."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    two = F.transform(w, lambda x, i: (F.pmod(F.xxhash64(x, F.get(w, i + 1)), F.lit(buckets)) + buckets).cast("int"))
    return F.concat(one, F.slice(two, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))))


def base_columns(text: Column, w: Column) -> dict[str, Column]:
    """The base statistics of a text and its words."""
    clean = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(clean, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.regexp_replace(clean, SPACE, "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(clean, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def _windows(w: Column) -> Column:
    """Sorted (hash, place) of every window of three words."""
    places = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.transform(places, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))


def _repeated(s: Column) -> Column:
    """Places, ascending, of the windows that have an equal one beside them in sorted order."""
    same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
    return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), (F.get(s, i - 1)["h"] == x["h"]), (F.get(s, i + 1)["h"] == x["h"]), F.lit(False))), lambda x: x["i"]))


def _covered(p: Column) -> Column:
    """Words inside three-word windows at these ascending places."""
    return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)


def ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, alpha: float = ALPHA, most_broadcast: int = MOST_BROADCAST) -> list[float]:
    """Log ratio of every bucket: trusted target over all documents, both with add-alpha smoothing."""
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    few = trusted.limit(most_broadcast + 1).count() <= most_broadcast
    trusted = trusted.withColumn("t", F.lit(1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(trusted) if few else trusted, "doc_id", "left").select("t", words(F.col("text")).alias("w"))
    counts = rows.select(F.explode(grams(F.col("w"), buckets)).alias("b"), F.coalesce("t", F.lit(0)).alias("t")).groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    total = counts.groupBy((F.col("b") >= buckets).alias("second")).agg(F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    value = F.log((F.col("target") + alpha) / (F.col("n_target") + alpha * buckets)) - F.log((F.col("raw") + alpha) / (F.col("n_raw") + alpha * buckets))
    found = counts.join(F.broadcast(total), (F.col("b") >= buckets) == F.col("second")).select("b", value.alias("v")).collect()
    out = [0.0] * (2 * buckets)
    for r in found:
        out[r["b"]] = r["v"]
    return out


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, alpha: float = ALPHA, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, llr (double) and kept added.

    Null text has no words and fails the base rules.  Repeated rows, shared and null
    ids are judged row by row; an empty table gives an empty result; existing columns
    of these names are replaced.  Without trusted documents the target is uniform
    and only differences between rare and common n-grams remain; with none at all
    the value is 0 for an empty text.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    docs = docs.drop(*added)
    ratio = ratios(docs, labels, buckets, alpha)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratio)), ",").cast("array<double>")
    names = docs.columns
    w, windows, g, places = fresh(docs.select(*names, *(F.lit(0).alias(c) for c in added)), "w", "windows", "g", "places")
    out = docs.withColumn(w, words(F.col("text")))
    out = out.select(*names, *(c.alias(k) for k, c in base_columns(F.col("text"), F.col(w)).items()), _windows(F.col(w)).alias(windows), grams(F.col(w), buckets).alias(g))
    total = F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b))
    out = out.select("*", _repeated(F.col(windows)).alias(places), F.coalesce(F.try_divide(total, F.size(g)), F.lit(0.0)).alias("llr")).drop(windows, g)
    out = out.select("*", _covered(F.col(places)).alias("n_repeat_words")).drop(places)
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).select(*names, *added)
