"""Operators that must use all of their input, beyond the sizes at which a bounded sample would do."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

from demandloom.llm import quality_rules, toxicity


def test_quality_rules_count_every_trusted_document(spark):
    """Where all documents are trusted, target and corpus are the same counts, and every ratio is 0."""
    docs = spark.range(20_050).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert not any(quality_rules.ratios(docs, labels, buckets=512))


def test_quality_rules_broadcast_or_not(spark):
    docs = spark.createDataFrame([(i if i % 7 else None, f"a b{i % 5} c{i % 3}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id long, quality int")
    got = quality_rules.ratios(docs, labels, buckets=512, most_broadcast=0)
    assert any(got) and got == quality_rules.ratios(docs, labels, buckets=512)


def test_toxic_expression_of_a_single_document_is_evidence():
    counts = toxicity.Counts()
    texts = [b"a calm day by the river", b"you grumpf blorgh"]
    counts.add(toxicity.Grams(texts), [0, 1])
    found = toxicity.Model(counts.t).features(toxicity.Grams(texts[::-1]))
    assert found[0, 0] > 0 > found[1, 0]


def test_larger_tables_tell_the_same():
    """Tables of four times the size, as a large vocabulary makes them, give the same differences but for chance collisions."""
    texts = [f"calm river number {i} flows by the old mill".encode() for i in range(40)] + [f"you grumpf blorgh number {i} of them all".encode() for i in range(12)]
    labels = [0] * 40 + [1] * 12
    told = []
    for scale in (1, 4):
        counts = toxicity.Counts(scale)
        counts.add(toxicity.Grams(texts, scale), labels)
        told.append(toxicity.Model(counts.t).features(toxicity.Grams(texts, scale)))
    assert abs(told[0] - told[1]).max() < 0.05
    assert told[1][40:, 0].min() > told[1][:40, 0].max()


def kneser_ney(texts, labels, queries):
    """The length-normalised difference by dictionaries and sets, without hashed tables."""
    pad = bytes(toxicity.ORDER - 1)
    grams = lambda t: [(pad + t.lower())[i : i + toxicity.ORDER] for i in range(len(t))]
    low, around = collections.defaultdict(set), collections.defaultdict(set)
    gram, context = ([collections.Counter() for _ in (0, 1)] for _ in range(2))
    after = [collections.defaultdict(set) for _ in (0, 1)]
    for t, y in zip(texts, labels, strict=True):
        for g in grams(t):
            low[g[2:]].add(g[1])
            around[g[2:5]].add((g[1], g[5]))
        for g in set(grams(t)) if y is not None else ():
            gram[y][g] += 1
            context[y][g[:5]] += 1
            after[y][g[:5]].add(g[5])
    counts = [n for c in gram for n in c.values()]
    n1, n2 = counts.count(1), counts.count(2)
    d = min(max(n1 / (n1 + 2 * n2), toxicity.DISCOUNTS[0]), toxicity.DISCOUNTS[1])
    out = []
    for t in queries:
        total = 0.0
        for g in grams(t):
            shared = 0.9 * min(len(low[g[2:]]) / max(len(around[g[2:5]]), 1), 1) + 0.1 / 256
            p = []
            for c in (0, 1):
                n = context[c][g[:5]]
                free = min(d * len(after[c][g[:5]]) / n, 1) if n else 1
                p.append(max(gram[c][g] - d, 0) / max(n, 1) + free * shared)
            total += math.log(p[1] / p[0])
        out.append(total / max(len(t), toxicity.LEAST_BYTES))
    return out


def test_kneser_ney_against_dictionaries():
    rng = random.Random(6)
    word = lambda kind: "".join(rng.choice(kind) for _ in range(rng.randint(2, 6)))
    texts = [" ".join(word("abcde" if i % 3 else "cdefg") for _ in range(rng.randint(3, 30))).encode() for i in range(120)]
    labels = [None if i % 5 == 0 else int(i % 3 == 0) for i in range(120)]
    counts = toxicity.Counts()
    counts.add(toxicity.Grams(texts), labels)
    queries = [*texts[:20], b"Abc DEFG", b"zzz", "süß".encode()]
    got = toxicity.Model(counts.t).features(toxicity.Grams(queries))[:, 0]
    want = kneser_ney(texts, labels, queries)
    assert np.abs(got - want).max() < 0.02 and np.corrcoef(got, want)[0, 1] > 0.999
