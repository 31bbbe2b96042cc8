"""The size of the toxicity tables is found before they are counted, so that no full tables are shuffled in vain."""

from __future__ import annotations

import random

import numpy as np

from demandloom.llm import toxicity


def texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789 .,:;!?-+*/()[]{}<>=&%$#@|", k=1000)) for _ in range(n)]


def test_watched_cells_tell_the_load():
    run, labels = [t.encode() for t in texts(60)], [i % 2 for i in range(60)]
    seen = toxicity.Watched()
    seen.add(toxicity.Grams(run, toxicity.MOST_SCALE), labels)
    words = {name: np.zeros(toxicity.WATCHED * toxicity.MOST_SCALE // 64, np.uint64) for name in seen.t}
    for name, at, data in seen.pieces():
        x = np.frombuffer(toxicity.zlib.decompress(data), np.uint64)
        words[name][at : at + len(x)] = x
    for scale in (1, 4):
        counts = toxicity.Counts(scale)
        counts.add(toxicity.Grams(run, scale), labels)
        told = max(np.unpackbits(x.view(np.uint8)).reshape(-1, toxicity.WATCHED * scale).any(axis=0).mean() for x in words.values())
        assert abs(told - toxicity.load(counts.t)) < 0.03
    assert toxicity.scale_of(words) == 4


def test_tables_are_counted_once(spark, monkeypatch):
    loads, load = [], toxicity.load
    monkeypatch.setattr(toxicity, "load", lambda t: loads.append((load(t), len(t["low"]))) or loads[-1][0])
    docs = spark.createDataFrame(list(enumerate(texts(100))), "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(100)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, labels).count() == 100
    assert [n for _, n in loads] == [4 * toxicity.LOW] and loads[0][0] <= toxicity.MOST_LOAD
