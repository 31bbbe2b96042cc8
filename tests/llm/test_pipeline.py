"""The pipeline's stages, one after the other, against brute force on the smallest tables."""

from __future__ import annotations

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def lines_of(text):
    return [(i, frozenset(x.lower().encode().split())) for i, x in enumerate((text or "").split("\n"))]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < 4:
            assert docs.columns == columns
            rows = docs.collect()
            kept[name] = {r.doc_id: r.text for r in rows}
            assert all(r.n_chars == len(r.text) for r in rows)
            docs = spark.createDataFrame(rows, docs.schema)
    start, lines, near, last = (kept[s] for s, _ in corpus_pipeline.STAGES[:4])
    seen = []
    for d in sorted(start):
        out = []
        for i, s in lines_of(start[d]):
            if not s or not any(4 * len(s & e) >= 3 * len(s | e) for e in seen):
                out.append(i)
            if s:
                seen.append(s)
        assert lines[d] == "\n".join(x for i, x in enumerate(start[d].split("\n")) if i in out)
    sets = {}
    for d, t in lines.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    for d in sets:
        if d in near:
            assert not any(e < d and sets[e] and 4 * len(sets[d] & sets[e]) >= 3 * len(sets[d] | sets[e]) for e in near)
        else:
            assert any(4 * len(sets[d] & sets[e]) >= 3 * len(sets[d] | sets[e]) for e in sets if e != d)
    low = {}
    for d, t in near.items():
        w = t.encode().split()
        for i in range(len(w) - 49):
            low[tuple(w[i : i + 50])] = min(d, low.get(tuple(w[i : i + 50]), d))
    for d, t in near.items():
        w = t.encode().split()
        keep = [True] * len(w)
        for i in range(len(w) - 49):
            if low[tuple(w[i : i + 50])] < d:
                keep[i : i + 50] = [False] * 50
        assert last[d].encode().split() == [x for x, k in zip(w, keep, strict=True) if k]
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(last)
    room = {}
    for r in packed:
        room[r.sequence_id] = room.get(r.sequence_id, 0) + r.length
    assert max(room.values()) <= 2048
    assert sum(room.values()) / (2048 * len(room)) > 0.9 or len(room) == pytest.approx(sum(room.values()) / 2048, abs=1)


def test_stages_on_odd_tables(spark):
    """Null texts and ids, shared ids, repeated rows, an extra column and no rows at all."""
    text = " ".join(f"word{i}" for i in range(80))
    near = text.replace("word40", "other")
    rows = [(1, text), (1, near), (1, "something else entirely, under the same id"), (None, near), (2, text), (3, None), (4, ""), (5, " \n"), (6, "alone here"), (6, "alone here")]
    docs = spark.createDataFrame([(d, t, None, "s", None, k, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, place int, row_no int")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r.place for r in got.collect()) == [0, 2, 5, 6, 7, 8]
    for table in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, SF)
            assert k == 4 or out.columns == docs.columns
            assert out.count() <= max(table.count(), 0)


def dealt_anew(spark, build):
    """The rows of a table that was built while files were dealt to many tasks and is read while they are dealt to one."""
    key = "spark.sql.files.minPartitionNum"
    try:
        spark.conf.set(key, "7")
        made = build()
        spark.conf.set(key, "1")
        return sorted(map(tuple, made.collect()), key=repr)
    finally:
        spark.conf.unset(key)


@pytest.mark.parametrize("in_files", [True, False])
def test_rows_do_not_follow_the_number_of_tasks(spark, in_files):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(9)
    if in_files:
        docs = corpus_pipeline.Scratch(spark).save(docs)
    want = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=repr)
    assert len(want) < docs.count()
    assert dealt_anew(spark, lambda: corpus_pipeline.near_duplicates(spark, docs, SF)) == want


def test_packing_does_not_follow_the_number_of_tasks(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "1 + pmod(hash(id), 900) AS length").repartition(9)
    saved = corpus_pipeline.Scratch(spark).save(rows)
    got = dealt_anew(spark, lambda: corpus_pipeline.packing.pack(saved, shard_items=256, generations=1, epochs=1))
    assert sorted(r[0] for r in got) == list(range(3000))
    fill = {}
    for _, length, sequence, offset in got:
        fill.setdefault(sequence, []).append((offset, length))
    for parts in fill.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= corpus_pipeline.packing.CAPACITY
