"""What the line join shuffles, and what parts words in it."""

from __future__ import annotations

from demandloom.llm import line_dedup
from demandloom.llm._shared import Scratch


def test_line_join_shuffles_no_class_by_signature_in_its_passes(spark, monkeypatch):
    """The classes that are done are told to the passes: no pass joins all classes with them by a shuffle."""
    plans, save = [], Scratch.save

    def watch(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df)

    monkeypatch.setattr(Scratch, "save", watch)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = [f"w{k}" for k in range(12)]
        rows = [(i, " ".join(words[:10] + [f"x{i}"]) + "\n" + " ".join(f"y{i}_{k}" for k in range(8))) for i in range(6)]
        out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
        got = {r.doc_id: r.n_removed_lines for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {0: 0} | dict.fromkeys(range(1, 6), 1)
    passes = [p for p in plans if "posexplode(prefix" in p]
    assert len(passes) == line_dedup.PASSES
    assert not [p for p in passes if "Exchange hashpartitioning(sig#" in p]


def test_white_space_of_every_kind_parts_words(spark):
    rows = [(1, "a\tb  c\x0bd\x0ce\rf g h"), (2, "  h g f e d c b a "), (3, "a\xa0b c d e f g h")]
    got = {r.doc_id: (r.n_removed_lines, r.text) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, rows[0][1]), 2: (1, ""), 3: (0, rows[2][1])}
