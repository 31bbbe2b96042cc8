"""The corpus pipeline: STAGES over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm import jaccard_join, line_dedup, packing, quality_gam, substring_dedup
from demandloom.llm._shared import Scratch, fresh, load

#: Up to so many places (8 bytes each) are broadcast; beyond that the join shuffles.
BROADCAST_IDS = 1_000_000


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, n_chars brought up to the text."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, unchanged."""
    return quality_gam.score(docs, load(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that nearly repeat an earlier one; a text may become empty."""
    return _as_documents(line_dedup.dedup(docs), docs)


def _placed(docs: DataFrame, place: str, scratch: Scratch) -> DataFrame:
    """docs with a number for each row that no later read changes, however files are dealt to tasks.

    Of a table in files it is the file's number in the order of names, which is written
    (a row per file), and the row's place in its file; any other table is written with
    its numbers.
    """
    path, at, file = fresh(docs, "path", "at", "file")
    try:
        told = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(at))
    except AnalysisException:
        return scratch.save(docs.withColumn(place, F.monotonically_increasing_id()))
    files = scratch.save(told.select(path).distinct().coalesce(1).sortWithinPartitions(path).withColumn(file, F.monotonically_increasing_id()))
    return told.join(F.broadcast(files), path).select(*docs.columns, (F.shiftleft(file, 33) + F.col(at)).alias(place))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, null ids after all others, ties by place in the table.

    Rows are told apart by their place, so rows that share an id stay or go each by
    its own text.  Documents without words are linked with nothing and stay.
    """
    scratch, (place,) = Scratch(spark), fresh(docs, "place")
    rows = _placed(docs, place, scratch)
    found = jaccard_join.near_duplicates(rows, doc_id=place).select(F.col("doc_id").alias(place), "component_id")
    found = found.join(rows.select(place, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(place).alias("at")).alias("first")), place)
    groups = found.groupBy("component_id").agg(F.min("first").alias("kept"), F.count("*").alias("n")).where("n > 1").select("component_id", "kept")
    gone = scratch.save(found.join(groups, "component_id").where(F.col("first") != F.col("kept")).select(place))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return rows.join(gone, place, "left_anti").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that an earlier one holds."""
    return _as_documents(substring_dedup.remove(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", passages),
    ("best_fit_packing", pack),
]

#: The classifier's boosting and the genetic algorithm have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs
