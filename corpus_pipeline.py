"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

A filtering stage lets a document go only on what its own operator says of it; all but the last return the columns
that came in.  Null, empty and repeated rows: a text that is null or without a letter goes in the first stage; of
repeated rows one stays after the third.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from genoloom.llm import decontaminate, jaccard_join, language, pieces, quality
from genoloom.llm.scratch import Scratch

#: A language is believed from this score on.
LEAST_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lets go of documents without a language, or with one that the classifier hardly believes."""
    model = language.train(docs.where(~language.held_out(5, 0)))
    return language.identify(docs, model).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lets go of documents below the classifier's threshold."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, model).where("keep").select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at a similarity of 0.8 or more, the one with the least doc_id stays;
    of repeated rows of one doc_id, the first by the other columns."""
    scratch = Scratch(spark)
    named = scratch.table(jaccard_join.jaccard_join(docs, width=5, threshold=(80, 100), scratch=scratch), "named")
    gone, many = (scratch.table(x, n) for x, n in (
        (named.where("doc_id <> component_id").select(F.col("doc_id").alias("k")).distinct(), "gone"),
        (named.where("doc_id is not null").groupBy(F.col("doc_id").alias("k")).count().where("count > 1").select("k"), "many"),
    ))
    left = docs if gone.isEmpty() else scratch.without(docs, gone, {"k": _key(F.col("doc_id"))})
    if many.isEmpty():
        return left
    # rows of one doc_id: the first by its other columns
    row, nth, k = (c + uuid.uuid4().hex for c in ("row", "nth", "k"))
    rows = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias(row), F.col("doc_id").cast("long").alias(k))
    again = rows.join(many.withColumnRenamed("k", k), k, "left_semi")
    once = again.withColumn(nth, F.row_number().over(W.partitionBy(k).orderBy(F.to_json(row)))).where(F.col(nth) == 1).select(f"{row}.*")
    return scratch.without(left, many, {"k": _key(F.col("doc_id"))}).union(once)


def _key(doc_id):
    """doc_id, never null: a null one is as no other."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lets go of documents that hold a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left: doc_id, source, lang, n_pieces, ids, score and second score of the segmentation."""
    rows = pieces.encode(docs, n=2)
    return rows.select(F.col("doc_id").cast("long"), "source", "lang", F.size("ids").cast("long").alias("n_pieces"), "ids", F.get("scores", F.lit(0)).alias("score"), F.get("scores", F.lit(1)).alias("score_2"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: No stage of learned models can be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what its predecessor wrote in the folder that executors share."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
