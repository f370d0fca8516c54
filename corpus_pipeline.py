"""From raw documents to packed sequences: five stages, each one of the operators in ``tessella.llm``.

Every stage gets ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.  All but the last return the
columns of ``documents``; where a stage changes a text, ``n_chars`` follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import column, new_path, table, unused
from tessella.llm.labels import labelled_sample
from tessella.llm.line_dedup import line_dedup
from tessella.llm.packing import packed_digest
from tessella.llm.quality_crf import THRESHOLD, fit_quality, quality_scores
from tessella.llm.simhash import simhash_dedup
from tessella.llm.substring_dedup import substring_dedup


def _as_documents(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, in its order, with ``n_chars`` counted anew."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for label 1; texts are as they were."""
    model = fit_quality(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality"))
    (score,) = unused(docs.columns, "score")
    return quality_scores(docs, model, score_col=score).filter(F.col(score) >= THRESHOLD).select(*map(column, docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(line_dedup(docs), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return simhash_dedup(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(substring_dedup(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_digest(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("packing", pack),
]

#: SQL can express neither the classifier nor tokens; the tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
