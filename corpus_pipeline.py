"""From raw documents to token files in stages, each one operator of ``sightline.llm``.

Each stage works on all rows the one before it kept. Rows are judged one by one, under their id and a hash of their
text: rows that share an id, or have none, stay or go each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontamination, jaccard_join, mixing, quality_classifier
from sightline.llm.common import cut
from sightline.llm.queries import table, vocabulary
from sightline.llm.token_files import token_files


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled rows of the original table."""
    net = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, net)
    return scored.where(F.col("score") >= quality_classifier.THRESHOLD).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, of those with the smallest id."""
    return jaccard_join.representatives(docs, each_text=True)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a verified passage of the benchmark."""
    return decontamination.clean(docs, decontamination.leaks(docs, table(spark, sf_dir, "benchmark"), each_text=True))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each pass over a source that takes words of a document."""
    out = mixing.mixed_texts(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all that is left; a row per document as the files hold it."""
    return token_files(docs, vocabulary())


STAGES = [
    ("quality_classifier", good_quality),
    ("jaccard_join", one_of_near_copies),
    ("spaced_seed_leaks", not_in_benchmark),
    ("mixed_sources", mixed),
    ("token_files", write_tokens),
]

#: A trained network and a trained vocabulary can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
