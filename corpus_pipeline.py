"""Corpus pipeline: five stages over ``documents``, each one of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the one before has kept, and returns a DataFrame with the
columns of ``documents``; the last returns packed pieces. ``n_chars`` follows every change of the text. :func:`run` writes
each stage to the folder in ``spark.checkpoint.dir`` and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan import runtime
from larkspan.llm import bradley_terry, line_edit, packing, partenum, pii_crf
from larkspan.llm.common import free_name, materialize, release, written
from larkspan.llm.queries import tokenizer_path


#: Share of its characters that a document keeps at least when lines go that stand elsewhere; 1 less the similarity of near
#: copies.
LEAST_LEFT = 0.2


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` set to the length of the text, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at or above the decision point; others go."""
    runtime.ship(spark)
    ranker = bradley_terry.fit(docs, runtime.table(spark, sf_dir, "labels"))
    kept = docs.columns
    if ranker is None:
        return docs
    score = free_name(docs, "score")
    scored = bradley_terry.scored(docs, ranker, keep=kept, score=score)
    return scored.where(F.col(score) >= ranker.cut).select(*kept)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies and near copies of lines go, and documents that are near copies by them, of which little is left. Lines
    of fewer than 24 characters stay: list marks, brackets and refrains belong to their documents."""
    runtime.ship(spark)
    return _recounted(line_edit.without_duplicate_lines(docs, least_left=LEAST_LEFT))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 or more of their distinct five-word shingles, the least id stays."""
    runtime.ship(spark)
    found = partenum.similar_components(docs, k=5, percent=80)
    mark = free_name(docs, "gone")
    gone = materialize(found.where("component_id is not null and doc_id <> component_id").select(F.col("doc_id").alias(mark)).distinct())
    few = gone.count() <= partenum.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col(mark), "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in brackets."""
    runtime.ship(spark)
    return _recounted(pii_crf.redacted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and place."""
    runtime.ship(spark)
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_copies", near_copies), ("personal_data", personal_data), ("packing", packed)]

#: No stage but the first filter could be put in SQL, so the rows are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with written() as tables:
            kept = materialize(stage(spark, docs, sf_dir))
        # what a stage has written goes with its input
        release(*(t for t in (*tables, docs) if t is not kept))
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
