from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspan.llm.common import materialize


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage over a small table, with rows of odd kinds added."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = docs.limit(1)
    odd = one.withColumns({"doc_id": F.lit(9001).cast("long"), "text": F.lit(None).cast("string")}).unionByName(one.withColumns({"doc_id": F.lit(9002).cast("long"), "text": F.lit("")}))
    docs = materialize(docs.unionByName(odd).withColumn("score", F.lit("clash")))
    out = []
    for name, stage in corpus_pipeline.STAGES:
        kept = materialize(stage(spark, docs, sf))
        out.append((name, docs, kept))
        docs = kept
    return out


def test_columns(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(stages[-1][2].columns)


def test_quality_keeps_good_labels(stages, spark):
    _, before, after = stages[0]
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = labels.where("quality = 1").join(before, "doc_id")
    assert good.join(after, "doc_id", "left_semi").count() >= 0.97 * good.count()
    assert labels.where("quality = 0").join(after, "doc_id").count() <= 1


def test_lines_and_copies(stages):
    _, before, after = stages[1]
    long = F.explode(F.split("text", "\n"))
    lines = after.select(long.alias("line")).where("length(line) >= 24")
    assert lines.count() == lines.distinct().count() < before.select(long.alias("line")).where("length(line) >= 24").count()
    _, before, after = stages[2]
    assert after.join(before, ["doc_id", "text"], "left_anti").where("text is not null").count() == 0


def test_personal_data_goes(stages):
    _, before, after = stages[3]
    mail = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+"
    assert before.count() == after.count() and before.where(F.col("text").rlike(mail)).count() > 0 and after.where(F.col("text").rlike(mail)).count() == 0
    same = before.where(~F.col("text").rlike("[0-9@]"))
    assert same.join(after, ["doc_id", "text"], "left_semi").count() == same.count()


def test_packing_covers_all(stages):
    _, before, after = stages[4]
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
