"""What a task hands to Python at once is bounded, and a row passes one Python worker at a time."""

import pytest

from pitspark.llm import ngram_join, quality, repeats
from pitspark.llm.storage import BATCH_ROWS

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture()
def docs(spark):
    before = spark.conf.get(NAME)
    spark.conf.set(NAME, "10000")
    words = " ".join(f"w{i}" for i in range(200))
    yield spark.createDataFrame([(0, words), (1, words + " end"), (2, None), (3, "alone")], "doc_id long, text string")
    spark.conf.set(NAME, before)


@pytest.mark.parametrize("work", [repeats.removed_digests, ngram_join.groups, quality.keep])
def test_batches_are_small(spark, docs, work):
    work(docs)
    assert int(spark.conf.get(NAME)) == BATCH_ROWS


def test_smaller_batches_stay(spark, docs):
    spark.conf.set(NAME, "100")
    quality.keep(docs)
    assert spark.conf.get(NAME) == "100"


def test_untouched_texts_pass_one_python_worker(docs):
    plan = repeats.removed_digests(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")  # no step in Python follows that both branches pass
