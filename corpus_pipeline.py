"""From raw documents to packed training sequences; each stage works on all that the one before kept.

toxicity: documents scored as toxic go. jaccard_join: of each component of similar documents the one
with the smallest id stays. substring_dedup: words of windows that occur more than once are cut out.
decontamination: passages of the benchmark are cut out. packing: what is left is tokenised and packed.
All stages but the last return the columns of documents. Only the first can be judged by a model alone
and none by SQL, so ORACLE_SQL is None; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatlake.llm import columns, decontaminate, jaccard, packing, storage, substrings, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Rows that go to a Python task at once: texts are long, and a task holds two batches of them.
BATCH_ROWS = 2000


def _in_small_batches(stage: Stage) -> Stage:
    """The stage, in a session whose Arrow batches have ``BATCH_ROWS`` rows, unless it sets a number of its own."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if spark.conf.get(name) == "10000":  # Spark's default
            spark.conf.set(name, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of the corpus, does not call toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = columns.free_name(docs, "_toxicity")
    return toxicity.score(docs, model, name).where(F.col(name) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word Jaccard links of 0.8 or more."""
    return jaccard.drop_similar(docs, shingle=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 35-word windows that occur elsewhere."""
    return substrings.drop_repeats(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 10-word windows of benchmark items."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


_STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("substring_dedup", cut_repeats), ("decontamination", cut_benchmark), ("packing", pack)]
STAGES = [(name, _in_small_batches(stage)) for name, stage in _STAGES]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.written(stage(spark, docs, sf_dir), name)
    return docs
