"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

1. language ID: documents without a recognisable language go;
2. line dedup: lines that at least ten documents share are cut;
3. near-dedup: one document of each class of near-duplicates stays, the one of the
   lowest id;
4. benchmark decontamination: documents that hold a ten-word window of a benchmark
   item go;
5. BPE: what is left is encoded, and decoded again from its ids.

Texts differ in length by orders of magnitude, so the stages hand ROWS_AT_A_TIME rows at a
time to Python, for a tenth of Spark's usual number: the session's setting
``spark.sql.execution.arrow.maxRecordsPerBatch`` is lowered to it, where it is higher.

Every stage works on all documents that the one before it kept. Null and empty
texts have no language and end at the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bpe, decontam, language_id, line_dedup, near_dedup
from framewright.scratch import write_table
from framewright.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Rows of an Arrow batch, a bound of what a task holds of texts outside the heap.
ROWS_AT_A_TIME = 1000

#: A document stays if its best language has at least this probability.
LEAST_SCORE = 0.5


def chosen(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents, to be handed over in small batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_AT_A_TIME:
        spark.conf.set(name, str(ROWS_AT_A_TIME))
    return docs.select(COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the languages that the labelled ones are in."""
    docs = chosen(spark, docs)
    model = language_id.train(docs)
    told = language_id.predict(docs, model, tuple(COLUMNS))
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that at least ten documents share; n_chars follows the text."""
    done = line_dedup.dedup_lines(chosen(spark, docs), min_docs=10, min_chars=1)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    return near_dedup.keep_one(chosen(spark, docs), least=0.8)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove documents that hold a window of a benchmark item."""
    return decontam.remove_contaminated(chosen(spark, docs), table(spark, sf_dir, "benchmark"), n=10)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left; doc_id, n_tokens, the ids and the text they decode to."""
    return bpe.encode_decode(chosen(spark, docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("bpe", bpe_stage),
]

#: Learned languages and signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
