"""The corpus pipeline: documents through five operators, one after another.

Each stage gets what the one before kept, written and read again. The first
four return the columns of ``documents``; the last adds what training needs.
Each bounds the bytes of the batches that Spark sends to Python, in the session
and unless it has a bound: 10,000 rows, Spark's own, may be long documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapewatch.llm import langid
from tapewatch.llm.decontaminate import without_contaminated
from tapewatch.llm.linededup import dedup_lines
from tapewatch.llm.ngramjoin import jaccard_components
from tapewatch.llm.piecetable import sentencepiece_documents
from tapewatch.llm.queries import vocabulary
from tapewatch.llm.tables import documents, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def bounded(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH, None) is None:
            spark.conf.set(BATCH, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@bounded
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text shows a language stay; ``lang`` becomes the predicted one.

    Rejected: texts without any letter, and all texts where no document names
    a language to learn.
    """
    profiles = langid.learn_profiles(docs.filter(~langid.held_out()).filter("doc_id is not null"))
    out = langid.predict_languages(docs, profiles).filter(F.col("lang_pred") != langid.UNKNOWN)
    return out.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


@bounded
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds go; all documents stay, with what is left of their text."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


@bounded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 the one with the smallest id stays.

    Texts without words are linked with nothing and stay, as do rows with null
    id; of rows that repeat an id, all stay if the id does.
    """
    groups = jaccard_components(docs, k=5, percent=80)
    gone = staged(groups.filter("component_id <> doc_id").select("doc_id").distinct(), "near")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@bounded
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


@bounded
def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, their number and the text decoded from them."""
    return sentencepiece_documents(docs, vocabulary("piece_bpe_32k.model"), ["ids", "n_tokens", "decoded"])


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"stage-{name}")
    return docs
