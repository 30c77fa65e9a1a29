"""Registered queries of this package: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_dir
from . import langid, licences, pii
from .bayesdedup import near_duplicates
from .decontaminate import contaminated
from .hardnegatives import hard_negatives
from .hnsw import nearest_neighbours
from .linededup import dedup_lines
from .ngramjoin import jaccard_components
from .piecetable import sentencepiece_documents
from .repair import read_token_shards, write_token_shards
from .tables import documents
from .tokencount import count_tokens
from .wordruns import periodic_runs, with_repetition

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; the package that holds it is on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, root: str) -> DataFrame:
    out = jaccard_components(documents(spark, root), k=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


def op2_language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root).select("doc_id", "text", "lang")
    profiles = langid.learn_profiles(docs.filter(~langid.held_out()).filter("doc_id is not null"))
    out = langid.predict_languages(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_sentencepiece(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root).select("doc_id", "text")
    out = sentencepiece_documents(docs, vocabulary("piece_bpe_32k.model"), ["n_tokens", "ids_sha256", "decoded_sha256"])
    return out.drop("text")


def op4_token_counts(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root).select("doc_id", "text")
    return count_tokens(docs, vocabulary("piece_bpe_32k.model")).drop("text")


def op5_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    out = dedup_lines(documents(spark, root))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_nearest_neighbours(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.parquet(f"{root}/embeddings.parquet").select("vec_id", "embedding")
    return nearest_neighbours(rows, rows.filter("vec_id % 100 = 0"))


def op7_licence_scan(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root).select("doc_id", "text")
    out = licences.scan(docs, licences.learn(docs))
    return out.select("doc_id", "n_paragraphs", "n_licences", "families", "licences")


def op8_token_files(spark: SparkSession, root: str) -> DataFrame:
    path = scratch_dir(spark, "tokens")
    write_token_shards(documents(spark, root), path, vocabulary("word_bpe_49k.json"))
    return read_token_shards(spark, path)


def op9_personal_data(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root).select("doc_id", "text")
    return pii.find_personal_data(docs, pii.learn_field(docs)).drop("text")


def op10_decontamination(spark: SparkSession, root: str) -> DataFrame:
    return contaminated(documents(spark, root), spark.read.parquet(f"{root}/benchmark.parquet"))


def op11_periodic_runs(spark: SparkSession, root: str) -> DataFrame:
    docs = with_repetition(documents(spark, root).select("doc_id", "text"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    # greatest length / period by whole numbers; the runs come by start and period, so the first of equals stays
    best = F.aggregate(
        "runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b)
    )
    return (
        periodic_runs(docs)
        .withColumn("best", best)
        .select(
            "doc_id",
            F.size("runs").cast("bigint").alias("n_runs"),
            "best.start",
            "best.length",
            "best.period",
            F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
            F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


def op12_hard_negatives(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.parquet(f"{root}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.filter("vec_id % 100 = 0"))


def op13_minhash_dedup(spark: SparkSession, root: str) -> DataFrame:
    out = near_duplicates(documents(spark, root), k=2, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_language_id": op2_language_id,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_licence_scan": op7_licence_scan,
    "op8_token_files": op8_token_files,
    "op9_personal_data": op9_personal_data,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_minhash_dedup": op13_minhash_dedup,
}
