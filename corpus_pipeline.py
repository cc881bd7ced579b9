"""The corpus pipeline: quality, toxicity, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay, with the columns of documents; the last
returns the pieces of the packed sequences. Each works on all that its predecessor kept.

Null texts count as empty and null ids as ids of their own; repeated rows are copies of one another. Other columns,
whatever their names, are passed on as they are up to the packing. An empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandweave.llm import exact_dedup, packing, quality, simhash, toxicity
from bandweave.llm.common import materialize, unused


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score is below the quantile threshold go."""
    model = quality.train(docs, _labels(spark, sf_dir))
    score, predicted = unused(docs, "score", "predicted")
    return quality.score_documents(docs, model, score=score, predicted=predicted).where(F.col(predicted) == 1).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a noisy-or score of 0.5 or more go."""
    model = toxicity.train(docs, _labels(spark, sf_dir))
    (judged,) = unused(docs, "judged")
    return toxicity.score_documents(docs, model, locate=False, into=judged).where(F.col(f"{judged}.predicted") == 0).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.drop_near_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with a checksum of their ids."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(F.col("row_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("packing", packing_stage),
]

#: Trained models and tokenisation cannot be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
