"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

All stages but the last return the columns of their input, clashing or extra names included, and work on any number of
rows, none included: an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, ngram_join, packing, pii, quality_knn
from tessera.llm.workspace import Workspace, table

TOKENIZER = "word_bpe_49k.json"


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Each row is judged by its text alone: repeated rows stay or go together, null and empty texts are scored by the
    sample's share of good rows, null ids and other nulls don't matter.  Without labels every row stays.
    """
    return quality_knn.keep_good(docs, table(spark, sf_dir, "labels"))


def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): that with the smallest doc_id.

    A row without id stays only where its group has none with one.  Rows without words, null texts included, all stay.
    """
    return ngram_join.keep_one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; benchmark spans are cut out of the others, and n_chars follows.

    Null and empty texts stay as they are; repeated rows are treated alike; an empty benchmark changes nothing.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, disguised forms included, is replaced by its kind, and n_chars follows; every row stays.

    Null and empty texts stay as they are; repeated rows are treated alike.
    """
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences; null and empty texts are one piece of one id, repeated rows pieces each."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality_classifier", classify), ("ngram_join", dedupe), ("decontamination", decontaminated), ("pii", redacted), ("best_fit_packing", packed)]
#: similarity groups, learned votes and packing have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k:
            ws.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
