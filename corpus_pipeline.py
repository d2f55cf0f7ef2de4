"""The corpus pipeline: language ID, exact and near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontaminate, exact, langid, packing, simhash
from lodestar.llm.common import discard, scratch_discarded, scratch_path, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is certain (operator 9).

    Null and empty texts and texts without a letter go; very long ones are read
    whole; rows repeated stay or go together; ties between languages go to the
    first by name.  Columns of any names are kept; an empty table stays empty.
    """
    return langid.drop_unidentified(docs, langid.learn(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of equal texts (operator 5).

    Null texts are empty and equal to each other; of equal texts the row with
    the smallest doc_id stays, a null doc_id last, and one of rows repeated under
    one doc_id.  Columns of any names are kept; an empty table stays empty.
    """
    return exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity of 0.8 or more (operator 1).

    The one with the smallest doc_id stays.  Null and empty texts and others
    without words are near copies of each other, texts of fewer than five words
    have one shingle; rows repeated under one doc_id stay or go together and rows
    without a doc_id stay.  Columns of any names are kept; an empty table stays
    empty.
    """
    return simhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a benchmark window (operator 7).

    Null and empty texts have no words and stay; very long ones are searched
    whole; rows repeated stay or go together; ties do not arise.  Columns of any
    names are kept; an empty table, or an empty benchmark, changes nothing.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences (operator 4).

    Null and empty texts are their closing id alone; long ones fill windows of
    their own; rows repeated are packed each; of windows that serve equally well
    the least filled one is taken.  Other columns are not given out; an empty
    table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", sequence_packing),
]

#: SQL has neither the field, the fingerprints nor the tokenizer; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table.

    What a stage wrote on its way goes when its result is written, and so does
    the result before it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        with scratch_discarded(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        if before is not None:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
