"""From raw documents to token ids: quality rules, near-duplicate join, secret scans, source mixing and BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet into the shared
folder and reads it back as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import bpe, mixing, ngrams, quality, secrets
from lacuna.session import discard, materialize, ship

#: Near duplicates: words of a shingle and the least similarity in hundredths.
WIDTH, PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the line-first rules keep, without their failing lines; n_chars is that of the new text.

    Rows with null, empty or blank texts go, as they have too few words; repeated rows are each judged.
    """
    ship(spark)
    return quality.kept(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones, decided by row: the one with the smallest id, of rows that share it the one
    with the smallest hash, of rows that agree in everything one. Rows with null ids or without words stay."""
    ship(spark)
    return ngrams.representatives(docs, width=WIDTH, percent=PERCENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, the secrets in their texts masked and n_chars counted anew. Null texts stay null; repeated rows all stay."""
    ship(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: never, once or twice. Rows with null ids, texts or sources take part like any
    other; rows that repeat an id are taken alike."""
    ship(spark)
    return mixing.apply_mix(docs)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the ids of each row's text; null and empty texts have none."""
    ship(spark)
    ids = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_ids),
]

#: A classifier and an encoder are no SQL: the tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, whose columns may stand in any order. Texts may have any length; an empty table
    gives no rows; other columns are carried through every stage but the last, whatever their names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
            discard(before)  # the source itself was not written here and stays
    return docs
