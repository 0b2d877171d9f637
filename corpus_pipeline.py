"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept, and all but the last return the columns of
documents. `run` applies them to the documents of a folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import fresh, stored
from lodestrata.llm.near_dedup import near_duplicates
from lodestrata.llm.packing import pack
from lodestrata.llm.quality_rules import quality_rules
from lodestrata.llm.suffix_dedup import without_repeats
from lodestrata.llm.toxicity import not_toxic

#: Words of a shingle of near duplicates, as in op3; their least similarity in percent.
SHINGLE, SIMILARITY = 2, 80


def _keyed(docs: DataFrame, ordered: bool = False) -> tuple[DataFrame, str]:
    """docs with a number of each row, written once, and the name of that column; ordered: numbers rise with doc_id (null last), then with a hash of the text."""
    row = fresh(docs, "_row")
    if ordered:
        docs = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _of(keyed: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows of keyed whose number is the doc_id of a row of kept, without the number."""
    return keyed.join(kept.select(F.col("doc_id").alias(row)), row, "left_semi").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the fertility bands of their language; each row is judged by its own text."""
    keyed, row = _keyed(docs)
    rules = quality_rules(keyed.select(F.col(row).alias("doc_id"), "text", "lang"), public_tokenizers.path("piece_bpe_32k.model"))
    return _of(keyed, row, rules.where("kept")).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, learnt from the folder's labels, doesn't take for toxic."""
    return not_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near duplicates, in order of doc_id, null last; rows without words stay."""
    keyed, row = _keyed(docs, ordered=True)
    return _of(keyed, row, near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"), SHINGLE, SIMILARITY).where("kept")).select(*docs.columns)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages of 50 words and more that an earlier one holds, in order of doc_id, null last."""
    keyed, row = _keyed(docs, ordered=True)
    return without_repeats(keyed, by=row).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("toxicity", clean),
    ("near-dedup", deduplicated),
    ("suffix-array dedup", without_passages),
    ("packing", packed),
]

#: Vocabularies, a trained model and sketches can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
