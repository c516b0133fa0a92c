"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``.

1. quality rules: documents that a rule rejects go; repeated lines count from ten lines on.
2. n-gram Jaccard join: of each group of near duplicates (five words, similarity
   0.8) the document of least id stays.
3. benchmark decontamination: documents that hold a passage of ``benchmark`` go.
4. secret scans: secrets in the texts are replaced by a mark; ``n_chars`` follows.
5. best-fit packing: pieces of at most 2048 ids, each with its sequence and offset.

Defined results: those of the operators; an empty table runs through to no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratapanel.llm import decontaminate, ngram_jaccard, packing, quality_rules, secret_scan
from stratapanel.llm.store import written
from stratapanel.llm.tokens import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.judged(docs.select(COLUMNS), quality_rules.CORPUS_RULES).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.deduplicated(docs.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.cleaned(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut(docs, tokenizer_path(), end_id=0, capacity=2048), capacity=2048)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("best_fit_packing", packed),
]

#: Shingle sets, edit distances and packing are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
