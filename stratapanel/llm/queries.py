"""Bound queries of the llm operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratapanel.llm import chat_format, conversation_repair, decontaminate, html_extract, importance_resampling, minhash_forest, ngram_jaccard, packing, quality_classifier, quality_rules, secret_scan, store, suffix_dedup, token_files
from stratapanel.llm.tokens import tokenizer_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.cut(table(spark, folder, "documents"), tokenizer_path(), end_id=0, capacity=2048)
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(digests, capacity=2048)


@query
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    read = token_files.round_trip(table(spark, folder, "documents"), tokenizer_path(), end_id=2)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents"))
    count = lambda k: F.size(F.filter("certain", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.listed(F.col("certain")), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


@query
def op3_reply_trees(spark: SparkSession, folder: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat_format.read_back(chat_format.formatted(store.written(chat_format.threads(rows), "threads")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, folder, "documents"))
    m = F.col("measures")
    return judged.select(
        "doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ((m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])).alias("base_failed"), "kept")


ORACLES["op6_quality_rules"] = quality_rules.ORACLE


@query
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = quality_classifier.fitted(docs, labels.where(fold != 0).select("doc_id", F.col("quality").alias("label")))
    scores = quality_classifier.scored(docs, model)
    return scores.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extracted(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.regions(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard.joined(table(spark, folder, "documents"), words=4, threshold=85)


@query
def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, folder, "documents"), length=50)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults planted by crc32 of ``conv_id:turn``; nulls become one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), copies.alias("copies"))
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies", "copy")


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    fixed, report = conversation_repair.repaired(damaged(rows))
    every = rows.select(F.col("conv_id").cast("bigint").alias("original")).distinct()
    sums = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = every.join(report, F.col("original").eqNullSafe(F.col("conv_id")), "left").join(conversation_repair.digests(fixed), F.col("original").eqNullSafe(F.col("conv")), "left")
    return found.select(F.col("original").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in sums],
                        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query
def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance_resampling.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op13_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_forest.clustered(table(spark, folder, "documents"), words=3, threshold=85)
