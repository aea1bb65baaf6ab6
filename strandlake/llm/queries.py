"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch
from . import decontaminate, language_id, lexical, licenses, line_dedup, ngram_join, packing, quality, secrets, slack, topk, url_rules, vector_codes

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"), quality.held_out)
    return quality.score_quality(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs, out)
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op3_license_scan"] = licenses.oracle()


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a new ledger for each run: one that is kept would leave a second run nothing to scan."""
    versions = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    ledger = secrets.update_ledger(versions, scratch(spark, "ledger"))
    return secrets.digest(secrets.findings_by_path(versions, ledger))


ORACLES["op9_secret_scan"] = secrets.oracle()


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op7_line_dedup"] = line_dedup.oracle()


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op6_ngram_jaccard_join"] = ngram_join.oracle()


@query
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


ORACLES["op5_exact_top_k"] = topk.oracle()


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, url_rules.mine(pages, read(spark, sf_dir, "labels")))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The content of a public tokenizer's file; it goes to the tasks with their code."""
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "item_id", "overlap")


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.sha256(books)).alias("codebooks_sha256"))


ORACLES["op13_vector_codes"] = vector_codes.oracle()


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"), 10)


ORACLES["op11_ranked_search"] = lexical.oracle()


@query
def op12_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())
