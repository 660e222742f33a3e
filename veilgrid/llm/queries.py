"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.llm import codebooks, countjoin, decontaminate, interactions, linededup, mixing, neardup, quality, secrets, shards, tokens, urls, warc
from veilgrid.session import cut_lineage

#: The URL filter's entries: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Weights of the mixture's tree by level; values that are not listed weigh 1.
MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = [
    ("domain", "domain0", 4), ("domain", "domain1", 3), ("domain", "domain2", 2), ("lang", "en", 4), ("lang", "de", 2), ("lang", "fr", 2),
]
TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_domain(docs: DataFrame) -> DataFrame:
    """``domain``, which the table lacks: four of them, by the number at the end of the source's name."""
    number = F.regexp_extract("source", "([0-9]{1,9})$", 1).try_cast("int")
    return docs.withColumn("domain", F.concat(F.lit("domain"), (number % 4).cast("string")))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = cut_lineage(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        shards.text_link(F.col("text")).alias("link"),
    ), "text-keys")
    links = rows.select(shards.node_of(F.col("doc_id")).alias("node"), "link")
    placed = shards.shard_documents(rows, links, shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    rows = cut_lineage(quality.measured(docs).drop("text"), "measures")
    return quality.judged(rows).select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve_revisits(warc.crawl_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return resolved.select(
        F.expr("CAST(substring(record_id, 2) AS BIGINT)").alias("page_id"), "canonical", "outcome",
        F.expr("CAST(substring(response, 2) AS BIGINT)").alias("response_page"), warc.header_lines(F.col("headers")).alias("headers"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", mixing.word_tokens(F.col("text")).alias("n_tokens")))
    weights = spark.createDataFrame(MIX_WEIGHTS, "level string, name string, weight bigint")
    return mixing.mixed(cut_lineage(docs, "token-counts"), weights, MIX_LEVELS).select(
        "doc_id", "domain", "lang", "source", "n_tokens", "leaf_tokens", "leaf_budget", "epochs")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = linededup.with_bitmaps(docs, linededup.line_bitmaps(docs))
    return marked.select(
        "doc_id", F.size(linededup.lines_of(F.col("text"))).cast("long").alias("n_lines"),
        linededup.n_dropped(F.col("runs")).alias("n_dropped"),
        F.sha2(linededup.kept_text(F.col("text"), F.col("runs")), 256).alias("kept_sha256"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, tokenizer_path()).select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_findings(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "word_at", "nth", F.sha2("value", 256).alias("value_sha256"), *secrets.FEATURES, "score", "secret")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, neardup.Settings(words=2))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = codebooks.compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return codebooks.with_label_error(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return interactions.filter_audit(docs, table(spark, sf_dir, "labels"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countjoin.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sharding, op2_quality_rules, op3_revisits, op4_mixing, op5_url_filter, op6_decontamination, op7_line_dedup,
        op8_token_counts, op9_secret_scan, op10_near_duplicates, op11_vector_codes,
        op12_filter_interactions, op13_jaccard_join,
    )
}
