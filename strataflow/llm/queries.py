"""The operators' queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataflow.llm import chat_format, decontamination, minhash, mixing, ngram_lm, pii, quality_rules, ranked_search, simhash, substring_dedup, token_counts, toxicity, vector_codes
from strataflow.llm.shared import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": lambda spark, sf_dir: pii.report(documents(spark, sf_dir)),
    "op2_token_counts": lambda spark, sf_dir: token_counts.token_counts(documents(spark, sf_dir)),
    "op3_mixing": lambda spark, sf_dir: mixing.mix(documents(spark, sf_dir, "source")).select("doc_id", "size", "source_size", "target", "taken"),
    "op4_quality_rules": lambda spark, sf_dir: quality_rules.quality(documents(spark, sf_dir)),
    "op5_toxicity": lambda spark, sf_dir: toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op6_substring_dedup": lambda spark, sf_dir: substring_dedup.substring_dedup(documents(spark, sf_dir)),
    "op7_decontamination": lambda spark, sf_dir: decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
    "op8_ngram_lm": lambda spark, sf_dir: ngram_lm.language_model(documents(spark, sf_dir)),
    "op9_simhash": lambda spark, sf_dir: simhash.near_duplicates(documents(spark, sf_dir)),
    "op10_chat_format": chat_format.query,
    "op11_minhash": lambda spark, sf_dir: minhash.near_duplicates(documents(spark, sf_dir)),
    "op12_ranked_search": lambda spark, sf_dir: ranked_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
    "op13_vector_codes": lambda spark, sf_dir: vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
}

ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": quality_rules.ORACLE_SQL,
    "op6_substring_dedup": substring_dedup.ORACLE_SQL,
    "op11_minhash": minhash.ORACLE_SQL,
    "op12_ranked_search": ranked_search.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
