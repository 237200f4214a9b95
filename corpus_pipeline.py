"""A training corpus from documents: quality rules, near-duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of
docs. Stages read what the one before wrote, so each starts from files and none is run twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow.llm import decontamination, mixing, pii, quality_rules, simhash
from strataflow.llm.shared import clear, cut, marked, unused


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null texts are empty, which the rules reject; repeated rows are judged each, alike; extra columns stay as they are."""
    verdict = unused(docs.columns, "quality_rules")
    return quality_rules.with_quality(docs).where(F.col(verdict)["kept"]).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document: that of the smallest doc_id, nulls last, and of the least hash of its text among those.

    Rows are known by id and text's hash, as ids may be null or repeated; of rows equal in both one
    stays, whatever its extra columns. Null texts are empty, and one group. The rows to keep grow with
    the documents, so the join is by sorting at every size, never by broadcast.
    """
    kept = cut(simhash.survivors(docs), "kept")
    kept_id, kept_hash, repeat = (unused(docs.columns, c) for c in ("kept_id", "kept_hash", "repeat"))
    once, several = (kept.where(x).select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash)) for x in ("n = 1", "n > 1"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.xxhash64("text") == F.col(kept_hash))
    out = docs.join(once.hint("merge"), same, "left_semi")
    if several.isEmpty():
        return out
    repeats = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    return out.unionByName(docs.join(several.hint("merge"), same, "left_semi").withColumn(repeat, F.row_number().over(repeats)).where(F.col(repeat) == 1).select(*docs.columns))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null texts hold none; repeated rows are judged each, alike; extra columns stay as they are."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind. Null texts stay null; repeated rows are redacted alike; extra columns stay as they are, also if they hold personal data."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, numbered by copy (copy_ where docs has a column copy). Null texts have no words; a null source is one; repeated rows are documents of their own; extra columns stay as they are."""
    return mixing.copies(docs)


STAGES = [
    ("quality rules", good),
    ("SimHash near-dedup", distinct),
    ("benchmark decontamination", clean),
    ("PII", private),
    ("mixing sources to target weights", mixed),
]

#: Fingerprints and the mix can't be expressed in SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What earlier stages left in the shared folder is deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = marked()
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
        clear(spark, start, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
