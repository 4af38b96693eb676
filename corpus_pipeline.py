"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.decontaminate import contamination
from sightline.llm.jaccard import near_duplicates
from sightline.llm.packing import pack
from sightline.llm.quality import base_failed, fit, rows_with_statistics, verdict
from sightline.llm.secrets import redact, secret_scan
from sightline.llm.tables import cut, remove, shared_folder, small_or_shuffled, table, unused, without


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or that the learned list rejects go."""
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return rows_with_statistics(docs).filter(~base_failed() & (verdict(rules) == 0)).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the least id, then the least text hash; rows without an id come last.

    Groups are of texts, so a null or reused id neither saves a copy nor takes another text along. Texts without words
    stay; of those with an id, a repeated row stays once.
    """
    same, k_same, k_id, grouped, t_id, t_same, nth, count = unused(docs, "same", "k_same", "k_id", "grouped", "t_id", "t_same", "nth", "n")
    rows = docs.withColumn(same, F.xxhash64("text"))
    groups = near_duplicates(rows, id_col=same).filter("n_shingles > 0")
    groups = cut(groups.select(F.col("doc_id").alias("same"), F.col("component_id").alias("group")).distinct())
    texts = rows.select(F.col(same).alias("same"), "doc_id").groupBy("same").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first"), F.count("*").alias("n"))
    texts = groups.join(texts, "same")
    kept = cut(texts.groupBy("group").agg(F.min(F.struct("first", "same", "n")).alias("k")).select("k.same", "k.first.doc_id", "k.n"))
    left = without(rows, groups.join(kept, "same", "left_anti").select(F.col("same").alias(same)))
    # of a text that stays, only the rows with the id that stays
    shared = small_or_shuffled(cut(kept.filter("n > 1").select(F.col("same").alias(k_same), F.col("doc_id").alias(k_id))))
    left = left.join(shared, F.col(same) == F.col(k_same), "left").filter(F.col(k_same).isNull() | F.col("doc_id").eqNullSafe(F.col(k_id)))
    left = left.withColumn(grouped, F.col(k_same).isNotNull()).drop(k_same, k_id)
    key = ["doc_id", same]
    twice = left.filter(F.col(grouped) | F.col("doc_id").isNotNull()).groupBy(*key).agg(F.count("*").alias(count))
    twice = cut(twice.filter(F.col(count) > 1).select(*key))
    if twice.isEmpty():
        return left.select(*docs.columns)
    again = small_or_shuffled(twice.select(F.col("doc_id").alias(t_id), F.col(same).alias(t_same)))
    repeated = left.join(again, F.col("doc_id").eqNullSafe(F.col(t_id)) & (F.col(same) == F.col(t_same)), "left_semi")
    once = repeated.withColumn(nth, F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(*docs.columns)))).filter(F.col(nth) == 1)
    return without(left, twice).select(*docs.columns).unionByName(once.select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go, by id and text: another text under the same id stays."""
    (same,) = unused(docs, "same")
    gone = contamination(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select("doc_id", F.col("same").alias(same))
    return without(docs.withColumn(same, F.xxhash64("text")), gone).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text."""
    return redact(docs, secret_scan(docs, F.col("source"), F.concat_ws("/", "source", "lang")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: No stage can be told in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, with a table in the shared folder between them. A table is deleted when
    the next one has been written; the last one stays for the result, which is worked out from it when it is read."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs
