"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents. Toxic documents, all but one of each group of near copies, and documents that hold
benchmark items go; personal data is masked in what is left; the last stage says where each piece of each document is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import decontaminate, ngram_join, packing, pii, toxicity
from tremor.llm.common import fresh, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(docs, labels).where("tox_predicted = 0").select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest doc_id stays, of several (or if all lack one) that of the least hash."""
    own, known, none = (fresh(docs, name) for name in ("_mark", "_known", "_none"))
    marked = docs.withColumn(own, F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns)))
    rows = staged(ngram_join.placed_rows(marked.select("doc_id", F.col(own).alias("mark"), "text"), 5, 80).where("group is not null").select("group", "doc_id", "mark"), "placed")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    least = rows.groupBy("group").agg(F.min(rank).alias("least"), F.max(rank).alias("last")).where("not (least <=> last)").select("group", "least")
    gone = rows.join(least, "group").where(~rank.eqNullSafe(F.col("least")))
    # rows alike in all columns are alike in this key, and the join goes by it too, so a text is shuffled once
    key = {known: F.coalesce("doc_id", F.lit(0)), none: F.col("doc_id").isNull()}
    gone = gone.withColumns(key).select(known, none, F.col("mark").alias(own)).distinct()
    return marked.withColumns(key).dropDuplicates([known, none, own]).join(gone, [known, none, own], "left_anti").select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", keep_one_of_near_copies), ("decontamination", drop_benchmark_leaks), ("pii", mask_personal_data), ("packing", pack_sequences)]

#: Learned scores and hashed sets have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
