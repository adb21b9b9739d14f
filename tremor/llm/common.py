"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tremor-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    while name in df.columns:
        name += "_"
    return name


FILTER_BITS = 1 << 25


def likely_in(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys may be in ``wanted``: all that are, and a few more. For use before a join that moves long texts.

    A bitmap of key hashes, as (word, bits) rows, is broadcast: 2**25 bits, so 524,288 rows or 8 MB at most, whatever the input.
    The more keys are wanted, the less it holds back.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    bits = (wanted.select(place.alias("_p")).groupBy(F.shiftright("_p", 6).alias("_word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(_p & 63 as int)))").alias("_bits")))
    marked = df.withColumn("_p", place).withColumn("_word", F.shiftright("_p", 6))
    return marked.join(F.broadcast(bits), "_word").where("getbit(_bits, cast(_p & 63 as int)) = 1").select(df.columns)


def null_safe(df: DataFrame) -> DataFrame:
    """With doc_id as two columns without nulls, ID_KEY with ``mark``: a plain equality join, unlike one by ``<=>``, keeps the
    partitioning that a grouping by the same columns has left."""
    return df.withColumn("_id", F.coalesce("doc_id", F.lit(0))).withColumn("_none", F.col("doc_id").isNull())


ID_KEY = ["_id", "_none", "mark"]


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of ``docs(doc_id, mark, text)`` for each (doc_id, mark) in ``wanted``, with its other columns. Null ids match null
    ids. A text is shuffled once: the join goes by the columns that rows alike were grouped by."""
    few = null_safe(likely_in(docs, wanted, ["doc_id", "mark"])).dropDuplicates(ID_KEY)
    return few.join(null_safe(wanted).drop("doc_id"), ID_KEY).drop("_id", "_none")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(id, component)``: the smallest id that each id reaches.

    Each round takes the smallest label among neighbours and then jumps to that label's own label,
    so a chain of n links needs about log n rounds. Labels are written to the shared folder each round.
    Ids without an edge do not appear. An empty input gives an empty result.
    """
    links = staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
                   .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = (both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("other")), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other")))
        low = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "other").alias("low"))
        up = labels.select(F.col("id").alias("low"), F.col("component").alias("up"))
        now = staged(low.join(up, "low").select("id", "was", F.least("low", "up").alias("component")), "labels")
        changed = now.where("was <> component").limit(1).count()
        labels = now.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
