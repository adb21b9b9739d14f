"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is cut into 2**BITS levels at its quantiles over the whole table, strings in their own order, so that a level's
number says how many rows lie below it and a frequent value takes as many numbers as it has rows. Rows are sorted by the curve
index of their levels and cut into runs of equal counts. Near rows of the curve are near in all dimensions, so a shard spans
short ranges of each and files can be skipped by their minimum and maximum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import staged

BITS = 8


def hilbert_index(levels: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Curve index of each row of ``levels`` (one column for each dimension, values under 2**bits)."""
    x = levels.T.astype(np.uint64).copy()
    n = len(x)
    one = np.uint64(1)
    for q in (one << np.uint64(b) for b in range(bits - 1, 0, -1)):
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (one << np.uint64(b) for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


@F.pandas_udf(T.LongType())
def _curve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series(hilbert_index(part.to_numpy()))


def number_level(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """Level of a number by its quantiles over ``df``; null is level 0."""
    steps = (1 << bits) - 1
    cuts = df.agg(F.percentile_approx(column, [k / steps for k in range(1, steps)], 10_000)).first()[0] or []
    return F.coalesce(F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < F.col(column))), F.lit(0)) if cuts else F.lit(0)


def text_cuts(df: DataFrame, column: str, bits: int = BITS) -> list[str]:
    """The values at each 2**bits-th part of the rows of ``df`` in the order of a string column; null counts as empty. Rows are counted by value,
    and values added up over ranges of them; the cuts alone, under 2**bits, reach the driver."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(value.alias("v")).agg(F.count("*").alias("n")).repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id())
    counts = staged(counts, "values")
    total, start = 0, {}
    for r in counts.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one number for each partition
        start[r.part] = total
        total += r.n
    if not total:
        return []
    ahead = F.create_map(*(F.lit(x) for kv in start.items() for x in kv))[F.col("part")]
    last = F.sum("n").over(Window.partitionBy("part").orderBy("v")) + ahead
    levels = 1 << bits
    spans = counts.withColumn("last", last).selectExpr("v", f"((last - n) * {levels}L) div {total} + 1 as lo", f"least((last * {levels}L) div {total}, {levels - 1}) as hi")
    return [r.v for r in spans.where("lo <= hi").select("v", F.explode(F.sequence("lo", "hi")).alias("k")).orderBy("k").collect()]


def text_level(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """Level of a string: the number of cuts below it."""
    cuts = text_cuts(df, column, bits)
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)) if cuts else F.lit(0)


def hilbert_shards(df: DataFrame, levels: list[Column], ties: list[str], shards: int) -> DataFrame:
    """``df`` with ``curve``, ``shard`` (0 to shards - 1) and ``slot`` (from 0, without gaps, in each shard).

    Shard counts are at most one apart. Rows at one point of the curve are ordered by ``ties``; rows alike in these
    too get their places in any order. Columns with the three names are replaced. Nulls are allowed in every column.
    """
    base = df.drop("curve", "shard", "slot").withColumn("curve", _curve(F.struct(*(c.cast("long").alias(f"d{i}") for i, c in enumerate(levels)))))
    order = [F.col("curve"), *(F.col(c).asc_nulls_first() for c in ties)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = base.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = staged(placed, "curve").withColumns({"_part": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = {r._part: r["count"] for r in placed.groupBy("_part").count().collect()}  # one number for each partition
    total, start, ahead = sum(counts.values()), {}, 0
    for k in sorted(counts):
        start[k] = ahead
        ahead += counts[k]
    if not total:
        return base.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    starts = F.create_map(*(F.lit(x) for kv in start.items() for x in kv))
    rank = (F.col("_in") + starts[F.col("_part")]).cast("long")
    shard = F.expr(f"cast((_rank * {shards}) div {total} as int)")
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.withColumn("_rank", rank).withColumn("shard", shard).withColumn("slot", F.col("_rank") - first).drop("_at", "_part", "_in", "_rank")


def shard_documents(documents: DataFrame, shards: int = 24) -> DataFrame:
    """Place of every document: doc_id, size (UTF-8 bytes of the text plus 8; null: 8), text_crc32, curve, shard, slot.

    Dimensions: size, source, lang. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    facts = documents.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col("source").cast("string"), F.col("lang").cast("string"))
    facts = staged(facts, "facts")
    return hilbert_shards(facts, [number_level(facts, "size"), text_level(facts, "source"), text_level(facts, "lang")], ["text_crc32", "doc_id"], shards).select("doc_id", "size", "text_crc32", "curve", "shard", "slot")


def write_shards(documents: DataFrame, path: str, shards: int = 24) -> None:
    """Write whole documents, a folder for each shard, rows along the curve: readers skip files by their statistics."""
    sized = documents.withColumn("_size", F.octet_length("text"))
    levels = [number_level(sized, "_size"), text_level(documents, "source"), text_level(documents, "lang")]
    hilbert_shards(sized, levels, ["doc_id"], shards).drop("_size").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
