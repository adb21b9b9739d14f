"""Similarity self-join of documents on word shingles by Jaccard, exact, and its connected groups.

Prefix filter with extended prefixes. All shingles have one order: those of the rare class by hash, then those of the
frequent class by hash. With n shingles and threshold t, two sets with Jaccard >= t share two shingles at least within their
first n - ceil(t n) + 2. The two smallest shared ones are met like this: if one of them is rare, it is a key by itself; if
both are frequent, the pair of them is a key (a two-token combination). So a passage that thousands of documents share
makes no long list, unless a document consists of such passages. The frequent class has a bound (``most_frequent``);
which shingles are in it changes only the work, never the result.

Documents with equal sets are one node. In a key's list each node is compared with the list's head; then nodes in
different components are compared with each other, those outside the list's largest component with all. The head of a list of
over LONG nodes is its most central one: each node is held against one random node of each of its lists, and the one that is
close to most of them leads. In a large group of near copies that is the least edited one, so few links are left for
the second comparison. Any head gives the same groups. A pair of the second comparison must first pass a filter by parities:
each of BITS bits says whether a set has an odd number of shingles with that hash, so the bits that differ are at most as many
as the shingles that only one of the two has. Every link is decided on whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import components, likely_in, staged, texts_of
from tremor.llm.wordhash import Words, chunks, mix

SMALL = 400  # sets up to here take two-token combinations
FREQUENT = 64
MOST_FREQUENT = 1 << 20
BITS = 1024
LONG = 16  # lists of more nodes get their most central one as head


def prefix_size(n: int, percent: int, extra: int) -> int:
    return min(n, n - -(-percent * n // 100) + extra)


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _pieces(batches, words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Runs of rows of about 2 MB of text with their sets: a task holds one at once, however many keys a batch's rows have."""
    for batch in batches:
        for i, j, data, off in chunks(batch.column("text")):
            yield batch.slice(i, j - i), list(Words(data, off).sets(words))


def parity(s: np.ndarray, bits: int = BITS) -> np.ndarray:
    """``bits`` bits as 64-bit words: whether an odd number of the set's hashes have that place modulo ``bits``. The places where
    two sets' bits differ are those of their symmetric difference with odd counts, so never more than its size."""
    odd = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def close(x: str, y: str, x_size: str, y_size: str, percent: int) -> str:
    """SQL: two sets with these parity bits and sizes may reach the threshold."""
    far = " + ".join(f"bit_count({x}[{k}] ^ {y}[{k}])" for k in range(BITS // 64))
    return f"{100 + percent} * ({far}) <= {100 - percent} * ({x_size} + {y_size})"


def _nodes(batches, words):
    for batch, sets in _pieces(batches, words):
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.list_(pa.int64()))],
            names=["doc_id", "mark", "n_shingles", "node", "bits"])


def _longs(parts: list, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))], names=[name])


def _heads(batches, words, percent):
    """The first shingles by hash, twice the plain prefix: where frequent ones would do harm."""
    for _, sets in _pieces(batches, words):
        yield _longs([s[: 2 * prefix_size(len(s), percent, 1)] for s in sets], "shingle")


def keys_of(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of a set of sorted shingles; ``frequent`` is sorted."""
    take = prefix_size(len(s), percent, 2)
    common = np.zeros(len(s), bool)
    if len(frequent):
        at = np.searchsorted(frequent, s)
        common = frequent[np.minimum(at, len(frequent) - 1)] == s
    rare, often = s[~common][:take], s[common]
    often = often[: take - len(rare)]
    out = [rare]
    if len(s) <= SMALL and len(often) > 1:
        a, b = np.triu_indices(len(often), 1)
        out.append(mix(often[a] * np.uint64(0x9E3779B97F4A7C15) + often[b]))
    if len(s) * 100 > SMALL * percent:
        out.append(often)
    return np.concatenate(out)


def _index(batches, words, percent, frequent):
    table = np.frombuffer(frequent.value, np.uint64)
    for _, sets in _pieces(batches, words):
        key, node, size = [], [], []
        for s in sets:
            if len(s) * (100 - percent) >= percent:  # smaller sets reach the threshold with equal ones only
                key.append(keys_of(s, table, percent))
                node.append(np.full(len(key[-1]), node_of(s)))
                size.append(np.full(len(key[-1]), len(s), np.int32))
        if key:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(node)), pa.array(np.concatenate(size))], names=["key", "node", "size"])


BUCKETS = 256


def profile(s: np.ndarray) -> np.ndarray:
    """Number of shingles in each of BUCKETS hash ranges. The sum of two profiles' smaller entries bounds the intersection."""
    return np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=BUCKETS).astype(np.uint32)


def _whole_sets(batches, words):
    for batch, sets in _pieces(batches, words):
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array([profile(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "profile", "shingles"])


def _reach(batches, percent, overlap):
    """Keeps (a, b) whose ``xs`` and ``ys`` have enough in common for the threshold; ``overlap`` gives (both, size x, size y)."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("xs"), batch.column("ys")):
            both, n, m = overlap(x.as_py(), y.as_py())
            keep.append(100 * both >= percent * (n + m - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def at_most(x: bytes, y: bytes) -> tuple[int, int, int]:
    p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    return int(np.minimum(p, q).sum()), int(p.sum()), int(q.sum())


def exactly(x: bytes, y: bytes) -> tuple[int, int, int]:
    s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    at = np.searchsorted(s, t)
    return int((s[np.minimum(at, len(s) - 1)] == t).sum()), len(s), len(t)


def linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets reach the threshold. One text of each node is read; only sets that the bound by
    profiles lets through are moved."""
    ends = lambda p: p.select(F.col("a").alias("node")).union(p.select(F.col("b").alias("node"))).distinct()
    one = nodes.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("one")).join(ends(pairs), "node").select("node", "one.doc_id", "one.mark")
    one = staged(one, "wanted")
    texts = texts_of(docs, one).select("node", "text")
    sets = staged(texts.mapInArrow(lambda it: _whole_sets(it, words), "node long, profile binary, shingles binary"), "sets")

    def both(p: DataFrame, s: DataFrame, column: str) -> DataFrame:
        return (p.join(s.select(F.col("node").alias("a"), F.col(column).alias("xs")), "a")
                .join(s.select(F.col("node").alias("b"), F.col(column).alias("ys")), "b").select("a", "b", "xs", "ys"))

    near = staged(both(pairs, sets, "profile").mapInArrow(lambda it: _reach(it, percent, at_most), "a long, b long"), "near")
    return staged(both(near, likely_in(sets, ends(near), ["node"]), "shingles").mapInArrow(lambda it: _reach(it, percent, exactly), "a long, b long"), "linked")


def jaccard_groups(documents: DataFrame, words: int = 4, percent: int = 85, frequent: int = FREQUENT, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """Groups of documents that Jaccard links on distinct ``words``-word shingles connect.

    Two documents link when 100 * intersection >= percent * union. A text with fewer words is one shingle; one without words,
    or null, has no shingle and links with nothing. Words are split at space and 0x09 to 0x0D; A-Z are lower-cased.
    One row for each row of ``documents``: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself
    included), links (number of links to other sets that were verified; enough to connect the group, not all of them).
    Different texts under one doc_id are sets of their own. A null doc_id belongs to the group of its text. Other columns are
    ignored; an empty table gives an empty result.
    """
    placed = placed_rows(documents.select("doc_id", "text").withColumn("mark", F.xxhash64(F.coalesce("text", F.lit("")))), words, percent, frequent, most_frequent)
    least = placed.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "group", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def placed_rows(documents: DataFrame, words: int, percent: int, frequent: int = FREQUENT, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """(doc_id, mark, n_shingles, node, group, links) for each row of ``documents``, which has (doc_id, mark, text): mark is a hash
    that differs where texts do; rows with one group are connected, null is a group of none."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), "mark", F.coalesce("text", F.lit("")).alias("text"))
    nodes = staged(docs.mapInArrow(lambda it: _nodes(it, words), "doc_id long, mark long, n_shingles long, node long, bits array<long>"), "nodes")
    top = (docs.select("text").mapInArrow(lambda it: _heads(it, words, percent), "shingle long").groupBy("shingle").count()
           .where(F.col("count") > frequent).orderBy(F.desc("count"), "shingle").limit(most_frequent).select("shingle").toArrow())
    table = np.sort(np.asarray(top.column(0).combine_chunks() if top.num_rows else np.zeros(0, np.int64)).view(np.uint64))
    shared = spark.sparkContext.broadcast(table.tobytes())  # 8 MB at most
    index = docs.select("text").mapInArrow(lambda it: _index(it, words, percent, shared), "key long, node long, size int")
    # written, as the join then deals out both sides anew and a frequent key's rows can be split
    heads = staged(index.groupBy("key").agg(F.min("node").alias("head"), F.min_by("size", "node").alias("head_size"), F.max("node").alias("last")).where("head <> last").drop("last"), "heads")
    lists = staged(index.join(heads, "key").groupBy("key", "node").agg(F.first("size").alias("size"), F.first("head").alias("head"), F.first("head_size").alias("head_size")), "lists")
    bits = nodes.where("node is not null").groupBy("node").agg(F.first("bits").alias("bits"))
    dealt = F.xxhash64("key", "node")
    of_long = lists.groupBy("key").agg(F.count("*").alias("n"), F.min_by("node", dealt).alias("other"), F.min_by("size", dealt).alias("other_size")).where(F.col("n") > LONG)
    long = staged(lists.select("key", "node", "size").join(of_long.drop("n"), "key"), "long")
    tried = long.join(bits.withColumnRenamed("bits", "x_bits"), "node").join(bits.select(F.col("node").alias("other"), F.col("bits").alias("y_bits")), "other")
    central = tried.groupBy("node").agg(F.count_if(F.expr(close("x_bits", "y_bits", "size", "other_size", percent))).alias("score"))
    best = long.join(central, "node").groupBy("key").agg(F.max(F.struct("score", "node", "size")).alias("best"))
    led = lists.join(best, "key", "left").select("key", "node", "size", F.coalesce("best.node", "head").alias("head"), F.coalesce("best.size", "head_size").alias("head_size"))
    led = staged(led.where("node <> head"), "led")
    fits = f"100 * least({{0}}, {{1}}) >= {percent} * greatest({{0}}, {{1}})"
    star = staged(led.where(fits.format("size", "head_size")).select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct(), "pairs")
    links = linked(star, nodes, docs, words, percent)
    found = components(links)
    # what the stars leave: lists whose other nodes are in several components
    rest = led.select("key", "node", "size").join(found.select(F.col("id").alias("node"), "component"), "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("component"))
    rest = staged(rest, "rest")
    parts = rest.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("top.component").alias("main"))
    main = staged(main, "main")
    open_lists = staged(rest.join(main, "key").join(bits, "node"), "open")
    x = open_lists.where("component <> main").select("key", "main", *(F.col(c).alias(f"x_{c}") for c in ("node", "size", "component", "bits")))
    y = open_lists.select("key", *(F.col(c).alias(f"y_{c}") for c in ("node", "size", "component", "bits")))
    more = x.join(y, "key").where("x_component <> y_component and (y_component = main or x_node < y_node) and " + fits.format("x_size", "y_size") + " and " + close("x_bits", "y_bits", "x_size", "y_size", percent)).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    more = staged(more.join(star, ["a", "b"], "left_anti"), "pairs")
    if more.limit(1).count():
        links = links.unionByName(linked(more, nodes, docs, words, percent))
        found = components(links)
    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    return nodes.drop("bits").join(found.withColumnRenamed("id", "node"), "node", "left").join(degree, "node", "left").withColumn("group", F.coalesce("component", "node"))
