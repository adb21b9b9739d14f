"""Benchmark decontamination: short test items inside long documents.

Size-partitioned MinHash containment search. Documents are domains and test items are queries. A plain MinHash of a long
document says next to nothing about a short item in it, so domains are partitioned by size: one with up to 2**p distinct
shingles has a one-permutation MinHash of 2**(p + EXTRA_BITS) bins, the smallest hash of each bin. A shingle is then its bin's
smallest with a chance of about 7/8, whatever the document's length, and an item's shingles are looked up in the bins. One
met bin makes a candidate: an item of q shingles with t q of them in a document is missed with a chance of (1/8)**(t q), so
items of few shingles (EXACT_BELOW) skip the thinning. Candidates are verified by exact containment of the whole sets.

Items come in blocks of at most BLOCK_SHINGLES shingles, a bounded broadcast; documents never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import fresh
from tremor.llm.wordhash import Words, chunks

WORDS = 5
PERCENT = 80
EXTRA_BITS = 2
EXACT_BELOW = 16
BLOCK_SHINGLES = 1 << 20
BLOCK_ITEMS = 20_000


def signature(s: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of sorted distinct shingles: the smallest hash of each bin, bins by size partition."""
    if len(s) < 2:
        return s
    bits = min(63, int(len(s) - 1).bit_length() + EXTRA_BITS)
    part = s >> np.uint64(64 - bits)
    head = np.ones(len(s), bool)
    head[1:] = part[1:] != part[:-1]
    return s[head]


def _has(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class Items:
    """A block of test items: their shingle sets, and which items have a shingle."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        keep = [k for k, s in enumerate(sets) if len(s)]
        self.ids, self.sets = [ids[k] for k in keep], [sets[k] for k in keep]
        flat = np.concatenate(self.sets) if keep else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(keep)), [len(s) for s in self.sets]) if keep else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.shingles, self.owner = flat[order], owner[order]
        short = np.array([len(s) < EXACT_BELOW for s in self.sets], bool)
        self.short = np.unique(self.shingles[short[self.owner]]) if keep else flat

    def owners(self, found: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.shingles, found, "left"), np.searchsorted(self.shingles, found, "right")
        return np.unique(np.concatenate([self.owner[x:y] for x, y in zip(a, b)])) if len(found) else np.zeros(0, np.int64)

    def search(self, s: np.ndarray, percent: int) -> Iterator[tuple[int, int, int]]:
        """(item, its shingles, shared ones) of the items that a document with shingles ``s`` holds."""
        if not len(s) or not len(self.shingles):
            return
        sig = signature(s)
        found = sig[_has(self.shingles, sig)]
        if len(self.short):
            found = np.union1d(found, s[_has(self.short, s)])
        for k in self.owners(found).tolist():
            q = self.sets[k]
            shared = int(_has(s, q).sum())
            if 100 * shared >= percent * len(q):
                yield self.ids[k], len(q), shared


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Distinct shingles of each text; none for texts with fewer words."""
    for _, _, data, off in chunks(texts):
        w = Words(data, off)
        for s, n in zip(w.sets(words), np.diff(w.first).tolist()):
            yield s if n >= words else s[:0]


def find_items(documents: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row, item_id, n_item, n_shared) of each document and each item with at least ``percent`` of its distinct
    ``words``-word shingles in the document; row is a hash of the text.

    Words are split at space and 0x09 to 0x0D; A-Z are lower-cased. Texts and items that are null or have fewer words hold and
    are nothing. Items alike in text are each found. Other columns are ignored. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    facts = items.agg(F.count("*"), F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()
    blocks = max(1, -(-facts[0] // BLOCK_ITEMS), -(-(facts[1] or 0) // BLOCK_SHINGLES))
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        block = spark.sparkContext.broadcast(Items(part.column("item_id").to_pylist(), list(shingle_sets(part.column("text"), words))))
        found = docs.mapInArrow(_searcher(block, words, percent), "doc_id long, row long, item_id long, n_item long, n_shared long")
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(block, words: int, percent: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [(k, *hit) for k, s in enumerate(shingle_sets(batch.column("text"), words)) for hit in block.value.search(s, percent)]
            at = pa.array([h[0] for h in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("row").take(at), *(pa.array([h[c] for h in hits], pa.int64()) for c in (1, 2, 3))],
                                             names=["doc_id", "row", "item_id", "n_item", "n_shared"])

    return search


def decontaminate(documents: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``documents`` without those that hold an item of ``benchmark``."""
    bad = find_items(documents, benchmark, words, percent).select(F.col("doc_id").alias("_d"), F.col("row").alias("_r")).distinct()
    row = fresh(documents, "_row")
    marked = documents.withColumn(row, F.xxhash64(F.coalesce("text", F.lit(""))))
    return marked.join(bad, marked["doc_id"].eqNullSafe(bad["_d"]) & (marked[row] == bad["_r"]), "left_anti").drop(row)
