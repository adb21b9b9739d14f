"""Prefix trie of conversations: which beginnings are shared, by how many, and what a cache of prefixes would save.

Turns are dictionary-encoded: each distinct (role, text) has a number, so texts are read once and never shuffled. The code
sequences of the conversations are sorted over range shards. Each shard is built into a ternary search tree, middle sequence
first, so that siblings are balanced; an iterative traversal adds members, leaves and savings from the leaves to the root.

A sorted order keeps the conversations of a node together, so only the nodes on the paths of a shard's first and last sequence
can go on in the shards beside it. These boundary nodes leave a shard as partial rows. Two neighbouring shards share exactly
the common prefix of the last sequence of one and the first of the other; a seam row for each node on it takes back what both
have counted once too often (a child, a leaf, the first use of each turn). Sums by node then are whole.

Defined cases: null role or text is empty; turns without conv_id belong to no conversation and are left out; turns with equal
numbers stand in the order of their codes; an empty table has no node; other columns are ignored. Copies of one conversation,
even a third of all, are dealt over shards by conv_id. A conversation's codes must fit one row (12 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import staged

#: Turns in one tree; a task builds one tree after another.
SHARD_TURNS = 1 << 16
TASK_TURNS = 1 << 17
WORD = r"[^\x20\x09-\x0D]+"
_NODE = pa.schema([
    ("kind", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()),
    ("task", pa.int32()), ("first", pa.list_(pa.int64())), ("words", pa.list_(pa.int32())), ("last", pa.list_(pa.int64()))])
_COLUMNS = ("kind string, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
            "saved_tokens long, ends string, task int, first array<long>, words array<int>, last array<long>")
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def encoded(turns: DataFrame) -> DataFrame:
    """``(conv_id, codes array<long>, words array<int>)`` of each conversation in the order of its turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = staged(turns.where("conv_id is not null").select(
        "conv_id", "turn", F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("int").alias("words")), "turns")
    codes = staged(told.groupBy("digest").agg(F.max("words").alias("words")).withColumn("code", F.monotonically_increasing_id()), "turn-codes")
    one = F.struct("turn", "code", "words")
    return (told.drop("words").join(codes, "digest").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
            .select("conv_id", F.col("t.code").alias("codes"), F.col("t.words").alias("words")))


def rebuilt(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversation c with its first h = crc32(c) % most turns taken from conversation c - c % every (fewer if it has fewer)."""
    convs = staged(convs, "encoded")
    heads = convs.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), *(F.slice(c, 1, most - 1).alias(f"head_{c}") for c in ("codes", "words")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    both = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left")
    join = lambda c: F.concat(
        F.coalesce(F.slice(f"head_{c}", F.lit(1), F.col("h")), F.slice(c, 1, 0)), F.slice(c, F.col("h") + 1, F.size(c))).alias(c)
    return both.select("conv_id", join("codes"), join("words"))


class Tree:
    """Ternary search tree in flat lists. Node 0 is the root; ``same`` leads to the children, ``low``/``high`` to siblings."""

    def __init__(self):
        self.code, self.low, self.same, self.high = [-1], [-1], [-1], [-1]
        self.up, self.depth, self.words, self.convs, self.least, self.run = [-1], [0], [0], [0], [None], [-1]

    def child(self, node: int, code: int, words: int) -> int:
        at, links, where = self.same[node], self.same, node
        while at >= 0:
            if code == self.code[at]:
                return at
            links, where = (self.low if code < self.code[at] else self.high), at
            at = links[where]
        new = links[where] = len(self.code)
        for column, value in ((self.code, code), (self.low, -1), (self.same, -1), (self.high, -1), (self.up, node), (self.depth, self.depth[node] + 1),
                              (self.words, words), (self.convs, 0), (self.least, None), (self.run, -1)):
            column.append(value)
        return new

    def insert(self, codes: list[int], words: list[int], ids: list[int], run: int) -> None:
        node = 0
        for code, n in zip(codes, words):
            node = self.child(node, code, n)
        self.convs[node], self.least[node], self.run[node] = len(ids), min(ids), run

    def path(self, codes: list[int]) -> list[int]:
        """Nodes from the root along ``codes``, which the tree has."""
        out = [0]
        for code in codes:
            at = self.same[out[-1]]
            while code != self.code[at]:
                at = self.low[at] if code < self.code[at] else self.high[at]
            out.append(at)
        return out

    def totals(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """Nodes in an order that puts a parent before its children; children, leaves and savings of each node's subtree."""
        order, stack = [0], [self.same[0]]
        while stack:
            at = stack.pop()
            if at >= 0:
                order.append(at)
                stack += (self.high[at], self.low[at], self.same[at])
        kids, leaves, saved = ([0] * len(self.code) for _ in range(3))
        for at in reversed(order):
            leaves[at] += not kids[at]
            saved[at] += (self.convs[at] - 1) * self.words[at]
            if (up := self.up[at]) >= 0:
                kids[up] += 1
                leaves[up] += leaves[at]
                saved[up] += saved[at]
                self.convs[up] += self.convs[at]
                if self.least[up] is None or self.least[at] < self.least[up]:
                    self.least[up] = self.least[at]
        return order, kids, leaves, saved


def middles(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of each range before its halves."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            stack += ((m + 1, b), (a, m))


def prefix_keys(codes: list[int]) -> list[bytes]:
    """128-bit names of all prefixes of a sequence, the empty one first."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for code in codes:
        h.update(code.to_bytes(8, "little"))
        out.append(h.copy().digest())
    return out


def shard_rows(runs: list[tuple[list[int], list[int], list[int]]]) -> Iterator[dict]:
    """Nodes of one shard, given as sorted distinct (codes, words, conv_ids): whole ones, and partial ones with their ends."""
    tree = Tree()
    for k in middles(len(runs)):
        tree.insert(*runs[k], k)
    order, kids, leaves, saved = tree.totals()
    keys: dict[int, bytes] = {}
    for codes in (runs[0][0], runs[-1][0]):
        keys.update(zip(tree.path(codes), prefix_keys(codes)))
    for at in order:
        up, ids = tree.up[at], runs[tree.run[at]][2] if tree.run[at] >= 0 else []
        text = ",".join(map(str, ids))
        row = {"conv_id": tree.least[at], "depth": tree.depth[at], "n_convs": tree.convs[at], "n_children": kids[at], "n_leaves": leaves[at], "saved_tokens": saved[at],
               "parent_key": keys.get(up)}
        if at not in keys:
            yield row | {"kind": "whole", "parent_conv_id": None if up in keys else tree.least[up], "ends": hashlib.sha256(text.encode()).hexdigest()}
            continue
        yield row | {"kind": "part", "key": keys[at]}
        if ids:
            yield {"kind": "ends", "key": keys[at], "conv_id": ids[0], "ends": text}


def seam_rows(last: list[int], first: list[int], words: list[int]) -> Iterator[dict]:
    """What two neighbouring shards both count: ``last`` ends one, ``first`` (its turns have ``words``) begins the next."""
    n = 0
    while n < min(len(last), len(first)) and last[n] == first[n]:
        n += 1
    keys, twice = prefix_keys(first[:n]), 0
    for d in range(n, -1, -1):
        twice += words[d - 1] if d else 0
        yield {"kind": "part", "key": keys[d], "parent_key": keys[d - 1] if d else None, "depth": d, "n_convs": 0, "n_children": -(d < n), "n_leaves": -(len(last) == n), "saved_tokens": twice}


def _packed(rows: Iterator[dict], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, _NODE)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _NODE)


def _shards(batches: Iterator[pa.RecordBatch], shard_turns: int) -> Iterator[list]:
    """Sorted rows as runs of equal sequences, cut after about ``shard_turns`` turns."""
    runs: list[tuple[list[int], list[int], list[int]]] = []
    held = 0
    for batch in batches:
        for a in range(0, len(batch), 1000):
            part = batch.slice(a, 1000)
            for conv, codes, words in zip(*(part.column(c).to_pylist() for c in ("conv_id", "codes", "words"))):
                if runs and runs[-1][0] == codes:
                    runs[-1][2].append(conv)
                else:
                    runs.append((codes, words, [conv]))
                held += len(codes) + 1
                if held >= shard_turns:
                    yield runs
                    runs, held = [], 0
    if runs:
        yield runs


def _grow(batches: Iterator[pa.RecordBatch], shard_turns: int) -> Iterator[pa.RecordBatch]:
    def rows():
        first = last = None
        for runs in _shards(batches, shard_turns):
            yield from shard_rows(runs)
            if last is None:
                first = runs[0]
            else:
                yield from seam_rows(last, *runs[0][:2])
            last = runs[-1][0]
        if last is not None:
            yield {"kind": "edge", "task": TaskContext.get().partitionId(), "first": first[0], "words": first[1], "last": last}

    return _packed(rows())


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _packed(row for b in batches for last, first, words in zip(*(b.column(c).to_pylist() for c in ("last", "first", "words"))) for row in seam_rows(last, first, words))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the joined pieces of each key, which come one after another; no more than a piece is held."""
    def rows():
        key = h = None
        for batch in batches:
            for k, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if k != key:
                    if h:
                        yield key, h.hexdigest()
                    key, h = k, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(piece.encode())
        if h:
            yield key, h.hexdigest()

    found = list(rows())
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([v for _, v in found], pa.string())], ["key", "ends_sha256"])


def trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS, task_turns: int = TASK_TURNS) -> DataFrame:
    """A row for each distinct prefix of ``sequences(conv_id, codes, words)``, the empty one included; columns in OUT."""
    spark = sequences.sparkSession
    sequences = staged(sequences, "sequences")
    turns = sequences.agg(F.sum(F.size("codes") + 1).alias("n")).first()["n"] or 0
    sorted_ = sequences.repartitionByRange(turns // task_turns + 1, "codes", "conv_id").sortWithinPartitions("codes", "conv_id")
    found = staged(sorted_.mapInArrow(lambda it: _grow(it, shard_turns), _COLUMNS), "nodes")
    # one number for each task: what the driver holds grows with the tasks of one stage, not with their rows
    tasks = sorted(r["task"] for r in found.where("kind = 'edge'").select("task").collect())
    following = spark.createDataFrame(list(zip(tasks, tasks[1:])), "task int, next int")
    edge = found.where("kind = 'edge'")
    seams = (edge.select("task", "last").join(following, "task").join(edge.select(F.col("task").alias("next"), "first", "words"), "next")
             .select("last", "first", "words").mapInArrow(_seams, _COLUMNS))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    border = staged(found.where("kind = 'part'").union(seams).groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums), "border")
    pieces = found.where("kind = 'ends'").select("key", "conv_id", "ends")
    ends = pieces.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hashes, "key binary, ends_sha256 string")
    over = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    border = (border.join(ends, "key", "left").join(over, "parent_key", "left")
              .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))).withColumn("parent_conv_id", F.col("parent")))
    whole = found.where("kind = 'whole'").withColumn("ends_sha256", F.col("ends"))
    below = whole.where("parent_key is not null").join(over, "parent_key").withColumn("parent_conv_id", F.col("parent"))
    return border.select(OUT).union(whole.where("parent_key is null").select(OUT)).union(below.select(OUT))


def conversation_trie(turns: DataFrame, **sizes: int) -> DataFrame:
    """``trie`` over the rebuilt conversations of ``turns(conv_id, turn, role, text)``."""
    return trie(rebuilt(encoded(turns)), **sizes)
