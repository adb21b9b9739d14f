"""Repeated byte strings of at least ``length`` bytes, anywhere in a corpus.

Every window of ``length`` bytes has one anchor: of the ``k``-byte strings in it the one with the smallest
hash, leftmost on ties. The choice depends on the window's bytes alone, so equal windows have equal anchors at equal
offsets, and windows need to be compared only where their anchors are equal. The windows of one anchor are a run; the bytes
that they cover are its block. Work then goes from coarse to fine, and each step leaves only what is still open:

1. anchors that occur once: none of their windows repeats;
2. anchors all of whose occurrences have the same block: every window repeats;
3. the rest: each distinct block gives its windows' digests once, weighted by its occurrences.

Polynomial hashes only choose anchors, where equal hashes of different strings cost work and nothing else. Blocks and windows are
equal if their anchors and their BLAKE2b digests of 64 bits are: a polynomial modulo 2**64 has equal values for strings that are
easily found.

Each step is a grouped count with partial sums, so a group of copies of any size is one row for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import staged, texts_of
from tremor.llm.wordhash import chunks, mix, powers, prefix_hash

LENGTH = 400
K = 200
HOT = 4096  # keys with more than one in HOT of all rows, fewer than HOT, are broadcast
PART = 1 << 19  # bytes of texts that a task takes at once
CUT = 1 << 22  # longer texts are taken in parts, which also keeps positions within _LOW
_LOW = np.uint64((1 << 24) - 1)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of v[i:i + w] for each i with a full window."""
    n = len(v)
    if n < w:
        return v[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(v.dtype).max, v.dtype)
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    back = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[: n - w + 1], back[w - 1 : n])


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((h[end] - h[start]) * powers(len(h))[1][start])


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    raw = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), end.tolist())]), np.uint64)


def anchor_runs(data: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (text, first window in the text, number of windows, anchor hash, block digest).

    Long data is taken in parts that overlap by ``length`` - 1 bytes, so each window is in one part; a border splits a run,
    which costs work only."""
    most = max(min(int(_LOW) + 1, CUT), length)
    if len(data) <= most:
        return _runs_in(data, off, length, k)
    parts, step = [_runs_in(data[:0], off[:1], length, k)], most - length + 1
    for t, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        for at in range(a, b - length + 1, step):
            part = data[at : min(at + most, b)]
            _, lo, *rest = _runs_in(part, np.array([0, len(part)]), length, k)
            parts.append((np.full(len(lo), t), lo + (at - a), *rest))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _runs_in(data: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    n = len(data)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < length:
        return none
    h = prefix_hash(data)
    at = np.arange(n - k + 1)
    grams = span_hash(h, at, at + k)
    low = sliding_min((grams & ~_LOW) | at.astype(np.uint64), length - k + 1)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(low)]
    ok = np.arange(len(low)) + length <= off[text + 1]
    first = np.flatnonzero(ok)
    if not len(first):
        return none
    place = (low[first] & _LOW).astype(np.int64)
    new = np.ones(len(first), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[first[1:]] != text[first[:-1]])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(first)))
    lo, t = first[head], text[first[head]]
    return t, lo - off[t], size, grams[place[head]], digests(data, lo, lo + size - 1 + length)


def _runs_of(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, uid = batch.column("key"), batch.column("text")
        for i, _, data, off in chunks(uid, PART):
            t, lo, size, gram, block = anchor_runs(data, off, length, k)
            yield pa.RecordBatch.from_arrays(
                [key.take(pa.array(t + i)), pa.array(lo.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(block.view(np.int64))],
                names=["key", "lo", "size", "gram", "block"])


def _windows_of(batches: Iterator[pa.RecordBatch], length: int, places: int) -> Iterator[pa.RecordBatch]:
    """For the listed blocks of each text: digest of every window, with its anchor, place (block id * places + place in the block) and weight.
    Windows of one anchor are length - k + 1 at most."""
    for batch in batches:
        blocks = batch.column("blocks").to_pylist()
        for i, j, data, off in chunks(batch.column("text")):
            for row in range(i, j):
                for part in range(0, len(blocks[row]), 2000):
                    out = []
                    for b in blocks[row][part : part + 2000]:
                        start = off[row - i] + b["lo"] + np.arange(b["size"])
                        out.append((np.full(len(start), b["anchor"]), digests(data, start, start + length), b["rid"] * places + np.arange(len(start)), np.full(len(start), b["times"])))
                    anchor, window, place, times = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(window.view(np.int64)), pa.array(place), pa.array(times)], names=["anchor", "window", "place", "times"])


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of [start, end) rows as maximal disjoint rows."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    head = np.flatnonzero(new)
    return np.stack([spans[head, 0], reach[np.append(head[1:], len(spans)) - 1]], axis=1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, count, digest, spans_out = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
            raw, at, keep = text.as_buffer().to_pybytes() if hasattr(text, "as_buffer") else text.as_py().encode(), 0, hashlib.sha256()
            spans = merged(np.array([[s["start"], s["end"]] for s in spans]))
            for a, b in spans.tolist():
                keep.update(raw[at:a])
                at = b
            keep.update(raw[at:])
            removed.append(int((spans[:, 1] - spans[:, 0]).sum()))
            count.append(len(spans))
            digest.append(keep.hexdigest())
            spans_out.append([{"start": a, "end": b} for a, b in spans.tolist()])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()),
             pa.array(spans_out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["doc_id", "mark", "n_removed", "n_spans", "kept_sha256", "spans"])


def rows_in(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``rows`` whose key is in ``groups``, which has each key once, with ``n``, its number of rows, and columns to add.

    A key of more than one in HOT rows is broadcast and its rows stay where they are, so that they don't meet in one task; there are
    fewer than HOT such keys, whatever the input. The other keys' rows are shuffled.
    """
    often = F.col("n") > max(1, rows.count() // HOT)
    hot, others = groups.where(often).drop("n"), groups.where(~often).drop("n")
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(others, keys))


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc_id, mark, start, end): byte spans covered by ``length``-byte strings that start at two places at least.

    ``docs`` has (doc_id, mark, text); mark is a hash of the text, so rows with one doc_id and different texts stay apart.
    Rows that are alike in both count as two places and share their spans. Spans may overlap.
    """
    per_block = length - k + 1
    runs = docs.select(F.struct("doc_id", "mark").alias("key"), "text").where(F.octet_length("text") >= length)
    runs = staged(runs.mapInArrow(lambda it: _runs_of(it, length, k), "key struct<doc_id:long,mark:long>, lo int, size int, gram long, block long")
                  .select("key.*", "lo", "size", "gram", "block"), "runs")
    grams = staged(runs.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    again = staged(rows_in(runs, grams, ["gram"]), "again")
    times = again.groupBy("gram", "block").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "mark", "lo", "size")).alias("one"))
    times = staged(times.withColumn("rid", F.monotonically_increasing_id()), "blocks")
    whole = (rows_in(again, times.where("times > 1").select("gram", "block", F.col("times").alias("n")), ["gram", "block"])
             .select("doc_id", "mark", F.col("lo").cast("long").alias("start"), (F.col("lo") + F.col("size") - 1 + length).cast("long").alias("end")))
    # the smallest block id of a gram names it: of windows at one anchor only those of equal digests are taken as equal
    mixed = times.groupBy("gram").agg(F.count("*").alias("n"), F.min("rid").alias("anchor")).where("n > 1")
    todo = rows_in(times, staged(mixed, "mixed"), ["gram"]).select("one.*", "rid", "times", "anchor").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "size", "rid", "times", "anchor")).alias("blocks"))
    todo = staged(todo, "todo")
    texts = texts_of(docs, todo).select("text", "blocks")
    windows = staged(texts.mapInArrow(lambda it: _windows_of(it, length, per_block), "anchor long, window long, place long, times long"), "windows")
    met = staged(windows.groupBy("anchor", "window").agg(F.sum("times").alias("n")).where("n > 1").select("anchor", "window"), "met")
    # runs of neighbouring windows, so that a text gets a row for each run and not for each byte; a block has ``per_block`` windows at most
    order = Window.partitionBy("rid").orderBy("place")
    places = (windows.where("times = 1").select("anchor", "window", "place").join(met, ["anchor", "window"]).select(F.expr(f"place div {per_block}").alias("rid"), (F.col("place") % per_block).alias("place"))
              .withColumn("run", F.col("place") - F.row_number().over(order)).groupBy("rid", "run").agg(F.min("place").alias("low"), F.max("place").alias("high"))
              .join(times.where("times = 1").select("rid", "one"), "rid")
              .select("one.doc_id", "one.mark", (F.col("one.lo") + F.col("low")).cast("long").alias("start"), (F.col("one.lo") + F.col("high") + length).cast("long").alias("end")))
    return whole.unionByName(places)


def remove_repeats(documents: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """Remove every byte of ``text`` that a ``length``-byte string covers which also starts elsewhere, in any document.

    One row for each row of ``documents``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes), spans
    (start and end byte of each removed run). Strings are judged on the input. Texts are UTF-8 bytes; null is empty; texts
    under ``length`` bytes keep all. Other columns are ignored. Rows alike in doc_id and text count as two documents.
    An empty table gives an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    spans = staged(repeated_spans(docs, length, k).distinct().groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    hit = texts_of(docs, spans).select("doc_id", "mark", "text", "spans")
    cut = hit.mapInArrow(_cut, "doc_id long, mark long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    base = docs.select("doc_id", "mark", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return base.alias("b").join(cut.alias("c"), F.expr("b.doc_id <=> c.doc_id and b.mark = c.mark"), "left").select(
        "b.doc_id", "b.n_bytes", F.coalesce("c.n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("c.n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("c.kept_sha256", "b.sha").alias("kept_sha256"), F.coalesce("c.spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"))
