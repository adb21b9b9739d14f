"""Quality rules on texts, and cross-document line frequency by host.

Base rules look at one text. The cross-document rule hashes normalised lines and counts, for each host, the documents in which
a line occurs. Lines in more than ``min_share`` of the host's documents are boilerplate of the host; ``min_docs`` is the evidence that
this takes in hosts of few documents. ``quality`` counts their words: a document that would lose more than ``max_lost`` of its
words is depleted and rejected. ``without_boilerplate`` gives the texts without them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import likely_in, staged
from tremor.llm.lines import count_words, digest
from tremor.llm.wordhash import Words, chunks

MIN_DOCS = 5
MIN_SHARE = 0.02
MAX_LOST = 0.3
WINDOW = 5
_SYMBOLS = re.compile(r"[#*$%&|<>]")
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(first: np.ndarray, window: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """For each text the words in WINDOW-word windows whose hash occurs twice or more in it."""
    out = np.zeros(len(first) - 1, np.int64)
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b - a < WINDOW + 1:
            continue
        _, inv, n = np.unique(window[a : b - WINDOW + 1], return_inverse=True, return_counts=True)
        at = np.flatnonzero(n[inv] > 1)
        if len(at):
            step = np.zeros(b - a + 1, np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + WINDOW, -1)
            out[k] = int((np.cumsum(step[:-1]) > 0).sum())
    return out


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base numbers of each text, and its distinct normalised lines as (line, words in all its occurrences)."""
    for batch in batches:
        stats: dict[str, list] = {c: [] for c in STATS}
        for i, j, data, off in chunks(batch.column("text")):
            w = Words(data, off, lower=False)
            lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
            chars = np.concatenate([[0], np.cumsum(lead[w.end] - lead[w.start])])
            stats["n_words"] += np.diff(w.first).tolist()
            stats["word_chars"] += np.diff(chars[w.first]).tolist()
            window, ok = w.windows(WINDOW)
            stats["n_repeat_words"] += repeat_words(w.first, window, ok).tolist()
        lines = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            stats["n_symbols"].append(len(_SYMBOLS.findall(text)))
            seen, dup, found = set(), 0, {}
            for line in text.split("\n"):
                n = count_words(line)
                if n:
                    dup += line in seen
                    seen.add(line)
                    key = digest(line)
                    found[key] = found.get(key, 0) + n
            stats["n_dup_lines"].append(dup)
            lines.append([{"line": int.from_bytes(k[:8], "little", signed=True), "words": n} for k, n in found.items()])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("host"), batch.column("row"), *(pa.array(stats[c], pa.int64()) for c in STATS),
             pa.array(lines, pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())])))], names=["doc_id", "host", "row", *STATS, "lines"])


def quality(documents: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, max_lost: float = MAX_LOST) -> DataFrame:
    """One row for each row of ``documents``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words
    (in boilerplate lines of the host), base_failed, kept.

    Host is ``source``; null is a host of its own. Null texts have no words. base_failed: under 10 words, or over a fifth
    of the words in repeated 5-word windows. Rows alike in all columns each count as a document. Other columns are ignored.
    An empty table gives an empty result.
    """
    base = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.select("doc_id", "host", "text", F.xxhash64("doc_id", "host", "text").alias("row"))
    schema = "doc_id long, host string, row long, " + ", ".join(f"{c} long" for c in STATS) + ", lines array<struct<line:long,words:long>>"
    facts = staged(base.mapInArrow(_facts, schema), "facts")
    lines = facts.select("host", "row", F.explode("lines").alias("l")).select("host", "row", "l.line", "l.words")
    hosts = facts.groupBy("host").agg(F.count("*").alias("docs"))
    often = (lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
             .join(hosts, "host").where(F.col("n") > min_share * F.col("docs")).select("host", "line"))
    often = staged(often, "often")
    lost = lines.distinct().join(often, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("lost_words"))
    out = facts.drop("lines").join(lost, "row", "left").withColumn("lost_words", F.coalesce("lost_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= max_lost * F.col("n_words"))).select(
        "doc_id", *STATS, "lost_words", "base_failed", "kept")


def _line_key(line: str) -> int:
    return int.from_bytes(digest(line)[:8], "little", signed=True)


def _line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [list({_line_key(x) for x in text.split("\n") if count_words(x)}) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("row"), pa.array(keys, pa.list_(pa.int64()))], names=["host", "row", "lines"])


def _cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))
    for batch in batches:
        kept, gone = [], []
        for text, often in zip(batch.column("text").to_pylist(), batch.column("often").to_pylist()):
            often, at, left, removed = set(often), 0, [], []
            for line in text.split("\n"):
                if count_words(line) and _line_key(line) in often:
                    removed.append({"start": at, "size": len(line)})
                else:
                    left.append(line)
                at += len(line) + 1
            kept.append("\n".join(left))
            gone.append(removed)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string()), pa.array(gone, spans)], names=["row", "kept", "removed"])


def without_boilerplate(documents: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """One row for each row of ``documents``: doc_id, source, text (without boilerplate lines of its host), removed (start and size of
    each removed line in the original text, in code points, by start).

    Hosts and lines as in ``quality``; every repeat of a boilerplate line goes. Null texts stay null. Other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").withColumn("host", F.coalesce("source", F.lit("")))
    docs = docs.withColumn("row", F.xxhash64("host", F.coalesce("text", F.lit(""))))
    texts = docs.where("text is not null").select("host", "row", "text")
    lines = staged(texts.mapInArrow(_line_keys, "host string, row long, lines array<long>"), "lines").select("host", "row", F.explode("lines").alias("line"))
    hosts = docs.groupBy("host").agg(F.count("*").alias("docs"))
    often = (lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
             .join(hosts, "host").where(F.col("n") > min_share * F.col("docs")).select("host", "line"))
    hit = staged(lines.join(staged(often, "often"), ["host", "line"]).groupBy("row").agg(F.collect_set("line").alias("often")), "hit")
    cut = likely_in(texts, hit, ["row"]).dropDuplicates(["row"]).join(hit, "row").select("row", "text", "often")
    cut = staged(cut.mapInArrow(_cut_lines, "row long, kept string, removed array<struct<start:long,size:long>>"), "cut")
    none = F.array().cast("array<struct<start:long,size:long>>")
    return docs.join(cut, "row", "left").select("doc_id", "source", F.when(F.col("text").isNotNull(), F.coalesce("kept", "text")).alias("text"), F.coalesce("removed", none).alias("removed"))
