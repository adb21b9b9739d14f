"""Substring dedup by hashing lines, paragraphs and sentences.

Units are normalised and their digests grouped over the whole corpus. The occurrence of the lowest rank (doc_id, then place)
stays; all others are repeats. Repeated lines and paragraphs are removed. A passage that was pasted into the middle of a
line has no line of its own, so lines are cut into sentences too; single sentences recur by chance, so repeated sentences
go only in runs of ``run_words`` words or more. Offsets of removed units refer to the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import likely_in, staged, texts_of
from tremor.llm.lines import digest_of, has_words, words_of

MIN_WORDS = 1
RUN_WORDS = 20
UNITS = {"line": "\n", "paragraph": "\n\n"}
_SENTENCE_END = re.compile(r"(?<=[.!?])[\x20\x09\x0B-\x0D]+")
_KEY = "doc_id long, mark long, "
_SPANS = "array<struct<start:long,size:long>>"


def sentences(line: str, at: int = 0) -> list[tuple[int, int]]:
    """(start, end) of the sentences of ``line``, each with the spaces after it; together they are the line."""
    ends = [m.end() for m in _SENTENCE_END.finditer(line)] + [len(line)]
    return [(at + a, at + b) for a, b in zip([0, *ends], ends) if a < b]


def pieces(text: str, unit: str) -> list[tuple[int, int]]:
    """(start, end) of the units of ``text`` that have words, in code points."""
    out, at = [], 0
    sep = UNITS.get(unit, "\n")
    for line in text.split(sep):
        out += sentences(line, at) if unit == "sentence" else [(at, at + len(line))]
        at += len(line) + len(sep)
    return [(a, b) for a, b in out if has_words(text[a:b])]


def _units(batches: Iterator[pa.RecordBatch], units: tuple[str, ...], min_words: int) -> Iterator[pa.RecordBatch]:
    """``units``: lines or paragraphs, and sentences of lines if there is a second one. Places count units with words."""
    names = ["doc_id", "mark", "unit", "place", "words", "digest"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary())
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text"))):
            places = dict.fromkeys(units, 0)
            for line in text.split(UNITS[units[0]]):
                own: list[str] = []
                for a, b in sentences(line) if len(units) > 1 else [(0, len(line))]:
                    part = words_of(line[a:b])
                    own += part
                    if part and len(units) > 1:
                        if len(part) >= min_words:
                            for column, v in zip(out, (doc, mark, units[1], places[units[1]], len(part), digest_of(part))):
                                column.append(v)
                        places[units[1]] += 1
                if own:
                    if len(own) >= min_words:
                        for column, v in zip(out, (doc, mark, units[0], places[units[0]], len(own), digest_of(own))):
                            column.append(v)
                    places[units[0]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)


def runs(text: np.ndarray, place: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """Which units are in a run of ``least`` words or more; units are in order of text and place, a run has no gap in place."""
    if not len(place):
        return np.zeros(0, bool)
    head = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)])
    return np.repeat(np.add.reduceat(words, head) >= least, np.diff(np.r_[head, len(place)]))


def _lists(text: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(text, minlength=n))].astype(np.int32)), pa.array(values.astype(np.int32)))


def _plans(batches: Iterator[pa.RecordBatch], run_words: int) -> Iterator[pa.RecordBatch]:
    """What goes from each text: places of lines or paragraphs, and of sentences; words of the passages that go, and of those that
    stand in other texts."""
    for batch in batches:
        found, n = batch.column("found"), batch.num_rows
        units = found.flatten()
        text = np.repeat(np.arange(n), found.value_lengths().to_numpy(zero_copy_only=False))
        place, words, sentence, gone, shared = (units.field(c).to_numpy(zero_copy_only=False) for c in ("place", "words", "sentence", "gone", "shared"))
        order = np.lexsort((place, text))
        text, place, words, sentence, gone, shared = (x[order] for x in (text, place, words.astype(np.int64), sentence, gone, shared))
        whole, again, known = gone & ~sentence, np.flatnonzero(gone & sentence), np.flatnonzero(shared & sentence)
        again = again[runs(text[again], place[again], words[again], run_words)]
        known = known[runs(text[known], place[known], words[known], run_words)]
        n_shared = np.bincount(text[known], words[known], n).astype(np.int64)
        n_passage = np.bincount(text[again], words[again], n).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), _lists(text[whole], place[whole], n), _lists(text[again], place[again], n), pa.array(n_passage), pa.array(n_shared)],
            names=["doc_id", "mark", "whole", "parts", "n_passage_words", "n_shared_words"])


def plans(docs: DataFrame, units: tuple[str, ...], min_words: int, run_words: int) -> DataFrame:
    """(doc_id, mark, whole, parts, n_passage_words, n_shared_words) of the texts with repeated units; ``docs`` has (doc_id, mark, text).

    Null doc_ids rank last. Of rows alike in doc_id and text the first removes nothing of its own and the others are one
    with it, so copies under one doc_id keep the same units."""
    key = ["unit", "digest"]
    found = staged(docs.mapInArrow(lambda it: _units(it, units, min_words), _KEY + "unit string, place int, words int, digest binary"), "units")
    # digests first, so that ranks are moved for repeated units only
    often = staged(found.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "often")
    again = staged(likely_in(found, often, key).join(often, key), "again")
    doc = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("mark"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("mark"), F.col("place"))
    # written, as the join then deals out both sides anew and a frequent digest's rows can be split
    first = staged(again.groupBy(*key).agg(F.min(rank).alias("first"), F.max(rank).alias("last"), (F.min(doc) != F.max(doc)).alias("shared"))
                   .where("first <> last").drop("last"), "first")
    marked = again.join(first, key).select("doc_id", "mark", "unit", "place", "words", (~rank.eqNullSafe(F.col("first"))).alias("gone"), "shared").distinct()
    of_text = marked.groupBy("doc_id", "mark").agg(F.collect_list(F.struct((F.col("unit") == "sentence").alias("sentence"), "place", "words", "gone", "shared")).alias("found"))
    return staged(of_text.mapInArrow(lambda it: _plans(it, run_words), _KEY + "whole array<int>, parts array<int>, n_passage_words long, n_shared_words long"), "plans")


def cut(text: str, unit: str, whole: list[int], parts: list[int]) -> tuple[str, list[tuple[int, int]], int]:
    """Text without these units, their spans (neighbouring sentences of a line as one), and their number."""
    sep, spans, kept, at, k = UNITS[unit], [], [], 0, 0
    own, parted = pieces(text, unit) if whole else [], pieces(text, "sentence") if parts else []
    gone, rest = {own[p] for p in whole}, [parted[p] for p in parts]
    count = len(gone)
    for line in text.split(sep):
        a, b = at, at + len(line)
        inside = []
        while k < len(rest) and rest[k][0] < b:
            inside.append(rest[k])
            k += 1
        if (a, b) in gone:
            spans.append((a, b))
        else:
            left, out, count = a, [], count + len(inside)
            for s, e in inside:
                if spans and spans[-1][1] == s and s > a:
                    spans[-1] = (spans[-1][0], e)
                else:
                    spans.append((s, e))
                out.append(text[left:s])
                left = e
            kept.append("".join(out) + text[left:b])
        at = b + len(sep)
    return sep.join(kept), spans, count


def _drop(batches: Iterator[pa.RecordBatch], unit: str) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))
    for batch in batches:
        done = [cut(*row) for row in zip(batch.column("text").to_pylist(), [unit] * batch.num_rows, batch.column("whole").to_pylist(), batch.column("parts").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array([d[0] for d in done], pa.string()), pa.array([[{"start": a, "size": b - a} for a, b in d[1]] for d in done], spans),
             pa.array([d[2] for d in done], pa.int64())], names=["doc_id", "mark", "kept", "removed", "n_units_removed"])


def dedup_lines(documents: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, run_words: int = 0) -> DataFrame:
    """One row for each row of ``documents``: doc_id, n_shared_words, n_passage_words_removed, n_units_removed, n_chars_removed, text
    (without repeated units), text_sha256 (of that text), removed (start and size of each removed span in the original text, in
    code points, by start).

    Two kinds of text go: repeated lines of any length, as of templates, and with ``run_words`` pasted passages, runs of repeated
    sentences of that many words or more; n_passage_words_removed counts the words of the second kind, also where they are
    whole lines.

    With ``run_words`` sentences are units too; n_shared_words counts the words of runs of that many words or more whose
    sentences all stand in other documents as well, kept here or not; else it is 0. Units under ``min_words`` words stay.
    Null texts stay null. Rows alike in doc_id and text get the same result. Other columns are ignored. An empty table gives
    an empty result.
    """
    if run_words and unit != "line":
        raise ValueError("sentences are cut from lines")
    docs = documents.select(F.col("doc_id").cast("long"), "text").withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = docs.where("text is not null")
    plan = plans(texts, (unit, "sentence") if run_words else (unit,), min_words, run_words)
    some = plan.where("size(whole) + size(parts) > 0")
    same = lambda a, b: F.expr(f"{a}.doc_id <=> {b}.doc_id and {a}.mark = {b}.mark")
    hit = texts_of(texts, some).select("doc_id", "mark", "text", "whole", "parts")
    done = staged(hit.mapInArrow(lambda it: _drop(it, unit), _KEY + f"kept string, removed {_SPANS}, n_units_removed long"), "cut")
    sha = lambda c: F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)
    base = docs.withColumn("sha", sha("text")).alias("d")
    cuts = done.withColumn("sha", sha("kept")).alias("c")
    return (base.join(cuts, same("d", "c"), "left").join(plan.alias("p"), same("d", "p"), "left").select(
        "d.doc_id", F.coalesce("p.n_shared_words", F.lit(0)).cast("long").alias("n_shared_words"), F.coalesce("p.n_passage_words", F.lit(0)).cast("long").alias("n_passage_words_removed"), F.coalesce("c.n_units_removed", F.lit(0)).cast("long").alias("n_units_removed"),
        F.coalesce(F.aggregate("c.removed", F.lit(0).cast("long"), lambda s, r: s + r["size"]), F.lit(0)).cast("long").alias("n_chars_removed"),
        F.coalesce("c.kept", "d.text").alias("text"), F.coalesce("c.sha", "d.sha").alias("text_sha256"), F.coalesce("c.removed", F.array().cast(_SPANS)).alias("removed")))
