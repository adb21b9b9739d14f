"""Language of texts: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; what is no letter parts words, and a word is taken with a space at either end. Its n-grams of 1 to 4
characters are hashed into BUCKETS. Training counts n-grams by language and bucket in each task as an array, then in one
grouped sum over all labelled texts. The matrix of log probabilities (languages times BUCKETS) is broadcast; its size is bound
by MAX_LANGS. A batch of texts is scored as a sparse matrix, rows by buckets, times that matrix, in numpy.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is all where nothing was learned; rows
without doc_id are not learned from and not held out; a null lang is not learned; repeated rows count each time; an input
column named like an output column is replaced. A run of over PIECE letters is cut there into words; long texts are taken
whole, in pieces of PIECE characters. More than MAX_LANGS languages raise an error before anything is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 1 << 16
MAX_LANGS = 64
SIZES = (1, 2, 3, 4)
PIECE = 1 << 18
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows of ``texts`` with their lower-cased text, in groups of about PIECE characters; a longer text is cut at a non-letter."""
    rows, held, size = [], [], 0
    for row, text in enumerate(texts):
        text = (text or "").lower()
        at = 0
        while at < len(text) or not at:
            end = min(len(text), at + PIECE)
            if end < len(text):
                cut = end
                while cut > at and text[cut - 1].isalpha():
                    cut -= 1
                end = cut if cut > at else end
            rows.append(row)
            held.append(text[at:end])
            size += end - at + 1
            if size >= PIECE:
                yield rows, held
                rows, held, size = [], [], 0
            at = max(end, at + 1)
    if rows:
        yield rows, held


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n the index of the text and the bucket of each n-gram."""
    wide = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[wide]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    owner = np.repeat(np.arange(len(texts) + 1), [1, *(len(t) + 1 for t in texts)])
    sign = np.where(letter, wide, 32)[keep].astype(np.uint64)
    letter, owner = letter[keep], owner[keep] - 1
    h = np.zeros(len(sign), np.uint64)
    inner = np.ones(len(sign), bool)
    for n in range(1, max(SIZES) + 1):
        m = len(sign) - n + 1
        if m <= 0:
            return
        h = h[:m] * np.uint64(0x100000001B3) + sign[n - 1 :]
        if n > 2:  # no word border inside
            inner = inner[:m] & letter[n - 2 : n - 2 + m]
        if n in SIZES:
            ok = letter if n == 1 else inner[:m]
            at = np.flatnonzero(ok)
            mixed = (h[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            yield owner[at + (~letter[at] if n > 1 else 0)], ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a whole task; bucket BUCKETS holds the number of texts."""
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for a in range(0, len(batch), 500):
            texts = batch.column("text").slice(a, 500).to_pylist()
            for lang in sorted(set(langs[a : a + 500])):
                mine = [t for t, x in zip(texts, langs[a : a + 500]) if x == lang]
                total = found.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                total[BUCKETS] += len(mine)
                for _, some in pieces(mine):
                    for _, bucket in ngrams(some):
                        total[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
    for lang, total in found.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(at), int))), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "bucket", "n"])


class Model:
    """``langs`` and their log probabilities: ``prior`` by language, ``weight`` by language and bucket."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, seen = langs, counts[:, :BUCKETS] + 1.0
        self.weight = np.log(seen) - np.log(seen.sum(1, keepdims=True))
        self.prior = np.log(counts[:, BUCKETS]) - np.log(counts[:, BUCKETS].sum()) if langs else np.zeros(0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Log joint probability, texts by languages."""
        out = np.tile(self.prior, (len(texts), 1))
        for rows, some in pieces(texts):
            for owner, bucket in ngrams(some):
                np.add.at(out, rows, np.stack([np.bincount(owner, w[bucket], len(rows)) for w in self.weight], 1))
        return out


def fit(texts: DataFrame) -> Model:
    """Counts over all of ``texts(text, lang)``; rows without either are left out."""
    texts = texts.where("lang is not null and text is not null").select("text", "lang")
    if len(texts.select("lang").distinct().limit(MAX_LANGS + 1).collect()) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    sums = texts.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    counts = np.zeros((len(langs), BUCKETS + 1))
    counts[np.searchsorted(np.array(langs, object), np.array(sums.column("lang").to_pylist(), object)) if langs else [], sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model, with_text: bool = True) -> DataFrame:
    """``docs``, without their text if so asked, with lang_pred and lang_score, the probability of lang_pred."""
    docs = docs.drop("lang_pred", "lang_score")
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if with_text or c != "text"]
    spoken = docs.withColumn("_speaks", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            for a in range(0, len(whole), 500):
                batch = whole.slice(a, 500)
                speaks = np.array(batch.column("_speaks").to_pylist(), bool)
                langs, score = np.full(len(batch), "und", object), np.zeros(len(batch))
                at = np.flatnonzero(speaks) if m.langs else []
                if len(at):
                    log = m.scores(batch.column("text").take(pa.array(at)).to_pylist())
                    best = log.argmax(1)
                    langs[at] = np.array(m.langs, object)[best]
                    score[at] = 1 / np.exp(log - log.max(1, keepdims=True)).sum(1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(langs, pa.string()), pa.array(score)], [*names, "lang_pred", "lang_score"])

    schema = StructType(docs.select(names).schema.fields).add("lang_pred", "string").add("lang_score", "double")
    return spoken.mapInArrow(run, schema)


def part_of(doc_id: Column, parts: int = 3) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts
