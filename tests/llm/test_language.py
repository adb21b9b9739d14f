"""Counts and scores against plain dictionaries, and accuracy on held-out documents."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF, frame
from tremor.llm import language, queries


def grams(text):
    """n-grams of the words of a text, as strings."""
    words = "".join(ch if ch.isalpha() else " " for ch in (text or "").lower()).split()
    out = Counter()
    for w in words:
        padded = f" {w} "
        out.update(w)
        for n in (2, 3, 4):
            out.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return out


def bucket(gram):
    """The bucket of one n-gram, found by hashing it alone as a part of a word."""
    h = 0
    for ch in gram:
        h = (h * 0x100000001B3 + ord(ch)) % 2**64
    m = (h + len(gram)) * 0x9E3779B97F4A7C15 % 2**64
    return ((m ^ (m >> 29)) * 0xBF58476D1CE4E5B9 % 2**64) >> 48


def brute(train, texts):
    counts = {}
    for text, lang in train:
        counts.setdefault(lang, (Counter(), []))[1].append(1)
        for g, n in grams(text).items():
            counts[lang][0][bucket(g)] += n
    total = sum(len(v[1]) for v in counts.values())
    out = []
    for text in texts:
        log = {}
        for lang, (c, docs) in counts.items():
            size = sum(c.values()) + language.BUCKETS
            log[lang] = math.log(len(docs) / total) + sum(n * math.log((c[bucket(g)] + 1) / size) for g, n in grams(text).items())
        out.append(log)
    return out


def sample(seed, n):
    rng = random.Random(seed)
    alphabets = {"aa": "aeioumnt", "bb": "ßöükrst", "cc": "абвгд"}
    rows = []
    for _ in range(n):
        lang = rng.choice(list(alphabets))
        rows.append((" ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 12))) + rng.choice(["", "!", " 42", "\n"]), lang))
    return rows


@pytest.mark.parametrize("piece", [20, 1 << 18])
def test_counts_and_scores_like_dictionaries(spark, monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    rows = sample(1, 80) + [("", "aa"), ("7 + 7", "bb")]
    model = language.fit(spark.createDataFrame([*rows, (None, "aa"), ("abc", None)], "text string, lang string"))
    texts = [t for t, _ in sample(2, 40)] + ["", None, "ÄÖ x", "a" * 15, "..b"]
    found = model.scores(texts)
    for got, want in zip(found, brute(rows, texts)):
        assert np.allclose(got, [want[x] for x in model.langs], rtol=1e-12)


def test_edges(spark):
    docs = frame(spark, ["aeiou mnt", None, "", "123 !?", "krst " * 60_000, "aeiou mnt", "ß"], [1, 2, 3, 4, None, 1, 7]).withColumn("lang_pred", F.lit("old"))
    model = language.fit(spark.createDataFrame(sample(3, 60), "text string, lang string"))
    got = language.predict(docs, model).orderBy(F.col("doc_id").asc_nulls_first(), "text").collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in got] == [(None, "bb"), (1, "aa"), (1, "aa"), (2, "und"), (3, "und"), (4, "und"), (7, "bb")]
    assert all(r["lang_score"] == 0 if r["lang_pred"] == "und" else 0.3 < r["lang_score"] <= 1 for r in got)
    nothing = language.fit(docs.where("false"))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.where("false"), model).count() == 0
    with pytest.raises(ValueError):
        language.fit(spark.range(99).select(F.lit("a").alias("text"), F.col("id").cast("string").alias("lang")))


def test_accuracy_on_held_out_documents(spark):
    out = queries.op12_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(out) > 40 and (out.lang == out.lang_pred).mean() > 0.98
