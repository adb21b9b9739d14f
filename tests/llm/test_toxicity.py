import random

import numpy as np

from tests.llm.helpers import frame, words
from tremor.llm.toxicity import INSULT, NEGATIONS, NONE, REPORTS, TARGETS, THREATS, Grammar, fit, read_clause, toxicity


def test_readings():
    assert read_clause([INSULT], [2.0]) == [0, 2, 0, 0, 0, 0]
    assert read_clause([TARGETS, NONE, INSULT], [1, 1, 2.0]) == [2, 0, 0, 0, 0, 0]
    assert read_clause([NEGATIONS, NONE, INSULT], [1, 1, 2.0]) == [0, 0, 2, 0, 0, 0]
    assert read_clause([NEGATIONS, NONE, NONE, NONE, INSULT], [1, 1, 1, 1, 2.0]) == [0, 2, 0, 0, 0, 0]
    assert read_clause([REPORTS, TARGETS, INSULT, THREATS], [1, 1, 2.0, 1]) == [0, 0, 0, 2, 0, 1]
    assert read_clause([THREATS, TARGETS], [1, 1]) == [0, 0, 0, 0, 1, 0]


def corpus(rng, n):
    texts, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        w = words(rng, rng.randint(5, 60)).split(" ")
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zorkig", "zorken", "Zorkst,", "grumpf", "écrouz"]))
        texts.append(" ".join(w) + rng.choice(["", ".", "\n"]))
        labels.append((i, int(bad)))
    return texts, labels


def test_held_out_accuracy(spark):
    texts, labels = corpus(random.Random(2), 1200)
    docs, marks = frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.tox_predicted for r in toxicity(docs, marks).where("crc32(cast(doc_id as string)) % 5 = 0").collect()}
    assert len(got) > 100 and np.mean([got[i] == y for i, y in labels if i in got]) > 0.97


def test_held_out_labels_are_not_read(spark):
    texts, labels = corpus(random.Random(4), 400)
    docs = frame(spark, texts)
    held = {r.doc_id for r in docs.where("crc32(cast(doc_id as string)) % 5 = 0").collect()}
    flipped = [(i, 1 - y if i in held else y) for i, y in labels]
    a, b = (fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert np.array_equal(a.table, b.table) and np.allclose(a.coef, b.coef)


def test_edge_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = frame(spark, [None, "", "a " * 100_000, "same", "same"], [1, 2, None, 4, 4]).selectExpr("*", "1 as tox_score", "2 as fold", "3 as toxic")
    got = toxicity(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.tox_score < 0.5 and r.tox_predicted == 0 for r in got)
    assert toxicity(frame(spark, []), labels).collect() == []


def test_clause_borders():
    import pyarrow as pa

    from tremor.llm.toxicity import _hashes
    table = _hashes("grumpf")
    g = Grammar(table, np.array([2.0]))
    f = np.expm1(g.features(pa.array(["you are. grumpf", "you are grumpf", "GRUMPF", None, "", "no grumpf; grumpf"])))
    assert np.isclose(f[0, 1], 2) and np.isclose(f[1, 0], 2) and np.isclose(f[2, 1], 2) and not f[3:5].any() and np.allclose(f[5], [0, 2, 2, 0, 0, 0, 2, 2])
