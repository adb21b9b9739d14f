import random

from tests.llm.helpers import SF, frame, words
from tremor.llm.packing import CAPACITIES, best_fit, pack


def check(rows, tokens, caps):
    """Every token of every document lies once; bins do not overlap or overflow and are no larger than needed."""
    docs, bins = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        if r.bin is not None:
            bins.setdefault(r.bin, []).append(r)
    for i, n in tokens.items():
        at = 0
        for k, r in enumerate(sorted(docs[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length > 0 or n == 0)
            at += r.length
        assert at == n
    for part in bins.values():
        at = 0
        for r in sorted(part, key=lambda r: r.place):
            assert r.place == at
            at += r.length
        assert {r.capacity for r in part} == {min(c for c in caps if c >= at)}
    return bins


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokens = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    bins = check(pack(docs).collect(), tokens, CAPACITIES)
    held = sum(tokens.values()) / sum(p[0].capacity for p in bins.values())
    assert held > 0.97
    check(pack(docs, (64, 100), 2000).collect(), tokens, (64, 100))


def test_best_fit_takes_the_tightest_bin():
    bins, places, final = best_fit([7, 6, 3, 2], (10,))
    assert bins == [0, 1, 0, 1] and places == [0, 0, 7, 6] and final == [10, 10]


def test_capacity_is_chosen_by_cost():
    assert best_fit([100], (128, 1024))[2] == [128]
    assert best_fit([600, 424], (700, 1024))[2] == [1024]


def test_edge_rows(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "one", words(rng, 300), words(rng, 1000)]
    docs = frame(spark, texts).selectExpr("*", "1 as mark", "2 as piece", "3 as bin", "4 as length")
    check(pack(docs, (16, 128)).collect(), {i: len((t or "").split()) for i, t in enumerate(texts)}, (16, 128))
    same = pack(frame(spark, ["a b c"] * 4, [1, 1, None, None])).collect()
    assert sorted((str(r.doc_id), r.length) for r in same) == [("1", 3), ("1", 3), ("None", 3), ("None", 3)]
    assert len({(r.bin, r.place) for r in same}) == 4
    assert pack(frame(spark, [])).collect() == []
