import random
import re

from tests.llm.helpers import SF, frame, words
from tremor.llm.decontaminate import decontaminate, find_items


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    out = []
    for i, t in docs:
        d = grams(t)
        for k, q in items:
            s = grams(q)
            if s and 100 * len(s & d) >= 80 * len(s):
                out.append((i, k, len(s), len(s & d)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in df.collect()), key=str)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_table(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert result(find_items(docs, items)) == want and want


def test_cases(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, words(rng, n)) for k, n in enumerate([5, 6, 9, 14, 14, 40, 40, 59, 4, 0])] + [(90, None), (91, "a b"), (5, "Same Text one two three four"), (5, "Same Text one two three four")]
    texts = [None, "", "a b", "same text one two three four"]
    for _ in range(60):
        q = rng.choice(items)[1] or ""
        w = q.split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = "edited"
        texts.append(f"{words(rng, rng.choice([0, 3, 200, 5000]))} {' '.join(w).upper()}\n{words(rng, rng.choice([0, 3, 200]))}")
    docs = frame(spark, texts).selectExpr("*", "1 as row", "2 as item_id", "3 as _row")
    want = brute(list(enumerate(texts)), items)
    assert result(find_items(docs, bench(spark, items))) == want
    import tremor.llm.decontaminate as module
    monkeypatch.setattr(module, "BLOCK_ITEMS", 4)
    assert result(find_items(docs, bench(spark, items))) == want
    left = decontaminate(docs, bench(spark, items))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(range(len(texts))) - {w[0] for w in want})


def test_empty_and_null_ids(spark):
    items = bench(spark, [(1, "a b c d e f")])
    assert find_items(frame(spark, []), items).collect() == [] and find_items(frame(spark, ["x"]), bench(spark, [])).collect() == []
    docs = frame(spark, ["a b c d e f", "a b c d e f", "clean", "clean"], [None, None, None, 3])
    assert result(find_items(docs, items)) == [(None, 1, 2, 2)] * 2
    assert [r.text for r in decontaminate(docs, items).collect()] == ["clean", "clean"]
