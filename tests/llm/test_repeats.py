import hashlib
import random
from collections import Counter

from tests.llm.helpers import SF, frame, words
from tremor.llm.repeats import remove_repeats


def brute(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[k : k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(remove_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], 400)


def test_cases(spark):
    rng = random.Random(3)
    passage, other = words(rng, 40), words(rng, 30)
    texts = [None, "", "short", passage, passage, passage[:40], "é" + passage, "a" * 300, "ab" * 90, "é" * 70]
    for _ in range(30):
        a, b = sorted((rng.randrange(len(passage)), rng.randrange(len(passage))))
        texts.append(words(rng, 5) + passage[a:b] + words(rng, 3) + rng.choice(["", other, other[20:]]))
    texts += [other + other, other[:39], other[:40]]
    got = remove_repeats(frame(spark, texts), 40, 20)
    assert result(got) == brute(list(enumerate(texts)), 40)
    raw = {i: (t or "").encode() for i, t in enumerate(texts)}
    for r in got.collect():
        assert sum(s["end"] - s["start"] for s in r.spans) == r.n_removed and all(0 <= s["start"] < s["end"] <= len(raw[r.doc_id]) for s in r.spans)


def test_repeated_rows_null_ids_extra_columns(spark):
    text = words(random.Random(1), 200)
    docs = frame(spark, [text, text, "x", "x"], [1, 1, None, None]).selectExpr("*", "1 as mark", "2 as spans", "3 as block", "4 as lo")
    assert [(r[0], r[2]) for r in result(remove_repeats(docs))] == sorted([(1, len(text)), (1, len(text)), (None, 0), (None, 0)], key=str)


def test_empty(spark):
    assert remove_repeats(frame(spark, [])).collect() == []


def test_positions_beyond_the_low_bits(spark, monkeypatch):
    """A text of many times _LOW bytes: its anchors are those of the same bytes elsewhere."""
    import numpy as np

    from tremor.llm import repeats

    monkeypatch.setattr(repeats, "_LOW", np.uint64((1 << 9) - 1))
    data = np.random.default_rng(4).integers(97, 123, 5000).astype(np.uint8)
    data[4000:4300] = data[100:400]
    off = np.array([0, 3000, 5000])
    text, lo, size, gram, block = repeats.anchor_runs(data, off, 40, 20)
    seen = {}
    for t, a, n, g in zip(text.tolist(), lo.tolist(), size.tolist(), gram.tolist()):
        assert n <= 40 - 20 + 1
        for w in range(a, a + n):
            assert (t, w) not in seen
            seen[t, w] = g
    assert set(seen) == {(t, w) for t in range(2) for w in range(off[t + 1] - off[t] - 39)}
    assert all(seen[1, 1000 + w] == seen[0, 100 + w] for w in range(300 - 39))


def test_different_strings_of_equal_polynomial_hash(spark):
    """Strings made to have equal polynomial hashes, with a tail that holds their anchor: no string of 400 bytes stands in both texts."""
    import numpy as np

    from tremor.llm.repeats import K, LENGTH, anchor_runs, span_hash
    from tremor.llm.wordhash import prefix_hash

    one, two = b"ponzunsphapqhvxachjbnvlenrhduqvczoikuucl", b"ggixbbvgdjxcegvwkofgphawwdclnkicoccpezcl"
    tail = words(random.Random(5), 100)[: LENGTH - 40]
    texts = [one.decode() + tail, two.decode() + tail]
    raws = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    assert len(set(int(span_hash(prefix_hash(r), np.array([0]), np.array([LENGTH]))[0]) for r in raws)) == 1
    assert len(set(int(anchor_runs(r, np.array([0, LENGTH]), LENGTH, K)[3][0]) for r in raws)) == 1
    for case in (texts, ["first words before " + texts[0], "others " + texts[1]], [*texts, texts[0], "others " + texts[1] + " more"]):
        assert result(remove_repeats(frame(spark, case))) == brute(list(enumerate(case)), LENGTH)


def test_rows_of_a_frequent_key_stay_apart(spark):
    from pyspark.sql import functions as F

    from tremor.llm.repeats import HOT, rows_in

    n = 3 * HOT
    rows = spark.range(0, n, 1, 8).selectExpr("id", "if(id % 3 = 0, -1, id div 2) as key")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("n > 1")
    got = rows_in(rows, groups, ["key"]).withColumn("part", F.spark_partition_id()).collect()
    count = Counter(r.key for r in rows.collect())
    assert sorted(r.id for r in got) == sorted(r.id for r in rows.collect() if count[r.key] > 1)
    assert {r.low for r in got if r.key == -1} == {0} and all(r.low == 2 * r.key for r in got if r.key >= 0)
    assert len({r.part for r in got if r.key == -1}) == 8
