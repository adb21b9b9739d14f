import random
import re

import numpy as np

from tests.llm.helpers import SF, frame, words
from tremor.llm.ngram_join import BITS, jaccard_groups, parity


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                parent[root(a)] = root(b)
    groups = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(root(k), []).append(i)
    return sorted((i, len(s), min(groups[root(k)])) for k, (i, s) in enumerate(sets))


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(jaccard_groups(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def family(rng):
    """Near copies on both sides of the threshold, chains, a shared passage, frequent shingles only, empty and short texts."""
    out = [None, "", " \t", "One", "one", "a b c", "A B\nC", "a b c d", "a b c d e"]
    shared = words(rng, 30)
    for base in [words(rng, 60), words(rng, 400), words(rng, 12)]:
        chain = base.split(" ")
        for _ in range(12):
            chain = list(chain)
            chain[rng.randrange(len(chain))] = "x" + str(rng.random())
            out.append(" ".join(chain))
        out += [base, base.upper(), base + "  "]
    out += [f"{words(rng, rng.randint(1, 12))} {shared}" for _ in range(25)]
    parts = [words(rng, 9) for _ in range(4)]
    out += [" ".join(rng.sample(parts, 3)) for _ in range(20)]
    return out


def test_families(spark):
    rng = random.Random(5)
    texts = family(rng)
    rng.shuffle(texts)
    assert result(jaccard_groups(frame(spark, texts))) == brute(list(enumerate(texts)))


def test_frequent_class_changes_nothing(spark):
    texts = family(random.Random(6))
    assert result(jaccard_groups(frame(spark, texts), frequent=2)) == brute(list(enumerate(texts)))


def test_empty_table_and_extra_columns(spark):
    docs = frame(spark, [])
    assert result(jaccard_groups(docs)) == []
    docs = frame(spark, ["a b c d e", "a b c d e"]).selectExpr("*", "1 as node", "2 as key", "3 as size", "4 as component_id", "5 as n_shingles")
    assert result(jaccard_groups(docs)) == [(0, 2, 0), (1, 2, 0)]


def test_repeated_rows_and_null_id(spark):
    docs = frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "z"], [3, 3, None, None])
    assert {(r.doc_id, r.component_id) for r in jaccard_groups(docs).collect()} == {(3, 3), (None, 3), (None, None)}


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 6, 200, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for y in (np.unique(np.concatenate([x[: n // 2], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)])), np.delete(x, slice(0, n, 50))):
            for bits in (BITS, 4 * BITS):
                apart = sum(int(v).bit_count() for v in (parity(x, bits) ^ parity(y, bits)).view(np.uint64))
                assert apart <= len(np.setxor1d(x, y))
    assert not parity(np.zeros(0, np.uint64)).any()


def test_long_texts(spark):
    """Sets larger than their parities, on both sides of the threshold, beside shorter ones."""
    rng = random.Random(8)
    base = words(rng, 2100).split(" ")
    texts = [" ".join(base), " ".join(base[:1950])]
    for edits in [5, 20, 40, 80, 110, 160] * 4:
        copy = list(base)
        for k in rng.sample(range(len(base)), edits):
            copy[k] = f"x{rng.random()}"
        texts.append(" ".join(copy))
    found = result(jaccard_groups(frame(spark, texts)))
    assert found == brute(list(enumerate(texts))) and len({c for _, _, c in found}) > 1


def test_large_group_around_one_text(spark):
    """Over LONG copies, each edited apart from the others: most link with the base only, some with nothing."""
    rng = random.Random(5)
    base = words(rng, 150).split(" ")
    texts = [" ".join(base)]
    for edits in [2] * 60 + [5] * 30 + [9] * 30:
        copy = list(base)
        for k in rng.sample(range(150), edits):
            copy[k] = f"x{rng.random()}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    found = result(jaccard_groups(frame(spark, texts)))
    assert found == brute(list(enumerate(texts)))
    assert len({c for _, _, c in found}) > 1
