import random
import re
from collections import Counter

from tests.llm.helpers import SCHEMA, SF, frame, words
from tremor.llm.lines import normalised
from tremor.llm.quality import quality, without_boilerplate


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute(rows, least=5, share=0.02, most=0.3):
    hosts = Counter(h or "" for _, h, _ in rows)
    lines = Counter((h or "", k) for _, h, t in rows for k in {normalised(x) for x in (t or "").split("\n") if split(x)})
    out = []
    for i, h, t in rows:
        t, h = t or "", h or ""
        w = split(t)
        n = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + j for k in range(len(w) - 4) if n[tuple(w[k : k + 5])] > 1 for j in range(5)}
        solid = [x for x in t.split("\n") if split(x)]
        lost = sum(len(split(x)) for x in solid if lines[h, normalised(x)] > least and lines[h, normalised(x)] > share * hosts[h])
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(solid) - len(set(solid)), len(rep), lost, failed, not failed and lost <= most * len(w)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    for limit in ((), (2, 0.02, 0.1)):
        assert result(quality(docs, *limit)) == brute(rows, *limit)
    assert any(r[6] for r in brute(rows, 2)) and any(not r[7] and not r[8] for r in brute(rows, 2, 0.02, 0.1))


def test_lines_of_a_host(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        host = rng.choice(["a", "b", None])
        body = [words(rng, 12), *(["Home |  About us\tContact"] * rng.randint(0, 2)), *(["shared é line of five words"] * (i % 3)), ""]
        rows.append((i, host, "\n".join(rng.sample(body, len(body)))))
    rows += [(200, "a", None), (201, "a", ""), (202, "a", "😀 é # < x\n\n \n"), (203, "b", "one two three four five " * 9), (204, None, "home | about us contact\n" * 4)]
    docs = spark.createDataFrame([(i, t, "en", h, 0) for i, h, t in rows], SCHEMA)
    for limit in ((5, 0.1, 0.3), (20, 0.3, 0.5), (10, 0.0, 0.1)):
        assert result(quality(docs, *limit)) == brute(rows, *limit)
    docs = docs.selectExpr("*", "1 as host", "2 as row", "3 as lines", "4 as n_words")
    assert result(quality(docs, 5)) == brute(rows, 5)


def test_repeated_rows_null_ids_empty(spark):
    docs = frame(spark, ["a b c d e f g h i j k"] * 3, [1, 1, None])
    assert result(quality(docs, 2)) == sorted(((i, 11, 11, 0, 0, 0, 11, False, False) for i in (1, 1, None)), key=str)
    assert quality(frame(spark, [])).collect() == []


def test_lines_are_removed_from_small_and_large_hosts(spark):
    """The same share decides whatever the host's size; three documents are no evidence; offsets are those of the text."""
    rows = []
    for host, docs in (("small", 40), ("large", 400)):
        for k in range(docs):
            own = f"own é line {host} {k}"
            text = "\n".join([own, *(["Home |  ABOUT us"] if k % 4 == 0 else []), *(["rare line"] if k % 50 == 0 else []), "", *(["home | about us"] if k % 8 == 0 else [])])
            rows.append((len(rows), text, "en", host, 0))
    rows += [(900, None, "en", "small", 0), *((901 + k, "same words here", "en", "tiny", 0) for k in range(3))]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in without_boilerplate(docs).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        gone = [(s.start, s.size) for s in got[i].removed]
        lines, at, want, left = (text or "").split("\n"), 0, [], []
        for x in lines:
            (want.append((at, len(x))) if normalised(x) == "home | about us" else left.append(x))
            at += len(x) + 1
        assert gone == want and got[i].text == (None if text is None else "\n".join(left))
