import random
import re

from tests.llm.helpers import SF, frame, words
from tremor.llm.line_dedup import dedup_lines
from tremor.llm.lines import count_words, normalised
from tremor.llm.queries import QUERIES


def brute(rows, sep="\n", least=8):
    seen, out = set(), []
    for i, text in sorted(rows):
        at, kept, gone = 0, [], []
        for line in (text or "").split(sep):
            key = normalised(line)
            if count_words(line) >= least and key in seen:
                gone.append((at, len(line)))
            else:
                kept.append(line)
                if count_words(line) >= least:
                    seen.add(key)
            at += len(line) + len(sep)
        out.append((i, None if text is None else sep.join(kept), gone))
    return out


def result(df):
    return sorted((r.doc_id, r.text, [tuple(s) for s in r.removed]) for r in df.collect())


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(dedup_lines(docs, min_words=8)) == want and any(g for _, _, g in want)


def test_cases(spark):
    a, b = "one two three four five six seven eight", "É é b c d e f g h i"
    texts = [a, f"{a.upper()} \n\n{b}", None, "", f"x\n  {a}\t\n{b.lower()}\n{b}", "one two", "one two", f"{a}\n{a}\n", "\n\n", "😀 " + b + "\n" + b]
    docs = frame(spark, texts).selectExpr("*", "1 as mark", "2 as digest", "3 as start", "4 as removed")
    for least in (1, 8):
        assert result(dedup_lines(docs, min_words=least)) == brute(list(enumerate(texts)), least=least)
        assert result(dedup_lines(docs, "paragraph", least)) == brute(list(enumerate(texts)), "\n\n", least)
    for r in dedup_lines(docs).collect():
        assert r.n_units_removed == len(r.removed) and r.n_chars_removed == sum(s["size"] for s in r.removed)


def test_repeated_rows_null_ids_empty(spark):
    a = "one two three four five six seven eight"
    got = [(r.doc_id, r.text) for r in dedup_lines(frame(spark, [a, a, a, a], [5, 5, None, 7])).collect()]
    assert sorted(got, key=str) == sorted([(5, a), (5, a), (None, ""), (7, "")], key=str)
    assert dedup_lines(frame(spark, [])).collect() == []


def test_every_line(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {i: ",".join(f"{a}:{a + n}" for a, n in gone) for i, _, gone in brute([(r.doc_id, r.text) for r in docs.collect()], least=1)}
    assert {r.doc_id: r.removed for r in QUERIES["op1_every_line"](spark, SF).collect()} == want


def brute_runs(rows, least=20):
    """Lines as in ``brute``; of sentences by word lists, runs of ``least`` words that stand earlier, or in other documents."""
    lines = {i: gone for i, _, gone in brute(rows, least=1)}
    units = []
    for i, text in sorted(rows):
        at = 0
        for line in text.split("\n"):
            for m in re.finditer(r".*?[.!?](?:[\x20\x09\x0B-\x0D]+|$)|.+$", line):
                if m[0].split():
                    units.append((i, at + m.start(), at + m.end(), tuple(m[0].lower().split())))
            at += len(line) + 1
    first, holders = {}, {}
    for u in units:
        first.setdefault(u[3], u)
        holders.setdefault(u[3], set()).add(u[0])
    out = {}
    for i, text in rows:
        own = [u for u in units if u[0] == i]
        marks = {name: set() for name in ("again", "shared")}
        for name, test in (("again", lambda u: first[u[3]] is not u), ("shared", lambda u: len(holders[u[3]]) > 1)):
            run = []
            for u in [*own, None]:
                if u and test(u):
                    run.append(u)
                else:
                    if sum(len(x[3]) for x in run) >= least:
                        marks[name].update(run)
                    run = []
        gone = set()
        for a, n in lines[i]:
            gone.update(range(a, a + n))
        for u in marks["again"]:
            gone.update(range(u[1], u[2]))
        out[i] = (gone, sum(len(u[3]) for u in marks["shared"]))
    return out


def held(df, want):
    for r in df.collect():
        gone = {p for s in r.removed for p in range(s["start"], s["start"] + s["size"])}
        assert (gone, r.n_shared_words) == want[r.doc_id]
        starts = [s["start"] for s in r.removed]
        assert starts == sorted(starts) and r.n_chars_removed == len(gone)


def test_sentence_runs(spark):
    rng = random.Random(3)
    passage = " ".join(f"{words(rng, 9).capitalize()}." for _ in range(6))
    short = "Alpha beta gamma. Delta epsilon."
    texts = [f"{words(rng, 30)} {passage} {words(rng, 5)}", f"{words(rng, 12)}. {passage} {words(rng, 8)}\n{short}", f"{words(rng, 9)} {short} {words(rng, 9)}.",
             passage.replace(". ", ".\n"), f"{short} {short}", passage + " " + passage, "", "?! . \t\n.", f" {passage}  ", words(rng, 30000) + ". " + passage]
    held(dedup_lines(frame(spark, texts), run_words=20), brute_runs(list(enumerate(texts))))


def test_sentence_runs_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_runs([(r.doc_id, r.text or "") for r in docs.collect()])
    held(dedup_lines(docs, run_words=20), want)
    assert any(n for _, n in want.values())
