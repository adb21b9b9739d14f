import hashlib
import random
import re

from tests.llm.helpers import SF, frame, words
from tremor.llm import pii

# fixed values: the plain forms of the base patterns
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, m):
    d = [int(c) for c in m if c.isascii() and c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(PLAIN[k], text or "") if good(k, m[0])]


def spans(col):
    return [(s.kind, s.start, s.end) for s in col]


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: spans(r.base) for r in pii.find_pii(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and sum(map(len, got.values())) > 10
    for r in rows:
        assert got[r.doc_id] == brute(r.text)


def cases(rng):
    out = [None, "", "a@b.c_d@e.f", "a@b.c@d.e", "x@y", "😀 é@a.b ab@c.d.e-", "1.2.3.4.5", "001.02.3.255", "1.2.3.256 9.9.9.9", "4111 1111 1111 1111", "4111-1111 1111-1111x", "+49 (30) 123-456 7", "+1 2", "+1+49 30 1234567",
           "1" * 5000, "a." * 5000, "a@" + "b." * 5000 + "c", "1 " * 4000, "@" * 3000, "+" * 3000, "+1" + " " * 5000, "1.1." * 3000]
    for _ in range(300):
        out.append("".join(rng.choice(["a", "B7", "@", ".", "-", "_", "+", " ", "1", "42", "255", "300", "4111111111111111", "é", "😀", "(", ")", "%", "\n"]) for _ in range(rng.randint(1, 60))))
    return out


def test_cases(spark):
    texts = cases(random.Random(7))
    got = {r.doc_id: spans(r.base) for r in pii.find_pii(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t[:80]


def test_digest(spark):
    text = "x a@b.cd 1.2.3.4"
    r = pii.find_pii(frame(spark, [text])).select(pii.spans_text("base").alias("s")).first()
    assert r.s == "email:2:8,ip:9:16" and len(hashlib.sha256(r.s.encode()).hexdigest()) == 64


def test_revealing_terms(spark):
    rng = random.Random(9)
    texts = [f"{words(rng, 6)} Ottokar mail otto@firm.org the end {words(rng, 6)}" for _ in range(8)] + [f"mail {words(rng, 20)} the" for _ in range(60)] + [f"{words(rng, 9)} mail x{k}@y.org the" for k in range(20)]
    texts += ["copied words Zebulon by one@copy.org only"] * 30
    rows = pii.find_pii(frame(spark, texts)).collect()
    low = {(r.doc_id, texts[r.doc_id][s.start : s.end]) for r in rows for s in r.added}
    assert {t for _, t in low} == {"Ottokar", "end"} and {i for i, t in low if t == "Ottokar"} == set(range(8))
    assert all(spans(r.base) == brute(texts[r.doc_id]) for r in rows)
    clean = {r.doc_id: r for r in pii.sanitise(frame(spark, texts)).collect()}
    assert "Ottokar" not in clean[0].text and "otto@firm.org" not in clean[0].text and "<EMAIL>" in clean[0].text and clean[0].n_chars == len(clean[0].text)
    assert clean[20].text == texts[20]


def test_edge_rows(spark):
    docs = frame(spark, ["a@b.cd", "a@b.cd", None, "x"], [1, 1, 2, None]).selectExpr("*", "1 as mark", "2 as base", "3 as added", "4 as term")
    assert sorted((str(r.doc_id), len(r.base)) for r in pii.find_pii(docs).collect()) == [("1", 1), ("1", 1), ("2", 0), ("None", 0)]
    assert sorted(str(r.text) for r in pii.sanitise(docs).collect()) == ["<EMAIL>", "<EMAIL>", "None", "x"]
    assert pii.find_pii(frame(spark, [])).collect() == [] and pii.sanitise(frame(spark, [])).collect() == []
    rows = pii.sanitise(frame(spark, ["1.2.3.4 +49 30 1234567, 4111111111111111 ab 1.2.3.4"])).collect()
    assert rows[0].text == "<IP> <PHONE>, <CARD> ab <IP>"


def test_terms_reveal_entities_from_afar(spark):
    """A name far from the address, behind a number; the values differ and share a domain only; near copies count once."""
    rng = random.Random(3)
    filler = lambda n: " ".join("w" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    texts = [f"Ottokar {filler(30)} 17 {filler(30)} o{k}@firm.org {filler(3)}" for k in range(9)] + [f"{filler(12)} Ottokar {filler(12)}"]
    base = filler(60).split(" ")
    for k in range(12):
        copy = [*base, "Zebulon", "writes", "from", f"z{k}@copy.org"]
        copy[rng.randrange(60)] = "v" + "".join(rng.choice("abcdefgh") for _ in range(6))
        texts.append(" ".join(copy))
    texts += [f"{filler(20)} x{k}@y.org" for k in range(10)] + [filler(20) for _ in range(100)]
    rows = pii.find_pii(frame(spark, texts)).collect()
    added = {(r.doc_id, texts[r.doc_id][s.start : s.end], s.kind) for r in rows for s in r.added}
    assert {(i, t) for i, t, _ in added} == {(i, "Ottokar") for i in range(10)}


def test_blanking_keeps_places(spark):
    texts = ["Zoéotto@firm.org a 4111111111111111.1.2 +4111111111111111 naïve", "", "😀 Äbc"]
    rows = {r.doc_id: r for r in pii.base_spans(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        gone = {k for s in rows[i].base for k in range(s.start, s.end)}
        assert (rows[i].rest or t) == "".join(" " if k in gone else c for k, c in enumerate(t))
