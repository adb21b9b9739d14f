import re

import corpus_pipeline
from tests.llm.helpers import SCHEMA, SF
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_pii import brute as personal


def five(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            rows = docs.collect()
            for i, t in before.items():
                assert sum(r.length for r in rows if r.doc_id == i) == len((t or "").split())
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            gone = set(before) - set(after)
            assert sum(toxic.get(i, 0) for i in before) > 0 and len(gone) < 0.3 * len(before)
        if name == "ngram_jaccard_join":
            sets = {i: five(t) for i, t in before.items()}
            near = {i: {j for j in sets if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} for i in sets}
            for i in sets:
                group, todo = {i}, [i]
                while todo:
                    new = near[todo.pop()] - group
                    group |= new
                    todo += new
                assert (i in after) == (i == min(group))
        if name == "decontamination":
            bad = {r[0] for r in leaks(list(before.items()), items)}
            assert set(after) == set(before) - bad
        if name == "pii":
            assert set(after) == set(before)
            for i, t in before.items():
                spans = personal(t)
                assert (after[i] == t) if not spans else all(t[a:b] not in after[i] for k, a, b in spans if k == "email")
        before = after


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "bin", "place", "capacity"] and out.count() > 50


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)
    return sorted(((r.doc_id, r.text, r.source) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, SF).collect()), key=str)


def test_near_copies_without_doc_ids(spark):
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2
    alone, other = (None, "unique words that no other text here has at all", "s"), (None, "one more text that is like none", "s")
    rows = [(3, long, "s"), (None, long, "s"), alone, other, (None, None, "s")]
    assert kept(spark, rows) == sorted([rows[0], alone, other, rows[4]], key=str)
    # copies that all lack an id, one of them linked by an edited text only
    rows = [(None, long, "s"), (None, long + "end", "s"), (None, long, "t"), alone]
    assert len(kept(spark, rows)) == 2 and alone in kept(spark, rows)
    # different texts under one doc_id: only the one with a smaller partner goes
    rows = [(1, long, "s"), (2, long + "end", "s"), (2, "words of the second text under this id", "s")]
    assert kept(spark, rows) == sorted([rows[0], rows[2]], key=str)
