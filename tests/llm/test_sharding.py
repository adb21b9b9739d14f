import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import SF, frame
from tremor.llm.sharding import hilbert_index, shard_documents, text_cuts, write_shards


def test_curve_visits_every_cell_by_unit_steps():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        index = hilbert_index(cells, bits)
        path = cells[np.argsort(index)]
        assert sorted(index) == list(range(1 << bits * dims)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    counts = [len(by.get(k, [])) for k in range(shards)]
    assert set(by) <= set(range(shards)) and max(counts) - min(counts) <= 1
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert want == sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows)
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(shard_documents(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], 24)


def test_cases(spark):
    for texts in ([], ["a"], [None, "", "é" * 9, "a", "a", "a", "b"], ["same"] * 50):
        docs = frame(spark, texts, [1] * len(texts)).selectExpr("*", "1 as curve", "2 as shard", "3 as slot")
        check(shard_documents(docs, 4).collect(), [(1, t) for t in texts], 4)
    docs = spark.createDataFrame([(None, None, None, None, None), (None, "x", None, None, None)], frame(spark, []).schema)
    check(shard_documents(docs, 3).collect(), [(None, None), (None, "x")], 3)


def test_written_shards_keep_rows(spark, tmp_path):
    docs = frame(spark, ["a", None, "c"] * 9)
    write_shards(docs, str(tmp_path / "out"), 4)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))


def test_cuts_stand_at_equal_parts_of_the_rows(spark):
    values = ["b"] * 5 + ["a"] * 2 + [None] + ["d", "c"] * 4
    docs = frame(spark, ["x"] * len(values)).drop("source").join(spark.createDataFrame(list(enumerate(values)), "doc_id long, source string"), "doc_id")
    ordered = sorted(v or "" for v in values)
    assert text_cuts(docs, "source", 2) == [ordered[-(-len(ordered) * k // 4) - 1] for k in (1, 2, 3)]
    assert text_cuts(docs.where("false"), "source") == []


def test_shards_are_skipped_by_each_dimension(spark):
    """By the least and largest value of each shard, a filter on one language or source leaves most shards unread."""
    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.1") + "/documents.parquet")
    rows = shard_documents(docs).join(docs.select("doc_id", "lang", "source"), "doc_id").groupBy("shard").agg(
        *(f(c).alias(f"{c}{k}") for c in ("lang", "source", "size") for k, f in ((0, F.min), (1, F.max)))).toPandas()
    facts = docs.groupBy("lang").count().toPandas(), docs.groupBy("source").count().toPandas()
    touched = lambda c, v: ((rows[f"{c}0"] <= v) & (rows[f"{c}1"] >= v)).sum()
    by_lang = [touched("lang", v) for v in facts[0]["lang"]]
    by_source = [touched("source", v) for v in facts[1]["source"]]
    print("shards touched by lang", by_lang, "by source", by_source)
    assert np.mean(by_lang) <= 16 and np.mean(by_source) <= 10
