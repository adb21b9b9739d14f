"""Registered queries of this subpackage; ``oracle`` SQL runs in DuckDB on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import (
    archive, decontaminate, language, line_dedup, ngram_join, packing, pii, prefix_trie, quality, repeats, sharding, toxicity, whitening)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _removed(out: DataFrame) -> Column:
    return F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), (r["start"] + r["size"]).cast("string"))), ",").alias("removed")


def op1_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(_documents(spark, sf_dir), run_words=line_dedup.RUN_WORDS)
    return out.select("doc_id", "n_passage_words_removed", "n_units_removed", "n_chars_removed", F.col("text_sha256").alias("kept_sha256"), _removed(out))


def op1_every_line(spark, sf_dir):
    out = line_dedup.dedup_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "n_units_removed", "n_chars_removed", F.col("text_sha256").alias("kept_sha256"), _removed(out))


def op2_warc_archive(spark, sf_dir):
    return archive.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_information_theoretic_pii(spark, sf_dir):
    found = pii.find_pii(_documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in pii.KINDS), F.sha2(pii.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.spans_text(F.concat("base", "added")).alias("spans"))


def op4_benchmark_decontamination(spark, sf_dir):
    return decontaminate.find_items(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row")


def op5_best_fit_packing(spark, sf_dir):
    return packing.pack(_documents(spark, sf_dir))


def op6_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_groups(_documents(spark, sf_dir)).drop("links")


def op7_hilbert_shards(spark, sf_dir):
    placed = sharding.shard_documents(_documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op8_line_frequency_quality(spark, sf_dir):
    return quality.quality(_documents(spark, sf_dir))


def op8_boilerplate_removed(spark, sf_dir):
    return quality.without_boilerplate(_documents(spark, sf_dir))


def op9_repeated_bytes(spark, sf_dir):
    out = repeats.remove_repeats(_documents(spark, sf_dir))
    spans = F.array_join(F.transform("spans", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", spans.alias("spans"))


def op10_toxicity(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
        F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))


def op11_conversation_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_language_id(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    part = language.part_of(F.col("doc_id"))
    model = language.fit(docs.where(part != 1))
    out = language.predict(docs.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "text"), model, with_text=False)
    return out.withColumnRenamed("lang_score", "score")


def op13_whitening(spark, sf_dir):
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_line_dedup, op1_every_line, op2_warc_archive, op3_information_theoretic_pii, op4_benchmark_decontamination, op5_best_fit_packing, op6_ngram_jaccard_join,
        op7_hilbert_shards, op8_line_frequency_quality, op8_boilerplate_removed, op9_repeated_bytes, op10_toxicity,
        op11_conversation_trie, op12_language_id, op13_whitening)
}
#: Words of documents as the operators see them, A-Z lower-cased.
_WORDS = r"""
        low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM low)"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
        p AS (SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS BIGINT) AS pos,
                trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM l),
        r AS (SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, pos) > 1 AS gone FROM p),
        c AS (SELECT doc_id, k, pos, gone, unnest(w) AS piece, generate_subscripts(w, 1) AS j FROM (
                SELECT *, regexp_extract_all(line, '.*?[.!?](?:[\x20\x09\x0B-\x0D]+|$)|.+$') AS w FROM r)),
        s AS (SELECT *, CAST(pos + sum(length(piece)) OVER (PARTITION BY doc_id, k ORDER BY j) - length(piece) AS BIGINT) AS start,
                trim(regexp_replace(lower(piece), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm, len(regexp_extract_all(piece, '[^\x20\x09-\x0D]+')) AS words FROM c),
        u AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, start) > 1 AS again,
                row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS place FROM s WHERE words > 0),
        i AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, again ORDER BY place) AS ra FROM u),
        v AS (SELECT *, again AND sum(words) OVER (PARTITION BY doc_id, again, ra) >= 20 AS out FROM i),
        x AS (SELECT s.doc_id, s.k, s.j, s.gone, s.start, s.piece, coalesce(v.out, false) AND NOT s.gone AS out, coalesce(v.out, false) AS passage, s.words FROM s LEFT JOIN v USING (doc_id, k, j)),
        y AS (SELECT *, j - row_number() OVER (PARTITION BY doc_id, k, out ORDER BY j) AS run FROM x),
        spans AS (SELECT doc_id, k, min(start) AS a, max(start + length(piece)) AS b, count(*) AS n FROM y WHERE out GROUP BY doc_id, k, run
                  UNION ALL SELECT doc_id, k, pos, pos + length(line), 1 FROM r WHERE gone),
        g AS (SELECT doc_id, sum(n) AS n, sum(b - a) AS chars, string_agg(concat(a, ':', b), ',' ORDER BY a) AS removed FROM spans GROUP BY doc_id),
        t AS (SELECT doc_id, k, string_agg(piece, '' ORDER BY j) FILTER (NOT out) AS line FROM x GROUP BY doc_id, k),
        kept AS (SELECT r.doc_id, string_agg(coalesce(t.line, ''), chr(10) ORDER BY r.k) AS text FROM r LEFT JOIN t USING (doc_id, k) WHERE NOT r.gone GROUP BY r.doc_id),
        z AS (SELECT doc_id, sum(words) FILTER (passage) AS words FROM x GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(z.words, 0) AS BIGINT) AS n_passage_words_removed, CAST(coalesce(g.n, 0) AS BIGINT) AS n_units_removed, CAST(coalesce(g.chars, 0) AS BIGINT) AS n_chars_removed,
          sha256(coalesce(kept.text, '')) AS kept_sha256, coalesce(g.removed, '') AS removed
        FROM documents LEFT JOIN z USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op4_benchmark_decontamination": f"""
        WITH {_WORDS},
        d AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM words, unnest(range(1, len(w) - 3)) AS t(i)),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
        q AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s FROM b, unnest(range(1, len(w) - 3)) AS t(i)),
        n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id)
        SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM d JOIN q USING (s) JOIN n USING (item_id) GROUP BY ALL HAVING 100 * count(*) >= 80 * n_item""",
    "op8_line_frequency_quality": r"""
        WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        x AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS s FROM t, unnest(range(1, len(w) - 3)) AS r(i)),
        y AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM x) WHERE n > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM y, range(0, 5) AS o(k) GROUP BY doc_id),
        l AS (SELECT doc_id, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM t)),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE words > 0 GROUP BY doc_id),
        m AS (SELECT doc_id, host, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm, sum(words) AS words FROM l WHERE words > 0 GROUP BY ALL),
        h AS (SELECT host, count(*) AS docs FROM t GROUP BY host),
        often AS (SELECT host, norm FROM m JOIN h USING (host) GROUP BY host, norm, docs HAVING count(*) > 5 AND count(*) > CAST(0.02 AS DOUBLE) * docs),
        lost AS (SELECT doc_id, sum(words) AS lost FROM m JOIN often USING (host, norm) GROUP BY doc_id),
        s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda a: length(a))), 0) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_words
              FROM t LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id))
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
          NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_words <= CAST(0.3 AS DOUBLE) * n_words AS kept FROM s""",
    "op6_ngram_jaccard_join": f"""
        WITH RECURSIVE {_WORDS},
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 2, 2))) AS t(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
        reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(min(b), doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN reach ON a = doc_id GROUP BY doc_id, n""",
    "op2_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > head THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 100 AND page_id > head THEN head END AS refers_to FROM f""",
    "op11_conversation_trie": r"""
        WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
                   FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, count(*) AS n, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i:
                list_transform(range(0, 8), lambda j: CAST((ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS INT), 1)) >> CAST(j AS INT)) & 1 AS BIGINT))))),
                lambda s, b: xor(s >> 1, 3988292384 * (xor(s, b) & 1))) AS s FROM o GROUP BY conv_id),
        h AS (SELECT conv_id, xor(s, 4294967295) % 4 AS h FROM c),
        r AS (SELECT h.conv_id, o.k, role, text FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20 AND o.k <= h.h
              UNION ALL SELECT h.conv_id, o.k, role, text FROM h JOIN o ON o.conv_id = h.conv_id AND o.k > h.h),
        d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, sha256(concat(length(role), ':', role, text)) AS turn,
                len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
        p AS (SELECT conv_id, depth, words, sha256(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node,
                max(depth) OVER (PARTITION BY conv_id) AS ends FROM d
              UNION ALL SELECT h.conv_id, 0, 0, '', coalesce(max(depth), 0) FROM h LEFT JOIN d USING (conv_id) GROUP BY h.conv_id),
        n AS (SELECT node, depth, any_value(words) AS words, min(conv_id) AS first, count(*) AS n_convs,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends = depth), '')) AS ends_sha256 FROM p GROUP BY node, depth),
        -- the first member of a node runs through its ancestors; the nodes below a node are those whose first member runs through it
        up AS (SELECT n.node, n.depth, n.words, n.n_convs, p.node AS over, p.depth AS over_depth FROM n JOIN p ON p.conv_id = n.first AND p.depth <= n.depth),
        kids AS (SELECT over AS node, over_depth AS depth, count(*) FILTER (depth = over_depth + 1) AS n_children, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved FROM up GROUP BY ALL),
        leaf AS (SELECT up.over AS node, up.over_depth AS depth, count(*) AS n_leaves FROM up JOIN kids ON kids.node = up.node AND kids.depth = up.depth WHERE n_children = 0 GROUP BY ALL)
        SELECT n.first AS conv_id, n.depth, q.first AS parent_conv_id, n.n_convs, n_children, n_leaves, saved AS saved_tokens, n.ends_sha256
        FROM n JOIN kids USING (node, depth) JOIN leaf USING (node, depth)
        LEFT JOIN up ON up.node = n.node AND up.depth = n.depth AND up.over_depth = n.depth - 1 LEFT JOIN n q ON q.node = up.over AND q.depth = up.over_depth""",
}
