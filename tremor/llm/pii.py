"""Personal data: exact base patterns, and terms that reveal the people behind them.

Base kinds are found by regular expressions and checked by value. The expressions are written so that they match what their
plain forms match, in linear time and without recursion: possessive repeats, and starts only at the beginning of a run of
the first class or where the last match ended.

Information-theoretic sanitisation: entities are a base value, what it shares with others (e-mail domain, phone or card prefix,
network) and its kind. Over whole documents, pmi(term, entity) = log2(p(both) / (p(term) p(entity))) tells how much a term
reveals of an entity's own information -log2 p(entity). Their ratio is 1 when every document with the term has the entity.
From ``generalise`` on a term is replaced by its kind, from ``remove`` on it is removed, wherever it stands outside of base
values. Evidence is a significance test: that as many of the entity's texts have the term by chance must be less likely than
``alpha`` over all pairs tried. Near copies are one text there, else any copied text's words would all seem to reveal.

All work is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import components, fresh, likely_in, staged

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "phone": "+"}  # a text without it has no match
MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "generalise": "<TERM>", "remove": ""}
ALPHA = 0.01
KEYS, MINIMA = 6, 4  # near copies meet in one of KEYS keys of MINIMA smallest shingle hashes each
TERM = r"\p{L}{3,}+"
GENERALISE, REMOVE = 0.8, 0.95
BLOCK = 256
SPAN = "struct<kind:string,start:int,end:int>"


def running_sums(sizes: Column) -> Column:
    """Sums of the elements before each element. In blocks, as appending to one array would take quadratic time."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))
    inner = F.transform(blocks, _sums_in_block)
    outer = _sums_in_block(F.transform(blocks, _total))
    return F.when(F.size(sizes) > 0, F.flatten(F.zip_with(inner, outer, lambda block, base: F.transform(block, lambda x: x + base)))).otherwise(F.array().cast("array<int>"))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def _sums_in_block(a: Column) -> Column:
    return F.aggregate(a, F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("sum")),
                       lambda s, x: F.struct(F.concat(s["out"], F.array(s["sum"])).alias("out"), (s["sum"] + x).alias("sum")))["out"]


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255))
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        marks = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
        return F.when(F.length(digits).between(13, 19), _total(marks) % 10 == 0).otherwise(F.lit(False))
    return F.lit(True)


def _matches(df: DataFrame, kind: str) -> DataFrame:
    """Adds ``<kind>``: array of (start, value) of the valid matches in ``text``."""
    pattern = F.lit(PATTERNS[kind])
    some = F.contains(F.col("text"), F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
    none = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(some, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(none))
    df = df.withColumn("_s", F.when(F.size("_m") > 0, F.split("text", PATTERNS[kind], -1)).otherwise(none))
    df = df.withColumn("_at", running_sums(F.transform(F.arrays_zip("_s", "_m"), lambda z: F.length(z["_s"]) + F.coalesce(F.length(z["_m"]), F.lit(0)))))
    found = F.transform(F.col("_m"), lambda m, i: F.struct(
        (F.element_at("_at", i + 1) + F.length(F.element_at("_s", i + 1))).alias("start"), m.alias("value")))
    return df.withColumn(kind, F.filter(found, lambda x: valid(kind, x["value"]))).drop("_m", "_s", "_at")


def terms_of(text: Column) -> Column:
    """Distinct terms."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def places_of(text: Column) -> Column:
    """(term, start, size) of all terms."""
    words, gaps = F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.split(text, TERM, -1)
    at = running_sums(F.transform(F.arrays_zip(gaps.alias("g"), words.alias("w")), lambda z: F.length(z["g"]) + F.coalesce(F.length(z["w"]), F.lit(0))))
    parts = F.arrays_zip(words.alias("w"), at.alias("at"), gaps.alias("g"))
    found = F.transform(parts, lambda z: F.struct(F.lower(z["w"]).alias("term"), (z["at"] + F.length(z["g"])).cast("int").alias("start"), F.length(z["w"]).alias("size")))
    return F.filter(found, lambda x: x["term"].isNotNull())


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces in place of the spans, so that places stay."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    joined = F.aggregate(
        ordered, F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["end"] > acc["at"], F.concat(acc["parts"], F.array(
                F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.repeat(F.lit(" "), s["end"] - F.greatest(s["start"], acc["at"]))))).otherwise(acc["parts"]).alias("parts"),
            F.greatest(acc["at"], s["end"]).alias("at")),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return joined


def _spans_of(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end")))


def _entities_of(kind: str) -> Column:
    """For each value: the value, what it shares with others, and its kind, as hashes."""
    def levels(x: Column) -> Column:
        value, digits = F.lower(x["value"]), F.regexp_replace(x["value"], "[^0-9]", "")
        own = digits if kind in ("card", "phone") else value
        shared = {"email": F.substring_index(value, "@", -1), "ip": F.substring_index(value, ".", 3), "card": F.left(digits, F.lit(6)), "phone": F.left(digits, F.lit(4))}[kind]
        return F.array(*(F.xxhash64(F.lit(kind), F.lit(level), v) for level, v in (("value", own), ("shared", shared), ("kind", F.lit("")))))

    return F.flatten(F.transform(F.col(kind), levels))


def base_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, mark, base, entities, rest, inside): base spans by kind, then start; distinct entities; for texts with base
    values the text with them blanked, and the terms that stand in them only."""
    df = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    for kind in KINDS:
        df = _matches(df, kind)
    df = df.withColumn("base", F.concat(*(_spans_of(k) for k in KINDS)).cast(f"array<{SPAN}>"))
    df = df.withColumn("entities", F.array_distinct(F.concat(*(_entities_of(k) for k in KINDS))))
    df = df.withColumn("rest", F.when(F.size("base") > 0, blanked(F.col("text"), F.col("base"))))
    inside = F.when(F.size("base") > 0, F.array_except(terms_of(F.col("text")), terms_of(F.col("rest"))))
    return df.select("doc_id", "mark", "base", "entities", "rest", inside.alias("inside"))


def near_groups(texts: DataFrame) -> DataFrame:
    """(id, component) of those of ``texts(mark, rest)`` that have near copies: shingles of three terms, min-hashed."""
    words = F.transform(F.regexp_extract_all("rest", F.lit(TERM), F.lit(0)), F.lower)
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, F.lit(3))))
    least = lambda k: F.array_min(F.transform("s", lambda h: F.xxhash64(h, F.lit(k))))
    keys = F.array(*(F.xxhash64(F.lit(k), *(least(k * MINIMA + j) for j in range(MINIMA))) for k in range(KEYS)))
    keyed = staged(texts.select("mark", words.alias("w")).select("mark", shingles.alias("s")).select("mark", F.explode(keys).alias("key")), "keys")
    heads = keyed.groupBy("key").agg(F.min("mark").alias("head"), F.max("mark").alias("last")).where("head <> last").select("key", "head")
    return components(keyed.join(heads, "key").select(F.col("mark").alias("a"), F.col("head").alias("b")))


def disclosure(documents: DataFrame, found: DataFrame, alpha: float = ALPHA, generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, ratio) of the terms that reveal an entity by ``generalise`` or more."""
    total = float(found.count())
    texts = staged(found.where("size(entities) > 0").groupBy("mark").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("rest").alias("rest")), "texts")
    groups = near_groups(texts.select("mark", "rest"))
    texts = texts.join(groups.select(F.col("id").alias("mark"), "component"), "mark", "left").withColumn("group", F.coalesce("component", "mark")).drop("component")
    per_group = texts.select("group", "copies", F.explode("entities").alias("entity")).groupBy("entity", "group").agg(F.sum("copies").alias("copies"))
    # one text has every term of its own: two at least are needed to tell chance from a link
    entities = staged(per_group.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("of")).where("of > 1"), "entities")
    some = texts.select("mark", F.explode("entities").alias("entity")).join(entities.select("entity"), "entity").groupBy("mark").agg(F.collect_set("entity").alias("some"))
    near = texts.drop("entities").join(some, "mark").select("group", "copies", "some", F.explode(terms_of(F.col("rest"))).alias("term")).select("group", "copies", "term", F.explode("some").alias("entity"))
    both = (near.groupBy("entity", "term", "group").agg(F.sum("copies").alias("copies"))
            .groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.count("*").alias("texts")).where("texts > 1"))
    both = staged(both, "both")
    if not both.limit(1).count():
        return both.select("entity", "term", F.lit(0.0).alias("ratio"))
    # every document of the corpus counts for a term's frequency, whether or not an entity is in it
    each = documents.select(F.explode(terms_of(F.col("text"))).alias("term"), F.lit(1).alias("n"))
    inside = found.where("size(inside) > 0").select(F.explode("inside").alias("term"), F.lit(-1).alias("n"))
    terms = staged(each.unionByName(inside).groupBy("term").agg(F.sum("n").alias("n_term")).where("n_term > 0"), "terms")
    tried = float(entities.count()) * terms.count()
    pmi = F.log2(F.col("n_both") * F.lit(total) / (F.col("n_term") * F.col("n_entity")))
    own = -F.log2(F.col("n_entity") / F.lit(total))
    p, q = F.col("n_term") / F.lit(total), F.col("texts") / F.col("of")
    # Chernoff: of ``of`` texts, ``texts`` or more have the term by chance with a probability of exp(-unlikely) at most
    unlikely = F.when(q > p, F.col("of") * (q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0))).otherwise(0.0)
    return (both.join(terms, "term").join(entities, "entity").where(unlikely >= F.log(F.lit(tried / alpha)))
            .withColumn("ratio", F.when(own > 0, pmi / own).otherwise(0.0)).where(F.col("ratio") >= generalise).select("entity", "term", "ratio"))


def find_pii(documents: DataFrame, alpha: float = ALPHA, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(doc_id, mark, base, added): one row for each row of ``documents``; spans (kind, start, end) in code points, end exclusive.

    ``base`` holds email, ip, card and phone, by kind in this order, then start; ``added`` holds the revealing terms, of kind
    generalise or remove, by start. Null texts are empty and have no span. Rows alike in doc_id and text have the same
    spans. Other columns are ignored. An empty table gives an empty result.
    """
    found = staged(base_spans(documents), "base")
    open_terms = staged(disclosure(documents, found, alpha, generalise).groupBy("term").agg(F.max("ratio").alias("ratio")), "disclosure")
    none = F.array().cast(f"array<{SPAN}>")
    if not open_terms.limit(1).count():
        return found.select("doc_id", "mark", "base", none.alias("added"))
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    hits = likely_in(docs.select("doc_id", "mark", F.explode(terms_of(F.col("text"))).alias("term")), open_terms, ["term"]).join(open_terms, "term")
    hits = staged(hits.groupBy("doc_id", "mark").agg(F.map_from_entries(F.collect_set(F.struct("term", "ratio"))).alias("ratios")), "hits")
    same = lambda a, b: F.expr(f"{a}.doc_id <=> {b}.doc_id and {a}.mark = {b}.mark")
    rests = likely_in(found.where("rest is not null").select("doc_id", "mark", "rest"), hits, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    texts = (likely_in(docs, hits, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).alias("d").join(hits.alias("h"), same("d", "h")).select("d.*", "h.ratios").alias("t")
             .join(rests.alias("r"), same("t", "r"), "left").select("t.doc_id", "t.mark", "t.ratios", F.coalesce("r.rest", "t.text").alias("text")))
    kind = lambda t: F.when(F.element_at("ratios", t["term"]) >= remove, F.lit("remove")).otherwise(F.lit("generalise"))
    terms = F.filter(places_of(F.col("text")), lambda t: F.map_contains_key("ratios", t["term"]))
    added = F.transform(terms, lambda t: F.struct(kind(t).alias("kind"), t["start"].alias("start"), (t["start"] + t["size"]).alias("end"))).cast(f"array<{SPAN}>")
    added = staged(texts.select("doc_id", "mark", added.alias("added")), "added")
    return found.alias("f").join(added.alias("h"), same("f", "h"), "left").select("f.doc_id", "f.mark", "f.base", F.coalesce("h.added", none).alias("added"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind's mask; of spans that overlap, the first by start gives the mask for all."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"))))
    joined = F.aggregate(
        ordered, F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.create_map(*(F.lit(x) for kv in MASKS.items() for x in kv))[s["kind"]]))).otherwise(acc["parts"]).alias("parts"),
            F.greatest(acc["at"], -s["last"]).alias("at")))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(joined["parts"], ""), F.substring(text, joined["at"] + 1, F.length(text))))


def sanitise(documents: DataFrame, **thresholds: float) -> DataFrame:
    """``documents`` with base values masked and revealing terms generalised or removed in ``text``; n_chars, where there, follows."""
    spans = find_pii(documents, **thresholds).where("size(base) + size(added) > 0").dropDuplicates(["doc_id", "mark"])
    own = fresh(documents, "_mark")
    marked = documents.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    out = marked.alias("d").join(spans.alias("s"), F.expr(f"d.doc_id <=> s.doc_id and d.{own} = s.mark"), "left").withColumn(
        "_clean", F.when(F.col("s.base").isNull(), F.col("d.text")).otherwise(redacted(F.col("d.text"), F.concat("s.base", "s.added"))))
    keep = {"text": F.col("_clean"), "n_chars": F.when(F.col("s.base").isNull(), F.col("d.n_chars")).otherwise(F.length("_clean")).cast(dict(documents.dtypes).get("n_chars", "long"))} if "n_chars" in documents.columns else {"text": F.col("_clean")}
    return out.select(*(keep[c].alias(c) if c in keep else F.col(f"d.{c}") for c in documents.columns))
