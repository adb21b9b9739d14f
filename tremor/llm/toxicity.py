"""Toxicity by a weighted finite-state grammar over clauses.

A clause is a stretch of words between sentence marks or line ends. Each word has a class: insult, threat, target, negation,
reported speech, or none. Five small transducers read the clause side by side and their product's state at an insult or a
threat decides its reading: aimed at someone, plain, negated, or reported. The reading gets the word's weight; a clause's
score is the sum, and a text's features are the sums by reading, the best clause and the number of matched clauses. Words
alone give nothing.

Insults are learned: words and word beginnings of 4 to 6 bytes whose log-odds in toxic against other labelled texts stay high
after two standard errors. How much each reading counts is a logistic regression. To keep the regression honest, features of
each half of the sample come from the other half's lexicon. The other classes are short word lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.wordhash import chunks, mix, powers, prefix_hash

SAMPLE = 20_000  # labelled rows that the grammar is fitted on, at most
LEXICON = 4_096  # learned entries, at most
PREFIXES = (4, 5, 6)
NEGATION_REACH = 3

# Function words of the classes that are not learned, in English, German, French and Spanish.
TARGET = "you your yourself he him his she her they them their du dich dir dein ihr euch sie er tu toi te vous votre il elle ils ti usted ustedes vosotros ellos"
NEGATION = "not no never without isn't aren't don't nicht kein keine nie ohne ne pas jamais sans nunca jamás sin"
REPORTED = "said says say told wrote called claimed quote quoted sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó"
THREAT = "kill hurt destroy beat shoot stab töten schlagen zerstören tuer frapper détruire matar golpear destruir"

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39, 95]] = True
_WORD[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 59, 63]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
NONE, INSULT, THREATS, TARGETS, NEGATIONS, REPORTS = range(6)
READINGS = 6  # aimed, plain, negated and reported insult; aimed and other threat
WIDTH = READINGS + 2


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the upper-case letters of Latin-1 lower-cased."""
    out = _LOWER[data]
    late = np.flatnonzero(data == 0xC3) + 1
    late = late[late < len(data)]
    late = late[(data[late] >= 0x80) & (data[late] <= 0x9E) & (data[late] != 0x97)]
    out[late] += 32
    return out


class Tokens:
    """Words of a chunk of texts with the hashes that the lexicon uses."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n = len(data)
        word = _WORD[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = ~word[:-1], ~word[1:]
        self.start = np.flatnonzero(word & (before | edge[:-1]))
        self.end = np.flatnonzero(word & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        stop = np.cumsum(_STOP[data], dtype=np.int64)
        self.clause = stop[self.start] if len(self.start) else np.zeros(0, np.int64)
        low = lowered(data)
        h = prefix_hash(low)
        inv = powers(n + 1)[1][self.start]
        self.hash = mix((h[self.end] - h[self.start]) * inv)
        size = self.end - self.start
        self.parts = []
        for k in PREFIXES:
            long = np.flatnonzero(size > k)
            s = self.start[long]
            self.parts.append((long, mix((h[s + k] - h[s]) * inv[long] + np.uint64(k))))


def _hashes(words: str) -> np.ndarray:
    raw = words.encode()
    return np.sort(Tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hash)


def look_up(table: np.ndarray, values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Weight of each of ``of`` in the sorted ``table``, 0 if absent."""
    if not len(table):
        return np.zeros(len(of))
    at = np.minimum(np.searchsorted(table, of), len(table) - 1)
    return np.where(table[at] == of, values[at], 0.0)


def read_clause(kinds: list[int], weights: list[float]) -> list[float]:
    """Run the composed transducers over one clause; weight by reading."""
    out = [0.0] * READINGS
    aimed = TARGETS in kinds
    negated, reported = 0, False
    for kind, weight in zip(kinds, weights):
        if kind == NEGATIONS:
            negated = NEGATION_REACH + 1
        elif kind == REPORTS:
            reported = True
        elif kind == INSULT:
            out[3 if reported else 2 if negated else 0 if aimed else 1] += weight
        elif kind == THREATS:
            out[4 if aimed and not reported and not negated else 5] += weight
        negated = max(0, negated - 1)
    return out


class Grammar:
    def __init__(self, table: np.ndarray, values: np.ndarray, coef: np.ndarray | None = None):
        order = np.argsort(table)
        self.table, self.values, self.coef = table[order], values[order], coef
        self.lists = [(THREATS, _hashes(THREAT)), (TARGETS, _hashes(TARGET)), (NEGATIONS, _hashes(NEGATION)), (REPORTS, _hashes(REPORTED))]

    def features(self, col: pa.Array) -> np.ndarray:
        out = np.zeros((len(col), WIDTH))
        for i, _, data, off in chunks(col):
            tok = Tokens(data, off)
            weight = look_up(self.table, self.values, tok.hash)
            for long, part in tok.parts:
                weight[long] = np.maximum(weight[long], look_up(self.table, self.values, part))
            threat = look_up(self.lists[0][1], np.ones(len(self.lists[0][1])), tok.hash) > 0
            hits = np.flatnonzero((weight > 0) | threat)
            text = np.searchsorted(tok.first, hits, "right") - 1
            done = (-1, -1)
            for at, row in zip(hits.tolist(), text.tolist()):
                if (row, tok.clause[at]) == done:
                    continue
                done = (row, tok.clause[at])
                a = max(int(np.searchsorted(tok.clause, done[1], "left")), int(tok.first[row]))
                b = min(int(np.searchsorted(tok.clause, done[1], "right")), int(tok.first[row + 1]))
                kinds = np.zeros(b - a, int)
                for kind, listed in self.lists:
                    kinds[look_up(listed, np.ones(len(listed)), tok.hash[a:b]) > 0] = kind
                kinds[weight[a:b] > 0] = INSULT
                got = read_clause(kinds.tolist(), np.where(weight[a:b] > 0, weight[a:b], 1.0).tolist())
                f = out[i + row]
                f[:READINGS] += got
                f[READINGS] = max(f[READINGS], sum(got))
                f[READINGS + 1] += 1
        return np.log1p(out)

    def scores(self, col: pa.Array) -> np.ndarray:
        x = self.features(col)
        return 1 / (1 + np.exp(-np.clip(self.coef[0] + x @ self.coef[1:], -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Newton steps; the intercept has no penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -4.0
    keep = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, feature, toxic, other): texts that hold the feature."""
    for batch in batches:
        fold, toxic = np.asarray(batch.column("fold")), np.asarray(batch.column("toxic"))
        for i, _, data, off in chunks(batch.column("text")):
            tok = Tokens(data, off)
            row = np.repeat(np.arange(len(off) - 1), np.diff(tok.first))
            parts = [(row, tok.hash), *((row[long], part) for long, part in tok.parts)]
            pair = np.unique(np.rec.fromarrays([np.concatenate([p[1] for p in parts]), np.concatenate([p[0] for p in parts])], names="f,r"))
            f, r = pair.f, pair.r + i
            key = np.rec.fromarrays([f, fold[r]], names="f,fold")
            u, inv = np.unique(key, return_inverse=True)
            pos = np.bincount(inv, toxic[r], len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u.fold.astype(np.int32)), pa.array(u.f.view(np.int64)), pa.array(pos), pa.array(np.bincount(inv, minlength=len(u)) - pos)], names=["fold", "feature", "toxic", "other"])


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, lexicon: int = LEXICON) -> Grammar:
    """Fit on at most ``sample`` labelled rows outside the held-out fifth, chosen by a hash of doc_id."""
    rows = (labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
            .where("crc32(cast(doc_id as string)) % 5 <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
            .withColumn("fold", (F.abs(F.xxhash64(F.lit("fold"), "doc_id")) % 2).cast("int")))
    texts = documents.select(F.col("doc_id").cast("long"), "text").where("text is not null").join(F.broadcast(rows), "doc_id").select("fold", "toxic", "text")
    sizes = {(r.fold, r.toxic): r["count"] for r in texts.groupBy("fold", "toxic").count().collect()}
    found = (texts.mapInArrow(_counts, "fold int, feature long, toxic long, other long").groupBy("feature")
             .agg(*(F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in (0, 1) for c in ("toxic", "other")))
             .where("toxic0 + toxic1 >= 2 and toxic0 + toxic1 > other0 + other1"))
    # enough for every lexicon below; a feature beyond this rank is weaker than all that are kept
    ranked = found.orderBy(F.desc(F.expr("(toxic0 + toxic1) / sqrt(1D + other0 + other1)")), "feature").limit(4 * lexicon).toPandas()

    def learned(folds: tuple[int, ...]) -> Grammar:
        pos, neg = (sum(ranked[f"{c}{k}"].to_numpy(float) for k in folds) for c in ("toxic", "other"))
        p, n = (sum(sizes.get((k, c), 0) for k in folds) for c in (1, 0))
        weight = np.log((pos + 0.5) / (p + 1)) - np.log((neg + 0.5) / (n + 1))
        sure = weight - 2 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
        best = np.argsort(-sure, kind="stable")[:lexicon]
        best = best[sure[best] > 1.0]
        return Grammar(ranked["feature"].to_numpy(np.int64).view(np.uint64)[best], weight[best])

    halves = learned((1,)), learned((0,))

    def out_of_fold(batches):
        for batch in batches:
            x = np.zeros((batch.num_rows, WIDTH))
            for k in (0, 1):
                own = np.flatnonzero(np.asarray(batch.column("fold")) == k)
                x[own] = halves[k].features(batch.column("text").take(pa.array(own)))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, j]) for j in range(WIDTH)), batch.column("toxic")], names=[*(f"x{j}" for j in range(WIDTH)), "toxic"])

    seen = texts.mapInArrow(out_of_fold, ", ".join(f"x{j} double" for j in range(WIDTH)) + ", toxic int").toPandas().to_numpy(float)
    grammar = learned((0, 1))
    grammar.coef = fit_logistic(seen[:, :-1], seen[:, -1])
    return grammar


def toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All columns of ``documents`` with ``tox_score`` (0 to 1) and ``tox_predicted`` (1 from 0.5 on).

    Only the text decides a score; null is empty. Without labelled rows every text has the same low score. Columns of
    ``documents`` with these two names are replaced. An empty table gives an empty result.
    """
    grammar = fit(documents, labels, sample)

    def apply(batches):
        for batch in batches:
            score = grammar.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*batch.schema.names, "tox_score", "tox_predicted"])

    base = documents.drop("tox_score", "tox_predicted")
    schema = base.select("*", F.lit(0.5).cast("double").alias("tox_score"), F.lit(0).alias("tox_predicted")).schema
    for field in schema:
        field.nullable = True
    return base.mapInArrow(apply, schema)
