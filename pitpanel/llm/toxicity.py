"""Toxicity scores: Levenshtein automata run over a lexicon trie, weighed by context windows.

The lexicon is learned from labelled training rows (a bounded sample) by smoothed log-odds of the words.  Every word of a
text runs as a Levenshtein automaton over the trie of the lexicon, so misspelled terms are caught within the same walk.
A hit counts less when it is quoted or reported and more when it is addressed to somebody; a logistic regression on these
sums gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import arrow_map, text_of, texts
from pitpanel.sources.workdir import materialise

TOXIC_ROWS, CLEAN_ROWS = 6_000, 12_000  # most labelled rows that the lexicon and the regression are fitted on
LEXICON_TERMS = 150
LEAST_TOXIC_DOCS = 3
LEAST_ODDS, LEAST_G2 = 2.5, 20.0  # log-odds and likelihood ratio that a term must reach
LEAST_SHARE = 0.04  # of the likelihood ratio of the best term; words of a few copied texts stay below it
FUZZY_LENGTH = 5  # shorter terms must match exactly
FUZZY_FACTOR = 0.7
QUOTED, ADDRESSED = 0.2, 1.3
WINDOW = 6
CACHE_WORDS = 300_000
WORD = re.compile(r"[^\W_](?:[\w@$!*']*\w)?")
#: Fixed cue words of the four languages of the tables.
REPORTING = frozenset("said says wrote writes called quote quoted quotes slur écrit appelé citation sagte schrieb nannte zitat zitiert escribió llamó palabra".split())
ADDRESS = frozenset("you your yourself u ur tu toi vous ton votre du dich dein ihr euch tú usted ustedes vosotros".split())
QUOTES = "\"“”„«»‘"


class Trie:
    """Lexicon trie that is walked together with the Levenshtein automaton of a word (bit-parallel states of 0 and 1 errors)."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.longest = max(map(len, terms), default=0)
        self.parts: dict[int, tuple[dict, set[str]]] = {}  # by length of the word: trie of the terms within one letter, their ends
        for n in range(1, self.longest + 2):
            root, ends = {}, set()
            for term in terms:
                if abs(len(term) - n) > (len(term) >= FUZZY_LENGTH):
                    continue
                node = root
                for c in term:
                    node = node.setdefault(c, {})
                node[""] = term
                k = 3 if len(term) > 5 else 2  # one error leaves the first or the last letters as they were
                ends |= {"^" + term[:k], term[-k:] + "$"}
            self.parts[n] = root, ends

    def match(self, word: str) -> tuple[str, int] | None:
        """Best (term, errors) with at most one error, heaviest term first among the nearest; None if there is none."""
        if word in self.terms:
            return word, 0
        n = len(word)
        root, ends = self.parts.get(n, ({}, ()))
        if not ends or ends.isdisjoint(("^" + word[:3], word[-3:] + "$", "^" + word[:2], word[-2:] + "$")):
            return None
        mask: dict[str, int] = {}
        for i, c in enumerate(word):
            mask[c] = mask.get(c, 0) | 1 << i
        full, best = (1 << n + 1) - 1, None
        walk = [(root, 1, 3 & full)]
        while walk:
            node, none, one = walk.pop()
            for c, child in node.items():
                if c == "":
                    errors = 0 if none >> n & 1 else 1 if one >> n & 1 else 2
                    if errors == 0 or errors == 1 and len(child) >= FUZZY_LENGTH:
                        rank = (errors, -self.terms[child], child)
                        best = rank if best is None or rank < best else best
                    continue
                m = mask.get(c, 0)
                exact = (none & m) << 1
                near = ((one & m) << 1 | none << 1 | none | exact << 1) & full
                if exact | near:
                    walk.append((child, exact, near))
        return best and (best[2], best[0])


class Scorer:
    """Feature sums of a text for a lexicon; holds a bounded cache of the words seen."""

    def __init__(self, terms: dict[str, float]):
        self.trie, self.cache = Trie(terms), {}

    def lookup(self, word: str):
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        found = self.cache[word] = self.trie.match(word)
        return found

    def features(self, text: str) -> tuple[float, float]:
        """log(1 + weighed hits) and log(1 + distinct terms, each by its strongest context)."""
        lower = text.lower()
        words = WORD.findall(lower)
        cache, bad = self.cache, {}
        for w in set(words):
            found = cache[w] if w in cache else self.lookup(w)
            if found:
                bad[w] = found
        if not bad:
            return 0.0, 0.0
        spans = [(m.start(), m.end()) for m in WORD.finditer(lower)]
        total, strongest = 0.0, {}
        for i, w in enumerate(words):
            if w not in bad:
                continue
            term, errors = bad[w]
            lo, hi = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
            factor = FUZZY_FACTOR ** errors
            before, after = lower[spans[lo][0]:spans[i][0]], lower[spans[i][1]:spans[hi - 1][1] + 1]
            if (any(q in before for q in QUOTES) and any(q in after for q in QUOTES)) or not REPORTING.isdisjoint(words[max(0, i - 3):i]):
                factor *= QUOTED
            elif not ADDRESS.isdisjoint(words[lo:hi]):
                factor *= ADDRESSED
            total += self.trie.terms[term] * factor
            strongest[term] = max(strongest.get(term, 0.0), factor)
        return math.log1p(total), math.log1p(sum(strongest.values()))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5; 0 marks held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of a bounded sample of the labelled rows outside the held-out part, chosen by hash order."""
    own = labels.filter("doc_id is not null and toxic is not null").filter(remainder(F.col("doc_id")) != 0)
    own = own.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))

    def some(kind: int, n: int) -> DataFrame:
        return own.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    chosen = some(1, toxic_rows).unionByName(some(0, clean_rows)).select(F.col("doc_id").alias("id"), "toxic")  # at most 18,000 rows
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", text_of().alias("text"), "toxic")


def learn_lexicon(rows: DataFrame, terms: int = LEXICON_TERMS) -> dict[str, float]:
    """The ``terms`` words that tell toxic from other texts best by their likelihood ratio, with their log-odds; words count once per text."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen = (Counter(), Counter())
            for t, y in zip(texts(batch), batch.column("toxic").to_pylist()):
                seen[y].update({w for w in WORD.findall(t.lower()) if 3 <= len(w) <= 40})
            words = [*(seen[0].keys() | seen[1].keys())]
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "bad": pa.array([seen[1][w] for w in words], pa.int64()), "good": pa.array([seen[0][w] for w in words], pa.int64())})
        return apply

    rows = rows.select("text", "toxic").dropDuplicates(["text"])  # copies are one witness
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return {}
    counts = arrow_map(rows, make, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total = F.col("bad") + F.col("good")
    odds = F.log((F.col("bad") + 0.5) / (n[1] + 1.0)) - F.log((F.col("good") + 0.5) / (n[0] + 1.0))
    part = lambda c, k: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * (n[0] + n[1]) / (total * n[k]))).otherwise(0.0)
    top = counts.filter(F.col("bad") >= LEAST_TOXIC_DOCS).withColumns({"odds": odds, "g2": 2 * (part("bad", 1) + part("good", 0))})
    top = top.filter((F.col("odds") >= LEAST_ODDS) & (F.col("g2") >= LEAST_G2)).orderBy(F.desc("g2"), "word").limit(terms)
    best = top.collect()
    return {r["word"]: float(r["odds"]) for r in best if r["g2"] >= LEAST_SHARE * best[0]["g2"]}


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps on the bounded training sample; classes weigh alike."""
    x = np.column_stack([np.ones(len(x)), x])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta, pen = np.zeros(x.shape[1]), ridge * np.r_[1e-3, np.ones(x.shape[1] - 1)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (share * (y - p)) - pen * beta
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.diag(pen + 1e-9), grad)
        beta += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[float]]:
    """Lexicon and regression weights.  Without both classes in the labels the lexicon is empty and every score is 0."""
    sample = materialise(training_rows(docs, labels), "toxic")
    lexicon = learn_lexicon(sample)
    if not lexicon:
        return {}, [-30.0, 0.0, 0.0]

    def make():
        scorer = Scorer(lexicon)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            f = np.array([scorer.features(t) for t in texts(batch)], float).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(c) for c in f.T]], names=["toxic", "a", "b"])
        return apply

    rows = arrow_map(sample, make, "toxic int, a double, b double").collect()  # bounded by the sample
    data = np.array([tuple(r) for r in rows], float)
    return lexicon, fit(data[:, 1:], data[:, 0]).tolist()


def _scores(model):
    lexicon, beta = model
    scorer = Scorer(lexicon)

    def scores(batch: pa.RecordBatch, column: str) -> np.ndarray:
        f = np.array([scorer.features(t) for t in texts(batch, column)], float).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(beta[0] + f @ np.array(beta[1:]), -30, 30)))
    return scores


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts have no hits and get the score of a text without hits.  A null id is not held out.  Rows are
    scored one by one, so ties and repeated rows repeat; an empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = train(docs, labels)
    rows = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), text_of().alias("text"))

    def make():
        scores = _scores(model)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = scores(batch, "text")
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                              names=["doc_id", "held_out", "score", "predicted"])
        return apply

    return arrow_map(rows, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose score is below 0.5, with their own columns; rejected rows leave in the same pass, without a shuffle."""
    model = train(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels)
    at = docs.columns.index(text)

    def make():
        scores = _scores(model)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(scores(batch, batch.schema.names[at]) < 0.5))
        return apply

    return arrow_map(docs, make, docs.schema)
