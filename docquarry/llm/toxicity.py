"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows that tell quotation from abuse.

Learning (from labelled training rows only): terms of the lexicon are words, and stems (beginnings of words, written
`stem*`), that occur mostly in documents labelled 1. A sample of SAMPLE_DOCS labelled documents bounds the work and the
lexicon. Scoring: each distinct word runs through the trie together with the state of a Levenshtein
automaton, which accepts terms within one edit for words of MISSPELT letters or more. A hit's weight is its term's log
odds; a misspelt hit counts less. In the window of WINDOW words before a hit and within quotation marks, words of
reporting, denial or quotation lower the weight. A logistic curve over the sum of weights, fitted on the training rows,
gives the score.

A quotation goes from an opening mark to the next closing one, however far; one that isn't closed is none.

Edge cases: a null or empty text, or one without a hit, gets the score of weight zero, which is below 0.3 unless the
training rows say otherwise. Without any training row labelled 1 the score is near 0 for all. Each row has a result of its
own, repeated rows and rows without a doc_id too; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docquarry.llm.bpe import slices
from docquarry.session import ship, spread, stash

#: Labelled training documents from which the lexicon and the curve are learned, about, picked by a hash of doc_id.
SAMPLE_DOCS = 20_000
LEAST_ODDS = 3.4
MISSPELT, WINDOW = 5, 3
WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.3
#: Words that report or deny what follows, in English, German, French and Spanish. Fixed values.
REPORTING = frozenset("""
said says called quoted quote wrote word term not never no
sagte sagt nannte zitierte schrieb wort begriff nicht nie kein
dit disait appelle cite mot terme pas jamais
dijo dice llamó citó escribió palabra término nunca
""".split())
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}

OPENING = re.compile("[" + "".join(QUOTES) + "]")


class Trie:
    """Terms with weights; a term that ends in * stands for all words that begin with it."""

    def __init__(self, terms: dict[str, float]):
        self.child: list[dict[str, int]] = [{}]
        self.word: list[float | None] = [None]
        self.stem: list[float | None] = [None]
        for term, weight in terms.items():
            at = 0
            for c in term.rstrip("*"):
                at = self.child[at].setdefault(c, len(self.child))
                if at == len(self.child):
                    self.child.append({})
                    self.word.append(None)
                    self.stem.append(None)
            (self.stem if term.endswith("*") else self.word)[at] = weight
        whole = [t for t in terms if not t.endswith("*") and len(t) >= MISSPELT]
        self.halves = {(len(t), t[: len(t) // 2], True) for t in whole} | {(len(t), t[len(t) // 2 :], False) for t in whole}

    def may_be_near(self, word: str) -> bool:
        """One edit leaves either half of a term as it is."""
        for n in range(len(word) - 1, len(word) + 2):
            if (n, word[: n // 2], True) in self.halves or (n, word[n // 2 - n :], False) in self.halves:
                return True
        return False

    def exact(self, word: str) -> float:
        """Largest weight of a term or stem that the word is or begins with."""
        at, best = 0, 0.0
        for c in word:
            at = self.child[at].get(c, -1)
            if at < 0:
                return best
            if self.stem[at] is not None:
                best = max(best, self.stem[at])
        return max(best, self.word[at] or 0.0)

    def near(self, word: str) -> float:
        """Largest weight of a whole term within one edit: the trie and the word's automaton walked together.

        A state of the automaton is (letters read, edits made); a set of states goes along each path of the trie.
        """
        n, best = len(word), 0.0
        stack = [(0, frozenset({(0, 0), (1, 1)}), 0)]
        while stack:
            at, states, depth = stack.pop()
            if self.word[at] is not None and depth >= MISSPELT and any(n - i <= 1 - e for i, e in states):
                best = max(best, self.word[at])
            for c, nxt in self.child[at].items():
                go = set()
                for i, e in states:
                    if i < n and word[i] == c:
                        go.add((i, e))
                    elif e == 0:
                        go.add((i - 1, 1))  # an extra letter in the term
                        if i < n:
                            go.add((i, 1))  # another letter
                    if e == 0 and i < n and word[i] == c:
                        go.add((i - 1, 1))
                        go.add((i, 1))
                moved = set()
                for i, e in go:
                    moved.add((i + 1, e))
                    if e == 0 and i + 2 <= n:
                        moved.add((i + 2, 1))  # a letter of the word left out
                if moved:
                    stack.append((nxt, frozenset(moved), depth + 1))
        return best


class Scorer:
    def __init__(self, model: dict):
        self.model, self.trie = model, Trie(model["terms"])
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            got = self.trie.exact(word)
            if not got and len(word) >= MISSPELT - 1 and self.trie.may_be_near(word):
                got = 0.6 * self.trie.near(word)
            if len(self.known) < 400_000:
                self.known[word] = got
        return got

    def total(self, text: str | None) -> float:
        """Sum of the weights of all hits, each lowered by its context."""
        if not text:
            return 0.0
        low = text.lower()
        words = WORD.findall(low)
        distinct = set(words)
        hits = {w: x for w in distinct if (x := self.weight(w))}
        if not hits:
            return 0.0
        held = quoted(low)
        out = 0.0
        where = [m.start() for m in WORD.finditer(low)] if held else []
        for i, w in enumerate(words):
            x = hits.get(w)
            if x:
                if REPORTING.intersection(words[max(0, i - WINDOW) : i]):
                    x *= 0.7
                if held and any(a <= where[i] < b for a, b in held):
                    x *= 0.4
                out += x
        return out

    def score(self, text: str | None) -> float:
        a, b = self.model["curve"]
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(self.total(text))))))


def quoted(text: str) -> list[tuple[int, int]]:
    """Spans from an opening quotation mark to the next closing one."""
    out, at = [], 0
    while m := OPENING.search(text, at):
        end = text.find(QUOTES[m.group()], m.end())
        if end >= 0:
            out.append((m.start(), end))
            at = end + 1
        else:
            at = m.end()
    return out


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def learn(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict:
    """A model from the labelled rows outside the held-out quarter."""
    spark = documents.sparkSession
    ship(spark)
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    n = marks.count()
    share = min(1.0, sample_docs / max(n, 1))
    picked = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # picked: about SAMPLE_DOCS rows of two numbers. Equal texts count once; three passes read them
    rows = stash(texts.join(F.broadcast(picked), "doc_id").groupBy("text").agg(F.max("y").alias("y")), "labelled")

    def stems(batches):
        seen = (Counter(), Counter())
        docs = [0, 0]
        for batch in batches:
            for y, text in zip(batch["y"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = set(WORD.findall(text.lower())) if text else set()
                seen[y == 1].update(words)
                seen[y == 1].update({w[:k] + "*" for w in words for k in (4, 5, 6) if len(w) > k})
                docs[y == 1] += 1
        for y in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([y] * (len(seen[y]) + 1), pa.int32()), pa.array(["", *seen[y]]), pa.array([docs[y], *seen[y].values()], pa.int64())], names=["y", "term", "n"])

    counts = rows.select("y", "text").mapInArrow(stems, "y int, term string, n long").groupBy("term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good"))
    total = counts.where("term = ''").first()
    if total is None or not total["bad"]:
        return {"terms": {}, "curve": (-30.0, 0.0)}
    bad_n, good_n = total["bad"], max(total["good"], 1)
    # log odds from a lower bound of the count among toxic texts, so that a chance group of copies makes no term
    sure = F.greatest(F.col("bad") - F.sqrt("bad"), F.lit(0.1))
    odds = F.log(sure / F.lit(bad_n + 1.0)) - F.log((F.col("good") + 1.0) / F.lit(good_n + 1.0))
    top = counts.where("term != '' and bad >= 3").withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).select("term", "bad", "odds")
    terms = lexicon({r["term"]: (r["bad"], float(r["odds"])) for r in top.collect()})
    model = {"terms": terms, "curve": (0.0, 1.0)}
    held = spark.sparkContext.broadcast(model)

    def sums(batches):
        scorer = Scorer(held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["y"], pa.array([scorer.total(t) for t in batch["text"].to_pylist()], pa.float64())], names=["y", "x"])

    binned = rows.select("y", "text").mapInArrow(sums, "y int, x double").groupBy("y", F.round(F.log1p("x"), 1).alias("x")).count().collect()
    model["curve"] = logistic(np.array([r["x"] for r in binned]), np.array([r["y"] for r in binned], float), np.array([r["count"] for r in binned], float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Weights of a one-variable logistic regression, by Newton's method with a ridge."""
    design = np.stack([np.ones_like(x), x], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - ridge * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + (ridge + 1e-9) * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def lexicon(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Stems that several words share, and the words that no such stem covers."""
    words = {t: x for t, x in found.items() if not t.endswith("*")}
    kept: dict[str, float] = {}
    for stem, (bad, odds) in sorted(found.items(), key=lambda x: (len(x[0]), x[0])):
        if not stem.endswith("*") or any(stem[:k] + "*" in kept for k in (4, 5)):
            continue
        if bad >= 8 and max((n for t, (n, _) in words.items() if t.startswith(stem[:-1])), default=0) <= 0.7 * bad:
            kept[stem] = odds
    return kept | {t: odds for t, (_, odds) in words.items() if not any(t[:k] + "*" in kept for k in (4, 5, 6))}


_SCORERS: dict[int, Scorer] = {}


def score_table(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of each whole text."""
    spark = documents.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        scorer = _SCORERS.get(0)
        if scorer is None or scorer.model is not held.value:
            scorer = _SCORERS[0] = Scorer(held.value)
        for batch in batches:
            for piece in slices(batch):
                yield pa.RecordBatch.from_arrays([piece["doc_id"], pa.array([scorer.score(t) for t in piece["text"].to_pylist()], pa.float64())], names=["doc_id", "score"])

    return spread(documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")).mapInArrow(run, "doc_id long, score double")
