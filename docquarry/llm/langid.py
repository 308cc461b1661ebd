"""Language identification: script ranges narrow the candidates, Viterbi over words labels spans.

Learning: words of labelled texts are counted by language over a bounded sample (SAMPLE_DOCS, documented parameter); so
are character n-grams of those words, for words that weren't seen LEAST_COUNT times, and scripts. A word is a run of letters; runs
above WORD_LETTERS, as scripts without blanks have them, are cut into as many words as it takes, and all of them count. Prediction: each word's script picks the
candidate languages, its word score (or its n-gram score) gives log probabilities, and the best path through the
languages, with SWITCH_PENALTY for each change, labels spans. The document's language has the most letters in its spans;
the score is the mean of its share of the letters and of its mean word posterior.

The language with the largest sum is accepted at once where no other gains more than half the penalty on any run of words
(k runs of others need k - 1 switches at least, so none can pay); only other documents go through the full Viterbi recursion, in lockstep.

Edge cases: null text or text without letters: `und` with score 1.0. Words of a script that no learned language uses count
for no language; a text of only such words goes to the language with the largest prior. With no labelled row at all every
text with letters is `und` with score 0.0. Each row has a result of its own, repeated rows and rows without a doc_id too; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docquarry.llm.bpe import slices
from docquarry.llm.common import mix64, spare
from docquarry.session import ship, spread

#: Documents from which a model is learned, about, picked by a hash of doc_id.
SAMPLE_DOCS = 20_000
#: A word with a score of its own was seen so often in a language; rarer ones go by their n-grams.
LEAST_COUNT = 3
#: Words whose scores a worker remembers, before it starts afresh.
CACHE = 150_000
SWITCH_PENALTY = 12.0
#: Bytes of text whose words are held together, about.
SLICE = 1 << 20
#: Columns that label_rows() adds; names that no input should have.
LABEL, LABEL_SCORE = "__docquarry_lang__", "__docquarry_lang_score__"
WORD_LETTERS = 24
WORD = re.compile(rf"[^\W\d_]{{1,{WORD_LETTERS}}}")
#: First code points of blocks, and their script. Fixed values of the Unicode standard.
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"),
    (0x0E00, "thai"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2C60, "latin"), (0x2E80, "han"),
    (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
]
_STARTS = [a for a, _ in SCRIPT_STARTS]


def script_of(word: str) -> str:
    """Script of a word's first letter."""
    return SCRIPT_STARTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


#: Rows of the hashed n-gram table.
GRAM_ROWS = 1 << 18


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the n-gram table for the 2-, 3- and 4-grams of all words together, and the word number of each."""
    marked = [f"^{w}$" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, marked), np.int64, len(marked)))
    rows, owners = [], []
    with np.errstate(over="ignore"):
        h = code
        for n in (2, 3, 4):
            h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
            whole = owner[: len(h)] == owner[n - 1 :]
            rows.append((mix64(h[whole]) & np.uint64(GRAM_ROWS - 1)).astype(np.int64))
            owners.append(owner[: len(h)][whole])
    return np.concatenate(rows), np.concatenate(owners)


def learn(documents: DataFrame, train, sample_docs: int = SAMPLE_DOCS) -> dict:
    """A model from the rows where `train` holds and lang isn't null."""
    spark = documents.sparkSession
    ship(spark)
    rows = documents.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.count()
    share = min(1.0, sample_docs / max(n, 1))
    bounded = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))

    def count(batches):
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                seen[lang].update(WORD.findall(text.lower()))
        for lang, words in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    words = bounded.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    model = model_from(words.toArrow())  # the words of about SAMPLE_DOCS documents
    spare()
    return model


def model_of(counts: dict[str, dict[str, int]]) -> dict:
    """model_from() of word counts by language."""
    rows = [(lang, w, n) for lang, words in counts.items() for w, n in words.items()]
    lang, word, n = zip(*rows, strict=True) if rows else ([], [], [])
    return model_from(pa.table({"lang": pa.array(lang, pa.string()), "word": pa.array(word, pa.string()), "n": pa.array(n, pa.int64())}))


def model_from(table: pa.Table) -> dict:
    """Log scores from rows of lang, word and n. Words become Python strings some thousands at a time."""
    import pyarrow.compute as pc

    langs = sorted(x for x in pc.unique(table["lang"]).to_pylist())
    if not langs:
        return {"langs": []}
    often = pc.unique(table.filter(pc.greater_equal(table["n"], LEAST_COUNT))["word"])
    vocabulary = sorted(often.to_pylist())
    number = {w: i for i, w in enumerate(vocabulary)}
    words, totals = np.zeros((len(vocabulary), len(langs))), np.zeros(len(langs))
    grams, scripts = np.zeros((GRAM_ROWS, len(langs))), [Counter() for _ in langs]
    for k, lang in enumerate(langs):
        own = table.filter(pc.equal(table["lang"], lang))
        totals[k] = max(1, pc.sum(own["n"]).as_py() or 0)
        for part in own.select(["word", "n"]).to_batches(max_chunksize=8192):
            some, n = part["word"].to_pylist(), part["n"].to_numpy().astype(float)
            rows, owner = gram_rows(some)
            grams[:, k] += np.bincount(rows, 1 + np.log(n)[owner], GRAM_ROWS)
            for w, m in zip(some, n.tolist(), strict=True):
                scripts[k][script_of(w)] += m
                at = number.get(w)
                if at is not None:
                    words[at, k] = m
    words = np.log((words + 0.05) / (totals + 0.05 * len(vocabulary))).astype(np.float32)
    grams = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * GRAM_ROWS)).astype(np.float32)
    uses = {s: [scripts[k][s] > 0.001 * totals[k] for k in range(len(langs))] for s in {s for c in scripts for s in c}}
    return {"langs": langs, "number": number, "word": words, "gram": grams, "scripts": uses, "prior": int(np.argmax(totals))}


class Scorer:
    """Word scores of a model: a row of centred log scores for each word, remembered."""

    def __init__(self, model: dict):
        self.model, self.langs = model, model["langs"]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.zeros((0, max(1, len(self.langs))), np.float32)

    def add(self, words) -> None:
        """Score words that aren't known yet, all at once."""
        new = [w for w in words if w not in self.number]
        if not new:
            return
        model, k = self.model, len(self.langs)
        at = np.array([model["number"].get(w, -1) for w in new])
        out = np.empty((len(new), k), np.float32)
        out[at >= 0] = model["word"][at[at >= 0]]
        odd = np.flatnonzero(at < 0)
        if len(odd):
            rows, owner = gram_rows([new[i] for i in odd])
            n = np.bincount(owner, minlength=len(odd))
            strength = np.minimum(3.0, np.sqrt(n / 3))
            for j in range(k):
                out[odd, j] = np.bincount(owner, model["gram"][rows, j], len(odd)) / n * strength
        out = np.clip(out - out.max(axis=1, keepdims=True), -8.0, 0.0)
        masks = {s: np.array(m) for s, m in model["scripts"].items() if any(m)}
        for i, s in enumerate(map(script_of, new)):
            mask = masks.get(s)
            if mask is None:
                out[i] = 0
            elif not mask.all():
                out[i, ~mask] = -8.0
        self.number.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, out])

    def of(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word; add() has seen them all."""
        return self.rows[list(map(self.number.__getitem__, words))]


def viterbi(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best language of each word for one document; scores has a row for each word."""
    rows = scores.tolist()
    best, states = rows[0], range(scores.shape[1])
    leads, stays = [0], [None]
    for row in rows[1:]:
        top = max(best)
        lead, jump = best.index(top), top - penalty
        leads.append(lead)
        stays.append([x >= jump for x in best])
        best = [(best[j] if best[j] >= jump else jump) + row[j] for j in states]
    path = np.empty(len(rows), np.int64)
    at = best.index(max(best))
    for t in range(len(rows) - 1, 0, -1):
        path[t] = at
        if not stays[t][at]:
            at = leads[t]
    path[0] = at
    return path


def label(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """viterbi(), with the short cut for documents in which no switch pays."""
    lead = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores.astype(np.float64) - scores[:, [lead]], axis=0)
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, gain.shape[1])), gain[:-1]]), axis=0)
    if (gain - low).max() <= penalty / 2:
        return np.full(len(scores), lead, np.int64)
    return viterbi(scores, penalty)


def spans(text: str, scorer: Scorer) -> list[tuple[int, int, str]]:
    """(start, end, language) of each span of a text."""
    found = list(WORD.finditer(text))
    if not found or not scorer.langs:
        return []
    words = [m.group().lower() for m in found]
    scorer.add(set(words))
    path = label(scorer.of(words))
    cut = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return [(found[a].start(), found[b - 1].end(), scorer.langs[path[a]]) for a, b in zip(cut, cut[1:], strict=False)]


def predict_many(texts: list[str | None], scorer: Scorer) -> list[tuple[str, float]]:
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    if len(scorer.number) > CACHE:
        scorer.forget()
    if scorer.langs:
        scorer.add(set().union(*words))
    return [predict_words(w, scorer) for w in words]


def predict_words(words: list[str], scorer: Scorer) -> tuple[str, float]:
    if not words:
        return "und", 1.0
    if not scorer.langs:
        return "und", 0.0
    scores = scorer.of(words)
    if not scores.any():
        return scorer.langs[scorer.model["prior"]], 0.0
    path = label(scores)
    letters = np.fromiter(map(len, words), np.float64, len(words))
    weight = np.bincount(path, letters, len(scorer.langs))
    lead = int(weight.argmax())
    odds = np.exp(scores)
    sure = float((odds[:, lead] / odds.sum(axis=1) * letters).sum() / letters.sum())
    return scorer.langs[lead], float(min(1.0, max(0.0, 0.5 * weight[lead] / weight.sum() + 0.5 * sure)))


_SCORERS: dict[int, Scorer] = {}


def _labeller(held, out):
    def run(batches):
        scorer = _SCORERS.get(0)
        if scorer is None or scorer.model is not held.value:
            scorer = _SCORERS[0] = Scorer(held.value)
        for batch in batches:
            for piece in slices(batch, SLICE):
                got = predict_many(piece["text"].to_pylist(), scorer)
                yield out(piece, pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64()))
        # models of tasks that are over must not pile up in a worker that is used again
        _SCORERS.clear()
        held.__dict__.pop("_value", None)
        spare()

    return run


def predict_table(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of each whole text."""
    spark = documents.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # bounded by the sample and by GRAM_ROWS, for each language
    out = lambda piece, lang, score: pa.RecordBatch.from_arrays([piece["doc_id"], lang, score], names=["doc_id", "lang_pred", "score"])
    return spread(documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")).mapInArrow(_labeller(held, out), "doc_id long, lang_pred string, score double")


def label_rows(documents: DataFrame, model: dict) -> DataFrame:
    """The rows themselves with the columns LABEL and LABEL_SCORE added."""
    spark = documents.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    schema = T.StructType([*documents.schema.fields, T.StructField(LABEL, T.StringType()), T.StructField(LABEL_SCORE, T.DoubleType())])
    names = schema.names
    out = lambda piece, lang, score: pa.RecordBatch.from_arrays([*piece.columns, lang, score], names=names)
    return documents.mapInArrow(_labeller(held, out), schema)


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
