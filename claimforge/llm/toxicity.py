"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme-value theory.

Learning: tokens of labelled texts are counted by label; each token's score is its log-odds between the classes with an
informative Dirichlet prior (Monroe et al. 2008), less some standard errors, so that tokens seen equally often
in both classes, or rarely, score nothing or below. A text is then a sequence of scores, positive only for telling tokens,
and every maximal-scoring segment (Ruzzo and Tompa 1999) is found in linear time. Karlin-Altschul statistics turn a
segment's score and the text's length into an expected number of segments as good by chance; the best segment and the
sum over all significant ones are mapped to a probability by a logistic fit on learning rows that had no part in the token scores.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MEMO_ENTRIES, keyed, prepare, read, written

#: Labelled texts to learn from, at most: a bounded sample by hash of the id (all, while there are fewer).
LEARN_ROWS = 100_000
#: Clean texts that the chance law is fitted to, about (a sample by hash of the id).
CHANCE_ROWS = 2_000
#: Tokens in the model, at most: those with the largest absolute z-score.
MODEL_TOKENS = 50_000
#: Weight of the prior in each class: a share of the tokens in proportion to their counts, and a half for each token.
PRIOR, EACH = 100.0, 0.5
#: Standard errors taken off a log-odds before it counts.
SHRINK = 2.5
#: What a token of no known side costs.
NEUTRAL = -0.05
#: A segment expected by chance fewer times than this in a text is significant.
SIGNIFICANT = 0.05
#: Characters of a word's beginnings that are tokens of their own.
BEGINNINGS = (5, 7)
#: Numbers that stand for a text in the logistic map.
FEATURES = 3
WORD = re.compile(r"\w+")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def forms(word: str) -> list[str]:
    """What a word is counted as: itself, and its beginnings (compounds share them)."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if n < len(word))]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in order; linear time (Ruzzo and Tompa)."""
    found: list[list[float]] = []  # start, end, sum before it, sum up to its end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(a), int(b), e - s) for a, b, s, e in found]


def fold(doc_id: Column) -> Column:
    """0: held out. 1 to 3: token scores are learnt there. 4: the calibration."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def token_scores(counts: pd.DataFrame) -> dict[str, float]:
    """Scores from counts (token, toxic, clean): log-odds with a Dirichlet prior proportional to both together, shrunk."""
    both = counts.toxic + counts.clean
    prior = EACH + PRIOR * both / both.sum()
    a, b = counts.toxic + prior, counts.clean + prior
    odds = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    error = np.sqrt(1 / a + 1 / b)
    shrunk = np.sign(odds) * np.maximum(0, np.abs(odds) - SHRINK * error)
    return {t: float(s) for t, s in zip(counts.token, shrunk, strict=True) if s}


class Model:
    """Token scores, the Karlin-Altschul constants, and the logistic map."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.rate, self.size, self.map = scores, 1.0, 1.0, None
        self.words: dict[str, float] = {}

    def sequence(self, words: list[str]) -> list[float]:
        get = self.word_score
        return [get(w) + NEUTRAL for w in words]

    def word_score(self, word: str) -> float:
        """The score of the word's most telling form."""
        if word not in self.words:
            if len(self.words) > MEMO_ENTRIES:
                self.words.clear()
            self.words[word] = max((self.scores.get(f, 0.0) for f in forms(word)), key=abs)
        return self.words[word]

    def segments(self, text: str) -> list[tuple[int, int, float, float]]:
        """(first word, end word, score, expected number by chance) of every maximal segment."""
        words = tokens(text)
        n = max(1, len(words))
        return [(a, b, s, self.size * n * np.exp(-self.rate * s)) for a, b, s in maximal_segments(self.sequence(words))]

    def features(self, text: str) -> list[float]:
        """Evidence of a text: of its best segment, of all significant ones, whether there is one. Evidence saturates (at 20 and 50 nats):
        beyond that, more of it makes no text likelier toxic."""
        found = self.segments(text)
        if not found:
            return [0.0] * FEATURES
        surprise = [max(0.0, -np.log(max(e, 1e-300))) for *_, e in found]
        strong = [s for (*_, e), s in zip(found, surprise, strict=True) if e < SIGNIFICANT]
        best = max(surprise)
        return [min(best, 20.0), min(50.0, sum(strong)) ** 0.5, float(len(strong) > 0)]

    def probability(self, features: np.ndarray) -> np.ndarray:
        if self.map is None:
            return np.zeros(len(features))
        z = features @ self.map[1:] + self.map[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def chance_counts(model: Model, texts: DataFrame) -> tuple[dict[float, int], list[tuple[int, float]]]:
    """What the chance law is fitted to, counted where the texts are: how often each word score occurs (whole hundredths, so a bounded
    number of rows), and each text's length and best segment (two numbers a text)."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            seen: dict[int, int] = {}
            best, length = [], []
            for t in batch.column("text").to_pylist():
                scores = shared.value.sequence(tokens(t))
                for s in scores:
                    at = round(s * 100)
                    seen[at] = seen.get(at, 0) + 1
                best.append(max([0.0, *(s for *_, s in maximal_segments(scores))]))
                length.append(max(1, len(scores)))
            scored = pa.array([[{"score": s, "n": n} for s, n in seen.items()]], pa.list_(pa.struct([("score", pa.int64()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([scored, pa.array([length], pa.list_(pa.int64())), pa.array([best], pa.list_(pa.float64()))], names=["seen", "length", "best"])

    counted = written(texts.select("text").mapInArrow(run, "seen array<struct<score: long, n: long>>, length array<long>, best array<double>"), "chance")
    seen = {r.score / 100: r.n for r in counted.select(F.explode("seen").alias("s")).groupBy("s.score").agg(F.sum("s.n").alias("n")).collect()}
    return seen, [(r.n, r.best) for r in counted.select(F.explode(F.arrays_zip(F.col("length").alias("n"), "best")).alias("t")).select("t.n", "t.best").collect()]


def extreme_values(model: Model, seen: dict[float, int], texts: list[tuple[int, float]]) -> None:
    """The chance law of clean texts: rate is the positive root of mean(exp(rate * score)) = 1 over their words (with one
    more word of the highest score), size the likeliest factor for the best segments that these texts have."""
    top = max([0.5, *model.scores.values()])
    seen = seen | {top: seen.get(top, 0) + 1}
    s, n = np.array(list(seen)), np.array(list(seen.values()), float)
    low, high = 0.0, 50.0
    for _ in range(60):
        rate = (low + high) / 2
        low, high = (rate, high) if (np.exp(np.minimum(rate * s, 700)) * n).sum() / n.sum() < 1 else (low, rate)
    model.rate = max(rate, 1e-2)
    # the best segment stays below s with probability exp(-size * length * exp(-rate * s))
    length, best = (np.array(x, float) for x in zip(*texts, strict=True)) if texts else (np.ones(1), np.zeros(1))
    model.size = float(1 / np.mean(length * np.exp(-model.rate * best)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows that aren't held out.

    Without labelled rows of both classes, in folds 1 to 3 and in fold 4, every score is 0. Of different texts under one id the first in order counts, of its labels the
    largest. Only counts, token scores and three numbers a text (of a bounded number of texts) reach the driver.
    """
    prepare(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id")) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > LEARN_ROWS:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * LEARN_ROWS / n))
    texts = written(keyed(docs).join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic"), "toxicity")

    def count(batches):
        totals: dict[tuple[str, int], int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in totals]), pa.array([t for _, t in totals], pa.int32()), pa.array(list(totals.values()), pa.int64())], names=["token", "toxic", "n"])

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for w in {f for w in set(tokens(text)) for f in forms(w)}:
                    totals[w, toxic] = totals.get((w, toxic), 0) + 1
            if len(totals) > 500_000:
                yield out()
                totals.clear()
        yield out()

    scoring, fitting = texts.where(fold(F.col("doc_id")) < 4), texts.where(fold(F.col("doc_id")) == 4)
    counted = scoring.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "token string, toxic int, n long").groupBy("token").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("toxic"), F.sum(F.when(F.col("toxic") == 0, F.col("n"))).alias("clean")).na.fill(0)
    # class totals over all tokens; the model keeps those whose frequencies differ most, a bounded number
    a, b = counted.agg(F.sum("toxic"), F.sum("clean")).first()
    if not a or not b:
        return Model({})
    differ = F.abs(F.col("toxic") / a - F.col("clean") / b) / F.sqrt((F.col("toxic") + F.col("clean") + 1) / (a + b))
    # a token whose log-odds lie well within the standard errors that will be taken off can't score: it stays with the rest
    t, c = F.col("toxic") + EACH, F.col("clean") + EACH
    telling = F.abs(F.log(t / (a - F.col("toxic") + EACH)) - F.log(c / (b - F.col("clean") + EACH))) > (SHRINK - 1) * F.sqrt(1 / t + 1 / c)
    top = counted.where(telling).orderBy(F.desc(differ), "token").limit(MODEL_TOKENS).toPandas()
    rest = pd.DataFrame({"token": [""], "toxic": [a - top.toxic.sum()], "clean": [b - top.clean.sum()]})
    model = Model(token_scores(pd.concat([top, rest], ignore_index=True)))
    model.scores.pop("", None)
    # the chance law from a bounded sample of clean rows
    harmless = scoring.where("toxic = 0")
    share = min(1.0, CHANCE_ROWS / max(1, harmless.count()))
    extreme_values(model, *chance_counts(model, harmless.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)))
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def featured(batches):
        for batch in batches:
            f = [shared.value.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), batch.column("toxic")], names=["f", "toxic"])

    rows = fitting.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(featured, "f array<double>, toxic int").toPandas()
    if rows.toxic.nunique() == 2:
        model.map = logistic(np.array(rows.f.tolist()).reshape(-1, FEATURES), rows.toxic.to_numpy(float))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    Empty and null texts have no segment and get the score of no evidence; repeated rows are each scored; a null doc_id
    isn't held out; other columns are not read.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            p = shared.value.probability(np.array([shared.value.features(t) for t in texts]).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    out = keyed(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, first_word, end_word, score, expected): every significant toxic passage."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            rows = [(d, *s) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for s in shared.value.segments(t) if s[3] < SIGNIFICANT]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", "first_word", "end_word", "score", "expected"]).astype({"doc_id": "Int64", "first_word": "int64", "end_word": "int64", "score": float, "expected": float}), preserve_index=False)

    return keyed(docs).mapInArrow(run, "doc_id long, first_word long, end_word long, score double, expected double")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of documents, all columns, whose score is under 0.5; null texts are scored as empty."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            p = shared.value.probability(np.array([shared.value.features(t) for t in texts]).reshape(-1, FEATURES))
            yield batch.filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model learnt from the labelled rows that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    return scored(docs, learn(docs, read(spark, sf_dir, "labels")))
