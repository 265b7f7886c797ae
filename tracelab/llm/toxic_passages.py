"""Toxic passages as maximum-scoring segments of a text.

Every token has a score: its log-odds between toxic and clean training text under a Dirichlet prior
from both, where a likelihood-ratio test tells the two apart, and a small penalty otherwise. One linear scan (Ruzzo and
Tompa) finds all maximal segments, the passages that no extension and no cut improves. For random
clean text the best of many segments follows an extreme-value law: about K n exp(-lambda S)
segments with score S or more are expected in n tokens. lambda and K are fitted to clean training text; passages
whose expectation is at most ``expected`` are significant. The evidence of a document, the sum of
lambda S - ln(K n) over them, becomes a probability by a logistic fit on the training labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracelab.llm.importance import label_sample
from tracelab.llm.store import Scratch, in_batches, tidy, with_columns
from tracelab.llm.word_hash import hashed_words, text_slices

TOKEN_COUNTS = "token bigint, toxic bigint, clean bigint"
SCORES = "doc_id bigint, score double, evidence double, passages array<struct<start:bigint,end:bigint,score:double,expected:double>>"


@dataclass(frozen=True)
class Toxicity:
    """Most labelled documents the model is fitted to (a bounded sample, by a hash of the id), prior
    weight, signed root of the likelihood ratio that gives a token a score of its own, penalty of other tokens, largest
    absolute score of a token, expected chance passages that make one significant, seed."""

    sample: int = 20_000
    prior: float = 500.0
    z: float = 6.0
    penalty: float = 0.25
    most: float = 8.0
    expected: float = 0.01
    seed: int = 5


@dataclass(frozen=True)
class Model:
    """Sorted token hashes with their scores, the penalty of others, the extreme-value constants, the
    logistic fit of the label on the evidence."""

    tokens: np.ndarray
    scores: np.ndarray
    penalty: float
    rate: float
    factor: float
    expected: float
    intercept: float = -4.0
    slope: float = 1.0

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        """Of the label; the fit is on ln(1 + evidence), as evidence grows with the number of passages."""
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * np.log1p(evidence), -500, 500)))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def maximal_segments(starts: np.ndarray, scores: np.ndarray, penalty: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [from, to) of a sequence in which only the listed positions have
    a score of their own and every other one costs ``penalty``; one pass, amortised linear."""
    held: list[list[float]] = []  # from, to, sum before, sum after
    total, position = 0.0, 0
    for at, score in zip(starts.tolist(), scores.tolist()):
        total -= penalty * (at - position)
        position = at + 1
        if score <= 0:
            total += score
            continue
        segment = [at, at + 1, total, total + score]
        total += score
        while True:
            before = len(held) - 1
            while before >= 0 and held[before][2] >= segment[2]:
                before -= 1
            if before < 0 or held[before][3] >= segment[3]:
                held.append(segment)
                break
            segment = [held[before][0], segment[1], held[before][2], segment[3]]
            del held[before:]
    return [(int(a), int(b), after - base) for a, b, base, after in held]


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, toxic, clean): documents of each class that hold a token, for (text, label) rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            hashes, offsets, _, _ = hashed_words(batch.column("text"), tokens=True)
            texts = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            toxic = (batch.column("label").to_numpy(zero_copy_only=False) == 1)[texts]
            tokens, at = np.unique(hashes, return_inverse=True)
            yield pa.record_batch({
                "token": pa.array(tokens.view(np.int64)),
                "toxic": pa.array(np.bincount(at[toxic], minlength=len(tokens)).astype(np.int64)),
                "clean": pa.array(np.bincount(at[~toxic], minlength=len(tokens)).astype(np.int64)),
            })

    counted = in_batches(docs.select("text", "label")).mapInArrow(tidy(count), TOKEN_COUNTS)
    return counted.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def token_scores(counts: DataFrame, setting: Toxicity) -> DataFrame:
    """(token, toxic, clean, score) of the tokens whose likelihood ratio reaches ``z`` squared."""
    toxic_n, clean_n = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    toxic_n, clean_n = toxic_n or 0, clean_n or 0
    if not toxic_n or not clean_n:  # nothing to tell apart
        return counts.select("token", "toxic", "clean", F.lit(0.0).alias("score")).limit(0)
    prior = F.lit(setting.prior) * (F.col("toxic") + F.col("clean")) / F.lit(float(max(1, toxic_n + clean_n)))
    one, two = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(one / (F.lit(toxic_n + setting.prior) - one)) - F.log(two / (F.lit(clean_n + setting.prior) - two))
    share = F.lit(toxic_n / max(1, toxic_n + clean_n)) * (F.col("toxic") + F.col("clean"))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    ratio = 2 * (part(F.col("toxic"), share) + part(F.col("clean"), F.col("toxic") + F.col("clean") - share))
    scored = counts.withColumns({"odds": odds, "ratio": ratio}).where(F.col("ratio") >= F.lit(setting.z**2))
    clipped = F.greatest(F.least(F.col("odds"), F.lit(setting.most)), F.lit(-setting.most)) - setting.penalty
    return scored.select("token", "toxic", "clean", clipped.alias("score"))


def extreme_rate(scores: np.ndarray, frequency: np.ndarray, penalty: float) -> float:
    """lambda > 0 with E[exp(lambda * score)] = 1 for the token frequencies of clean text."""
    rest = max(1e-9, 1 - frequency.sum())

    def excess(rate: float) -> float:
        return float((frequency * np.exp(rate * scores)).sum() + rest * math.exp(-rate * penalty)) - 1

    if not len(scores) or scores.max() <= 0:
        return 1.0
    low, high = 0.0, 1e-3
    while excess(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(high, 1e-3)


def passages(texts: pa.Array, model: Model) -> list[tuple[int, list[tuple[int, int, float, float]]]]:
    """Per text, its number of tokens and (start byte, end byte, score, expected number) of each maximal segment."""
    hashes, offsets, starts, ends = hashed_words(texts, tokens=True)
    bases = np.concatenate([[0], np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))])
    tokens = hashes.view(np.int64)
    if len(model.tokens):
        place = np.minimum(np.searchsorted(model.tokens, tokens), len(model.tokens) - 1)
        at = np.flatnonzero(model.tokens[place] == tokens)
    else:
        at = place = np.zeros(0, dtype=np.int64)
    cuts = np.searchsorted(at, offsets)
    out = []
    for i in range(len(offsets) - 1):
        n, own, found = int(offsets[i + 1] - offsets[i]), at[cuts[i] : cuts[i + 1]], []
        if len(own):
            for a, b, score in maximal_segments(own - offsets[i], model.scores[place[own]], model.penalty):
                chance = model.factor * n * math.exp(-min(700.0, model.rate * score))
                found.append((int(starts[offsets[i] + a] - bases[i]), int(ends[offsets[i] + b - 1] - bases[i]), score, chance))
        out.append((n, found))
    return out


def evidence(found: list[tuple[int, int, float, float]], expected: float) -> float:
    return float(sum(-math.log(max(chance, 1e-300)) for _, _, _, chance in found if chance <= expected))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Intercept and slope of a logistic fit with a small penalty on the slope (Newton steps)."""
    scale = max(1e-9, float(np.abs(x).max(initial=0)))
    design, beta = np.column_stack([np.ones(len(x)), x / scale]), np.zeros(2)
    penalty = np.diag([1e-6, ridge]) * max(1, len(x))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - penalty @ beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1] / scale)


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", setting: Toxicity = Toxicity()) -> Model:
    """A model from the labelled documents, of which at most ``setting.sample`` are used; that bounds its tokens too.

    Labels without a document, null labels and documents with a null id are left out, null texts are empty, equal texts count
    once, and a repeated id brings in all its texts. Without documents of both classes nothing is scored, and
    all documents have the same score. Further columns of both tables are ignored.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = label_sample(labels, column, setting.sample, setting.seed)
    # The sample has a proven bound, so it is broadcast, and its texts are written once.
    found = with_columns(docs, doc_id="bigint", text="string").join(F.broadcast(sample), "doc_id")
    # Copies of one text are one piece of evidence.
    single = found.groupBy(F.xxhash64("text")).agg(F.min(F.struct("doc_id", "label", "text")).alias("row")).select("row.*")
    rows = scratch.save(single, "train")
    counts = scratch.save(count_tokens(rows), "counts")
    scored = token_scores(counts, setting).toArrow()
    tokens, clean = scored.column("token").to_numpy(), scored.column("clean").to_numpy()
    order = np.argsort(tokens)
    tokens, clean, scores = tokens[order], clean[order], scored.column("score").to_numpy()[order]
    clean_n = counts.agg(F.sum("clean")).first()[0] or 0
    rate = extreme_rate(scores, (clean + 0.5) / (clean_n + 1.0), setting.penalty)
    model = Model(tokens, scores, setting.penalty, rate, 1.0, setting.expected)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = passages(batch.column("text"), shared.value)
            yield pa.record_batch({
                "label": batch.column("label"),
                "n": pa.array([n for n, _ in found], pa.int64()),
                "scores": pa.array([[s for _, _, s, _ in own] for _, own in found], pa.list_(pa.float64())),
            })

    # One small row per training document, of which there are at most ``setting.sample`` (and their repeats).
    seen = in_batches(rows.select("label", "text")).mapInArrow(tidy(best), "label int, n bigint, scores array<double>").toArrow().to_pylist()
    own = [r for r in seen if r["label"] != 1]
    least = min((s for r in own for s in r["scores"]), default=0.0)
    chance = sum(r["n"] for r in own) * math.exp(-rate * least)
    factor = (0.5 + sum(len(r["scores"]) for r in own)) / (0.5 + chance)
    x = np.array([evidence([(0, 0, s, factor * r["n"] * math.exp(-min(700.0, rate * s))) for s in r["scores"]], setting.expected) for r in seen])
    y = np.array([float(r["label"] == 1) for r in seen])
    intercept, slope = logistic(np.log1p(x), y) if 0 < y.sum() < len(y) else (-4.0, 1.0)
    scratch.drop("train", "counts")
    return Model(tokens, scores, setting.penalty, rate, factor, setting.expected, intercept, max(slope, 0.0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: (doc_id, score, evidence, passages).

    ``score`` is the probability of the toxic label; ``passages`` are the significant ones, as byte
    ranges with their score and expected number. A null or empty text has no passage and the score
    of no evidence. Null and repeated ids and repeated rows are scored like any other; an empty table gives an
    empty result; further columns are ignored. The model holds at most ``Toxicity.tokens`` tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in text_slices(batches):
            found = [segments for _, segments in passages(batch.column("text"), own)]
            amount = np.array([evidence(segments, own.expected) for segments in found])
            significant = [[dict(zip(("start", "end", "score", "expected"), s)) for s in segments if s[3] <= own.expected] for segments in found]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "score": pa.array(own.probability(amount)), "evidence": pa.array(amount),
                "passages": pa.array(significant, kind),
            })

    return in_batches(with_columns(docs, doc_id="bigint", text="string")).mapInArrow(tidy(rows), SCORES)


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``_toxicity``, the score (which replaces a column of this name).

    Every row has a score, whatever its id: null and empty texts that of a text without passages, long texts that of the
    whole text, repeated rows the same. An empty table stays empty; other columns are passed on, whatever they are called.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("_toxicity")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_slices(batches):
            amount = np.array([evidence(found, own.expected) for _, found in passages(batch.column("text"), own)])
            yield batch.append_column("_toxicity", pa.array(own.probability(amount), pa.float64()))

    return in_batches(docs).mapInArrow(tidy(rows), StructType([*docs.schema.fields, StructField("_toxicity", DoubleType())]))
