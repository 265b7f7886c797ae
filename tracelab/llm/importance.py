"""Quality filter by importance resampling.

Two generative models over hashed n-grams (tokens and pairs of tokens, in ``2**bits`` buckets): one of the target,
counted over labelled good documents, one of the raw text, counted over all documents and scaled to
the size of the target. Both have the same pseudo-counts, so that rare n-grams say little. The log
importance weight of a document is the sum of log(p_target / p_raw) over its n-grams. Adding a
Gumbel draw to each weight and keeping the k largest keys draws k documents without replacement in proportion to
their weights. k is the number of documents whose weight reaches the threshold that best separates
good from bad labelled documents that the target model has not seen, so that rejected text is about
what the labels call bad.

A pair of equal tokens counts as one n-gram whatever the token: repetition is the same evidence for every word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracelab.llm.store import Scratch, in_batches, tidy, with_columns
from tracelab.llm.word_hash import hashed_words, shingles, text_slices

COUNTS = "kind int, bucket int, n bigint"
WEIGHTS = "doc_id bigint, good int, log_weight double"
REPEAT = np.uint64(0x5DEECE66D5DEECE6)


@dataclass(frozen=True)
class Resampling:
    """``bits`` of the hash space, pseudo-count of a bucket, most labelled documents that are used (a
    bounded sample, by a hash of the id; one in three sets the threshold), and the seed."""

    bits: int = 18
    smoothing: float = 20.0
    sample: int = 20_000
    seed: int = 11


def label_sample(labels: DataFrame, column: str, size: int, seed: int) -> DataFrame:
    """(doc_id, label): one row per labelled document, the ``size`` smallest hashes of the id."""
    rows = with_columns(labels.withColumnRenamed(column, "label") if column != "label" else labels, doc_id="bigint", label="int")
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(size)


def _buckets(texts: pa.Array, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    hashes, offsets, _, _ = hashed_words(texts, tokens=True)
    pairs, pair_offsets = shingles(hashes, offsets, 2)
    shift = np.uint64(64 - bits)
    counts, pair_counts = np.diff(offsets), np.diff(pair_offsets)
    first = np.repeat(offsets[:-1], pair_counts) + np.arange(len(pairs)) - np.repeat(pair_offsets[:-1], pair_counts)
    second = np.minimum(first + 1, max(0, len(hashes) - 1))
    same = (hashes[first] == hashes[second]) & np.repeat(counts > 1, pair_counts)
    pairs = np.where(same, REPEAT, pairs)
    return [((hashes >> shift).astype(np.int64), offsets), ((pairs >> shift).astype(np.int64), pair_offsets)]


def count_ngrams(docs: DataFrame, bits: int) -> DataFrame:
    """(kind, bucket, n): hashed n-gram counts of all rows (kind 0) and of the ``target`` rows (kind 1).

    Counts are summed per task before they are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << bits), dtype=np.int64)
        for batch in text_slices(batches):
            good = batch.column("target").to_numpy(zero_copy_only=False)
            for buckets, offsets in _buckets(batch.column("text"), bits):
                totals[0] += np.bincount(buckets, minlength=1 << bits)
                if good.any():
                    totals[1] += np.bincount(buckets[np.repeat(good, np.diff(offsets))], minlength=1 << bits)
        for kind in (0, 1):
            used = np.flatnonzero(totals[kind])
            yield pa.record_batch({"kind": pa.array(np.full(len(used), kind, dtype=np.int32)), "bucket": pa.array(used.astype(np.int32)), "n": pa.array(totals[kind][used])})

    return in_batches(docs.select("text", "target")).mapInArrow(tidy(count), COUNTS).groupBy("kind", "bucket").agg(F.sum("n").alias("n"))


def log_ratios(counts: DataFrame, bits: int, smoothing: float) -> np.ndarray:
    """log(p_target / p_raw) by bucket; at most ``2 * 2**bits`` rows reach the driver."""
    table = counts.toArrow()
    both = np.zeros((2, 1 << bits))
    both[table.column("kind").to_numpy(), table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    expected = both[0] * (both[1].sum() / max(1.0, both[0].sum()))
    return np.log((both[1] + smoothing) / (expected + smoothing))


def log_weights(texts: pa.Array, ratios: np.ndarray, bits: int) -> np.ndarray:
    total = np.zeros(len(texts))
    for buckets, offsets in _buckets(texts, bits):
        of = np.repeat(np.arange(len(texts)), np.diff(offsets))
        total += np.bincount(of, weights=ratios[buckets], minlength=len(texts))
    return total


def weigh(docs: DataFrame, ratios: np.ndarray, bits: int) -> DataFrame:
    """(doc_id, good, log_weight) of every row; an empty text has weight 0."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            weights = log_weights(batch.column("text"), shared.value, bits)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "good": batch.column("good"), "log_weight": pa.array(weights)})

    return in_batches(docs.select("doc_id", "good", "text")).mapInArrow(tidy(rows), WEIGHTS)


def best_threshold(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight that keeps most good and fewest bad documents; the middle of the best gap."""
    if not good.any() or good.all():
        return -math.inf
    values, at = np.unique(weights, return_inverse=True)
    kept_good = np.cumsum(np.bincount(at, weights=good)[::-1])[::-1] / good.sum()
    kept_bad = np.cumsum(np.bincount(at, weights=~good)[::-1])[::-1] / (~good).sum()
    best = int(np.argmax(kept_good - kept_bad))  # the lowest of equals
    return float(values[best] if best == 0 else (values[best] + values[best - 1]) / 2)


def gumbel(seed: int, doc_id: Column) -> Column:
    """A standard Gumbel draw from a hash of seed and id, the same in every run."""
    text = F.concat(F.lit(f"{seed}/"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    uniform = (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    return -F.log(-F.log(uniform))


def kth_largest(rows: DataFrame, key: str, k: int, bins: int = 1024, most: int = 20_000) -> float:
    """The k-th largest value of a column: histograms narrow its range, then ``most`` rows are sorted."""
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if k <= 0 or not n:
        return math.inf
    if k >= n:
        return low
    above = 0  # rows larger than the range
    while low < high:
        inside = rows.where(F.col(key).between(low, high))
        place = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(high - low) * F.lit(bins)), F.lit(bins - 1))
        parts = inside.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        for part in sorted(parts.collect(), key=lambda r: -r["bin"]):
            if above + part["n"] >= k:
                break
            above += part["n"]
        low, high = part["low"], part["high"]
        if part["n"] <= most:
            last = rows.where(F.col(key).between(low, high)).orderBy(F.desc(key)).limit(k - above).agg(F.min(key))
            return last.first()[0]
    return low


@dataclass(frozen=True)
class Fitted:
    """What a sampled corpus leaves behind: log ratios by bucket, the last key that is kept, the seed."""

    ratios: np.ndarray
    cutoff: float
    setting: Resampling


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", keep: float | None = None, setting: Resampling = Resampling()) -> Fitted:
    """Both models over ``docs`` and the last key of the k documents that are kept."""
    scratch = Scratch(docs.sparkSession, "importance")
    # The sample has at most ``setting.sample`` rows of two integers: a proven bound for a broadcast.
    sample = scratch.save(label_sample(labels, column, setting.sample, setting.seed), "sample")
    rows = with_columns(docs, doc_id="bigint", text="string").join(F.broadcast(sample), "doc_id", "left").withColumnRenamed("label", "good")
    unseen = F.pmod(F.xxhash64("doc_id", F.lit(setting.seed + 1)), F.lit(3)) == 0
    target = F.coalesce((F.col("good") == 1) & ~unseen, F.lit(False))
    ratios = log_ratios(count_ngrams(rows.withColumn("target", target), setting.bits), setting.bits, setting.smoothing)
    weights = scratch.save(weigh(rows, ratios, setting.bits), "weights")
    known = weights.where(F.col("good").isNotNull() & unseen).groupBy("doc_id").agg(F.max("good").alias("good"), F.min("log_weight").alias("w")).toArrow()
    threshold = best_threshold(known.column("w").to_numpy(), known.column("good").to_numpy() == 1)
    total, reach = weights.agg(F.count(F.lit(1)), F.count_if(F.col("log_weight") >= F.lit(threshold))).first()
    keyed = weights.select((F.col("log_weight") + gumbel(setting.seed, F.col("doc_id"))).alias("key"))
    cutoff = kth_largest(keyed, "key", reach if keep is None else round(keep * total))
    scratch.drop("sample", "weights")
    return Fitted(ratios, cutoff, setting)


def with_keys(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """All columns of ``docs`` and ``_log_weight``, ``_key`` and ``_kept`` (which replace columns of these names)."""
    shared, bits = docs.sparkSession.sparkContext.broadcast(fitted.ratios), fitted.setting.bits
    docs = docs.drop("_log_weight", "_key", "_kept")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield batch.append_column("_log_weight", pa.array(log_weights(batch.column("text"), shared.value, bits)))

    weighed = in_batches(docs).mapInArrow(tidy(rows), StructType([*docs.schema.fields, StructField("_log_weight", DoubleType())]))
    keyed = weighed.withColumn("_key", F.col("_log_weight") + gumbel(fitted.setting.seed, F.col("doc_id").cast("bigint")))
    return keyed.withColumn("_kept", F.col("_key") >= F.lit(fitted.cutoff))


def resample(docs: DataFrame, labels: DataFrame, column: str = "quality", keep: float | None = None, setting: Resampling = Resampling()) -> DataFrame:
    """One row per document: (doc_id, log_weight, key, kept).

    ``labels`` has (doc_id, ``column``) with 1 for good and 0 for bad; ``keep`` is the share of
    documents to keep, by default that of weights above the fitted threshold. Ties at the last key are all kept;
    repeated rows share their draw. A null or empty text has weight 0. Null ids share one draw and have
    no label. Without labels of both kinds everything is kept; an empty table gives an empty
    result; further columns are ignored.
    """
    keyed = with_keys(with_columns(docs, doc_id="bigint", text="string"), fit(docs, labels, column, keep, setting))
    return keyed.select("doc_id", F.col("_log_weight").alias("log_weight"), F.col("_key").alias("key"), F.col("_kept").alias("kept"))
