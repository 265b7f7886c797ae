"""Feature selection: prefilter, stability selection, mRMR, Boruta, and the record of a run."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions.matrix_sums import groups, matrix, summed
from tracelab.functions.ordering import row_numbers, seeded_hash
from tracelab.operators import logistic as lg
from tracelab.operators.curves import correlation_matrix
from tracelab.operators.detectors import Classifier, compact, fixed_split_evaluation
from tracelab.session import KEY, bounded, materialize


def rank_by(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Rank by value, highest first; for small tables such as one row per feature."""
    order = Window.partitionBy(*group).orderBy(F.desc(value))
    return rows.withColumn("rank", F.rank().over(order))


def feature_frequency(records: DataFrame) -> DataFrame:
    """Share of selection records that hold each feature."""
    total = records.agg(F.count(F.lit(1))).scalar()
    held = records.select(F.explode(F.array_distinct("selected")).alias("feature"))
    return held.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).select("feature", (F.col("n") / total).alias("frequency"))


def prefilter_drops(features: DataFrame, names: list[str], label: str = "label", threshold: float = 0.95, by: list[str] = ()) -> DataFrame:
    """(*by, dropped, kept, r) for each pair with |r| above the threshold.

    The feature less correlated with the label goes, the later one on a tie. No pair is skipped when
    one of its features is already dropped, so the outcome does not depend on the order of pairs. Features and label are
    columns of one matrix, of which correlations are read.
    """
    by = list(by)
    table = materialize(correlation_matrix(features, [*names, label], by).withColumn("r", F.abs("r")))
    strength = table.where(F.col("name_j") == label).select(*by, F.col("name_i").alias("feature"), F.col("r").alias("c"))
    left = strength.withColumnsRenamed({"feature": "name_i", "c": "c_i"})
    right = strength.withColumnsRenamed({"feature": "name_j", "c": "c_j"})
    pairs = table.where((F.col("r") > threshold) & (F.col("name_j") != label))
    keep_first = F.col("c_i") >= F.col("c_j")
    return pairs.join(left, [*by, "name_i"]).join(right, [*by, "name_j"]).select(
        *by,
        F.when(keep_first, F.col("name_j")).otherwise(F.col("name_i")).alias("dropped"),
        F.when(keep_first, F.col("name_i")).otherwise(F.col("name_j")).alias("kept"),
        "r",
    )


def correlation_prefilter(features: DataFrame, names: list[str], label: str = "label", threshold: float = 0.95):
    """By run: the names that survive, in order, and the drop records (at most one per pair of features)."""
    runs = [r[0] for r in features.select("run_id").distinct().orderBy("run_id").collect()]
    drops = prefilter_drops(features, names, label, threshold, ["run_id"]).collect()
    gone = {(d["run_id"], d["dropped"]) for d in drops}
    return {r: ([n for n in names if (r, n) not in gone], [d for d in drops if d["run_id"] == r]) for r in runs}


# ---------------------------------------------------------------- stability selection

# Rounds, share of rows, inclusion threshold, range of random weights, grid of C.
STABILITY_ROUNDS = 500
STABILITY_ROUNDS_INSIDE = 200
SHARE = 0.5
INCLUSION = 0.6
C_GRID = [10 ** (-2 + 2 * i / 9) for i in range(10)]


@dataclass
class Stability:
    selected: list[str]
    probability: dict[str, float]
    expected_false: float
    expected_false_mean: float


def stability_selection(
    features: DataFrame, names: list[str], rounds: int = STABILITY_ROUNDS, threshold: float = INCLUSION, seed: int = 42
) -> dict[str, Stability]:
    """By run: the share of rounds in which a randomly weighted L1 model keeps each feature.

    Every round draws a half of the rows, weights U(0.5, 1) and one C. A row is in the half of a round by a bit
    of its hash, so a round moves no row; the models of all rounds and runs are fitted together.
    ``expected_false`` bounds the false positives with the number of features ever kept,
    ``expected_false_mean`` with the mean number kept per round, as published. A round whose half has one class keeps nothing.
    """
    rows = compact(lg.with_arrays(features.select(*KEY, "label", *names), names, seed=seed))
    runs = [r[0] for r in rows.select("run_id").distinct().orderBy("run_id").collect()]
    scales = lg.scalings(rows, [(run, ()) for run in runs], len(names))
    rng = random.Random(seed)
    draws = [([rng.uniform(0.5, 1.0) for _ in names], rng.choice(C_GRID)) for _ in range(rounds)]
    specs = []
    for run in runs:
        _, center, spread = scales[run, ()]
        for no, (weights, c) in enumerate(draws):
            # A feature divided by its weight is a scaling by the product.
            specs.append(lg.Spec(run, 1.0 / c, True, center, tuple(s * w for s, w in zip(spread, weights)), half=no))
    kept = np.nan_to_num(lg.fit_all(rows, specs, len(names)))[:, 1:] != 0
    out = {}
    for i, run in enumerate(runs):
        own = kept[i * rounds : (i + 1) * rounds]
        counts = own.sum(axis=0).tolist()
        probability = {n: counts[j] / rounds for j, n in enumerate(names)}
        ever, mean = sum(c > 0 for c in counts), sum(counts) / max(rounds, 1)
        bound = lambda q: q * q / ((2 * threshold - 1) * len(names)) if threshold > 0.5 else math.inf
        out[run] = Stability([n for n in names if probability[n] > threshold], probability, bound(ever), bound(mean))
    return out


# ---------------------------------------------------------------- mutual information and mRMR

def binned(features: DataFrame, names: list[str], bins: int = 16, method: str = "quantile", by: list[str] = ()) -> DataFrame:
    """Feature columns as bin numbers: quantile bins, or equal widths over each feature's range, inside each group."""
    by = list(by)
    if method == "quantile":
        # Interior cuts of every feature and group, from one partial aggregate.
        shares = [k / bins for k in range(1, bins)]
        cuts = features.groupBy(*by).agg(*[F.array_distinct(F.percentile_approx(n, shares, 10_000)).alias(f"_cut_{n}") for n in names])
        place = lambda n: F.when(F.col(n).isNotNull(), F.size(F.filter(f"_cut_{n}", lambda c: c <= F.col(n))))
    else:
        cuts = features.groupBy(*by).agg(*[f(n).alias(f"_{t}_{n}") for n in names for f, t in ((F.min, "lo"), (F.max, "hi"))])

        def place(n: str) -> Column:
            lo, hi = F.col(f"_lo_{n}"), F.col(f"_hi_{n}")
            inside = F.least(F.lit(bins - 1), F.floor((F.col(n) - lo) / ((hi - lo) / bins)).cast("int"))
            return F.when(lo.isNull() | (lo == hi), F.lit(0)).otherwise(inside)

    if by:
        ready = features.join(bounded(cuts), by)
    else:
        found = cuts.first().asDict()
        ready = features.withColumns({c: F.lit(v) for c, v in found.items()})
    return ready.select(*[c for c in features.columns if c not in names], *[place(n).cast("int").alias(n) for n in names])


#: Width of the matrix of joint counts, columns times bins (72 MB).
WIDEST = 3000


def mutual_information(bins: DataFrame, names: list[str], by: list[str] = ()) -> DataFrame:
    """(*by, name_i, name_j, mi) in nats for every pair of columns of small bin numbers, from joint counts of one pass.

    A task counts all pairs at once, as the product of its rows' indicator matrix with itself; no row is copied per pair. A null
    is a bin of its own.
    """
    by = list(by)
    most = bins.agg(*[F.max(n).alias(n) for n in names]).first()
    size, width = 2 + max((v for v in most if v is not None), default=0), len(names)
    if size * width > WIDEST:
        raise ValueError(f"{width} columns of {size} bins make a matrix wider than {WIDEST}")
    plain = bins.select(*by, F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(float(size - 1))) for n in names]).alias("x"))

    def partial(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        x = matrix(batch.column("x"), width).astype(np.int64)
        for key, rows in groups(batch, by):
            own = x[rows]
            marks = np.zeros((len(own), width * size))
            marks[np.arange(len(own))[:, None], np.arange(width) * size + own] = 1.0
            yield key, (marks.T @ marks).ravel()

    types = {f.name: f.dataType.simpleString() for f in bins.schema.fields if f.name in by}
    total = summed(plain, {c: types[c] for c in by} or {"_all": "int"}, partial)
    cells = total.select(*by, F.posexplode("total").alias("_k", "n")).where("n > 0")
    row, column = F.floor(F.col("_k") / (size * width)), F.col("_k") % (size * width)
    cells = cells.withColumns({"i": F.floor(row / size).cast("int"), "j": F.floor(column / size).cast("int"), "x": row % size, "y": column % size}).where("i < j")
    labels = F.array(*[F.lit(n) for n in names])
    joint = cells.select(*by, F.get(labels, "i").alias("name_i"), F.get(labels, "j").alias("name_j"), "x", "y", "n")
    own = [*by, "name_i", "name_j"]
    placed = joint.withColumns({
        "nx": F.sum("n").over(Window.partitionBy(*own, "x")), "ny": F.sum("n").over(Window.partitionBy(*own, "y")), "t": F.sum("n").over(Window.partitionBy(*own)),
    })
    gain = F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))
    return placed.groupBy(*own).agg(F.sum(gain).alias("mi"))


def mrmr_selection(
    features: DataFrame, names: list[str], n_select: int = 10, bins: int = 16, method: str = "quantile"
) -> dict[str, tuple[list[str], dict[str, float]]]:
    """By run: the features chosen greedily by relevance to the label less mean redundancy with those chosen so far, and their scores.

    Mutual information is estimated from bins of the run; only the small matrix of pairs reaches the driver.
    """
    runs = [r[0] for r in features.select("run_id").distinct().orderBy("run_id").collect()]
    cut = binned(features.select("run_id", "label", *names), names, bins, method, ["run_id"])
    mi = {(r["run_id"], frozenset((r["name_i"], r["name_j"]))): r["mi"] for r in mutual_information(cut, [*names, "label"], ["run_id"]).collect()}
    return {run: _greedy({pair: v for (r, pair), v in mi.items() if r == run}, names, n_select) for run in runs}


def _greedy(mi: dict[frozenset, float], names: list[str], n_select: int) -> tuple[list[str], dict[str, float]]:
    chosen: list[str] = []
    scores: dict[str, float] = {}
    while len(chosen) < min(n_select, len(names)):
        rest = [n for n in names if n not in scores]
        value = lambda n: mi[frozenset((n, "label"))] - (
            sum(mi[frozenset((n, s))] for s in chosen) / len(chosen) if chosen else 0.0
        )
        best = max(rest, key=lambda n: (value(n), -names.index(n)))
        scores[best] = value(best)
        chosen.append(best)
    return chosen, scores


def positive_or_first(chosen: list[str], scores: dict[str, float], fallback: int = 3) -> list[str]:
    """Features with a positive score, else the first three."""
    return [n for n in chosen if scores[n] > 0] or chosen[:fallback]


def select_on(features: DataFrame, names: list[str], method: str = "stability", rounds: int = STABILITY_ROUNDS_INSIDE) -> dict[str, list[str]]:
    """Selection by run for use inside an evaluation; an empty selection means all features."""
    if method == "stability":
        chosen = {r: s.selected for r, s in stability_selection(features, names, rounds).items()}
    elif method == "mrmr":
        chosen = {r: positive_or_first(*found) for r, found in mrmr_selection(features, names).items()}
    else:
        raise ValueError(f"unknown selection method {method!r}")
    return {r: c or names for r, c in chosen.items()}


# ---------------------------------------------------------------- Boruta

BORUTA_ROUNDS = 100


def shadows(features: DataFrame, names: list[str], seed: int) -> DataFrame:
    """Rows with ``_no`` 1.. and, next to each feature, an independently permuted copy ``shadow_*``.

    A feature is permuted by giving its values to the rows in the order of a seeded hash, ranked by
    the bucketed row numbering; no column is gathered in one task.
    """
    numbered = row_numbers(features.withColumn("_h", seeded_hash(seed, *KEY)), [], "_h", KEY, name="_no", hashed=True).drop("_h")
    long = numbered.select("_no", *names).unpivot("_no", names, "feature", "value")
    long = long.withColumn("_h", F.xxhash64("_no", "feature", F.lit(seed)))
    moved = row_numbers(long, ["feature"], "_h", ["_no"], name="_to", hashed=True)
    copies = moved.groupBy(F.col("_to").alias("_no")).pivot("feature", names).agg(F.first("value"))
    return numbered.join(copies.select("_no", *[F.col(n).alias(f"shadow_{n}") for n in names]), "_no")


def binomial_tail(hits: int, n: int) -> float:
    """P(X >= hits) for n fair coin tosses."""
    return sum(math.comb(n, k) for k in range(hits, n + 1)) / 2**n


def boruta_selection(
    features: DataFrame, names: list[str], rounds: int = BORUTA_ROUNDS, alpha: float = 0.05, seed: int = 42, trees: int = 100
) -> dict:
    """Features whose forest importance beats the best shadow more often than chance allows."""
    rows = materialize(features.select(*KEY, "label", *names))
    hits, status = {n: 0 for n in names}, {n: "tentative" for n in names}
    level = alpha / len(names)
    for no in range(1, rounds + 1):
        both = shadows(rows, names, seed + no)
        wide = [*names, *[f"shadow_{n}" for n in names]]
        ready = compact(VectorAssembler(inputCols=wide, outputCol="x").transform(both).select("label", "x"))
        model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=5, seed=seed + no).fit(ready)
        importance = model.featureImportances.toArray()
        bar = max(importance[len(names):])
        for j, n in enumerate(names):
            if status[n] != "tentative":
                continue
            hits[n] += int(importance[j] > bar)
            if binomial_tail(hits[n], no) < level:
                status[n] = "confirmed"
            elif 1 - binomial_tail(hits[n] + 1, no) < level:
                status[n] = "rejected"
        if all(s != "tentative" for s in status.values()):
            break
    by = lambda s: [n for n in names if status[n] == s]
    return {"confirmed": by("confirmed"), "tentative": by("tentative"), "rejected": by("rejected"), "hits": hits}


# ---------------------------------------------------------------- pipeline

def selection_record(
    features: DataFrame, names: list[str], classifiers: dict[str, Classifier], rounds: int = STABILITY_ROUNDS,
    boruta_rounds: int = BORUTA_ROUNDS, rounds_inside: int = STABILITY_ROUNDS_INSIDE, trees: int = 100,
) -> dict[str, dict]:
    """By run: prefilter, the three selectors, and evaluations with selection on the train part, as one record."""
    features = materialize(features)
    records = {}
    for run, (kept, drops) in correlation_prefilter(features, names).items():
        own = features.where(F.col("run_id") == run).select(*KEY, "label", "split", *kept)
        stable, (chosen, scores) = stability_selection(own, kept, rounds)[run], mrmr_selection(own, kept)[run]
        evaluation = {}
        for method in ("stability", "mrmr", "all_features"):
            pick = None if method == "all_features" else (lambda f, n, m=method: select_on(f, n, m, rounds_inside))
            report, used = fixed_split_evaluation(own, kept, classifiers, pick)
            evaluation[method] = {"selected": used[run], "classifiers": [r.asDict() for r in report.collect()]}
        records[run] = {
            "prefilter": {"dropped": [d.asDict() for d in drops], "remaining": kept},
            "stability": {"selected": stable.selected, "probabilities": stable.probability, "expected_fp": stable.expected_false},
            "mrmr": {"selected": positive_or_first(chosen, scores), "scores": scores},
            "boruta": boruta_selection(own, kept, boruta_rounds, trees=trees),
            "evaluation": evaluation,
        }
    return records
