"""Supervised detectors: grid search, scoring, nested and cross-dataset evaluation, one model per run.

Logistic models of all runs, folds and settings are fitted together (``logistic.fit_all``); forests and boosted trees run in
MLlib, run by run, side by side from driver threads. The feature table is written once and every pass reads
it back; only model coefficients and metric numbers reach the driver.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from statistics import fmean

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Transformer
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.operators import features as ft
from tracelab.operators import lexical as lx
from tracelab.operators import logistic as lg
from tracelab.operators import semantic as sm
from tracelab.operators.labels import stratified_folds
from tracelab.operators.metrics import confusion, detector_report, feature_auc
from tracelab.session import KEY, materialize, written

# Grids of the three classifiers, folds, decision threshold, seed.
INVERSE_PENALTIES = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]
LOGISTIC_GRID = [{"C": c, "penalty": p} for c in INVERSE_PENALTIES for p in ("l1", "l2")]
# Unlimited depth is taken as 30, the deepest tree MLlib grows.
FOREST_GRID = [{"n_estimators": n, "max_depth": d} for n in (100, 300) for d in (3, 5, 10, 30)]
BOOSTED_GRID = [{"n_estimators": n, "max_depth": d, "learning_rate": r} for n in (100, 300) for d in (3, 5) for r in (0.01, 0.1)]
FOLDS = 5
THRESHOLD = 0.5
SEED = 42
ROWS_PER_PARTITION = 20_000
SIDE_BY_SIDE = 8


def forest(params: dict, n: int, features: str = "scaled") -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol=features, labelCol="label", numTrees=params["n_estimators"], maxDepth=params["max_depth"], seed=SEED
    )


def boosted(params: dict, n: int, features: str = "scaled") -> GBTClassifier:
    return GBTClassifier(
        featuresCol=features, labelCol="label", maxIter=params["n_estimators"], maxDepth=params["max_depth"],
        stepSize=params["learning_rate"], seed=SEED,
    )


@dataclass
class Classifier:
    """A grid and the MLlib estimator of a setting; without one, logistic models fitted together."""

    build: Callable | None
    grid: list[dict]


CLASSIFIERS = {
    "LR": Classifier(None, LOGISTIC_GRID),
    "RF": Classifier(forest, FOREST_GRID),
    "GBT": Classifier(boosted, BOOSTED_GRID),
}


@dataclass
class Fitted:
    scaler: Transformer
    model: Model
    names: list[str]
    params: dict
    cv_auc: float
    extra: dict = field(default_factory=dict)

    def score(self, rows: DataFrame) -> DataFrame:
        """``score``: probability of label 1 for rows with the ``raw`` vector."""
        out = self.model.transform(self.scaler.transform(rows))
        return out.withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score").drop("raw")


def assemble(features: DataFrame, names: list[str]) -> DataFrame:
    """Feature columns as one ``raw`` vector, written once, in partitions of a sensible size."""
    rest = [c for c in features.columns if c not in ft.STATIC + ft.NO_PADDING + ft.DYNAMIC and c not in names]
    vectors = VectorAssembler(inputCols=names, outputCol="raw", handleInvalid="error").transform(features).select(*rest, "raw")
    return compact(vectors)


def compact(rows: DataFrame) -> DataFrame:
    kept = materialize(rows)
    wanted = max(1, math.ceil(kept.count() / ROWS_PER_PARTITION))
    return kept.coalesce(wanted) if wanted < kept.rdd.getNumPartitions() else kept


def in_parallel(tasks: list[Callable], width: int = SIDE_BY_SIDE) -> list:
    """Run driver-side tasks, each of which submits Spark jobs, in a few threads."""
    inherit = inheritable_thread_target(SparkSession.getActiveSession())
    with ThreadPool(width) as pool:
        return pool.map(lambda task: task(), [inherit(t) for t in tasks])


def auc_of(scored: DataFrame) -> float:
    return BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="label", numBins=0).evaluate(scored)


def scale(train: DataFrame):
    return StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(train)


def grid_search(train: DataFrame, names: list[str], classifier: Classifier, folds: int = FOLDS, grid: list[dict] | None = None) -> Fitted:
    """Best setting by mean AUC over stratified folds (first one on ties), fitted again on all rows.

    ``train`` has run_id, sample_id, label and ``raw``; the scaler is fitted inside each fold.
    """
    grid = grid or classifier.grid
    folded = compact(stratified_folds(train, folds, ["label"], KEY, SEED))

    def prepare(f: int):
        fit_part, held = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
        scaler = scale(fit_part)
        ready = scaler.transform(fit_part).persist()
        return ready, scaler.transform(held).persist(), ready.count()

    parts = in_parallel([lambda f=f: prepare(f) for f in range(folds)])

    def one(params: dict, part) -> float:
        ready, held, n = part
        return auc_of(classifier.build(params, n).fit(ready).transform(held))

    scores = in_parallel([lambda p=p, part=part: one(p, part) for p in grid for part in parts])
    for ready, held, _ in parts:
        ready.unpersist()
        held.unpersist()
    means = [fmean(scores[i * folds : (i + 1) * folds]) for i in range(len(grid))]
    best = max(range(len(grid)), key=lambda i: (means[i], -i))
    scaler = scale(train)
    model = classifier.build(grid[best], train.count()).fit(scaler.transform(train))
    return Fitted(scaler, model, names, grid[best], means[best])


@dataclass
class RunModel:
    """The logistic model of one run: weights of features as they are, its setting and mean AUC over the folds."""

    intercept: float
    weights: list[float]
    params: dict
    cv_auc: float | None


@dataclass
class RunFits:
    """One model per run, by run."""

    names: list[str]
    models: dict[str, RunModel]

    def coefficients(self, run: str) -> dict[str, float]:
        return dict(zip(self.names, self.models[run].weights))

    def table(self, spark: SparkSession) -> DataFrame:
        """(run_id, _intercept, _weights, best_params, cv_roc_auc), one row per run."""
        rows = [
            (r, m.intercept, m.weights, ", ".join(f"{k}={v}" for k, v in m.params.items()), m.cv_auc) for r, m in sorted(self.models.items())
        ]
        return spark.createDataFrame(rows, "run_id string, _intercept double, _weights array<double>, best_params string, cv_roc_auc double")

    def score(self, rows: DataFrame, run: str = "run_id") -> DataFrame:
        """``score``: probability of label 1 by the model of the run that ``run`` names; rows of other runs are left out."""
        known = self.table(rows.sparkSession).select(F.col("run_id").alias(run), "_intercept", "_weights")
        values = F.array(*[F.col(n).cast("double") for n in self.names])
        total = F.aggregate(F.zip_with(values, F.col("_weights"), lambda x, w: x * w), F.col("_intercept"), lambda s, x: s + x)
        # One row per model, and the models came from the driver.
        scored = rows.join(F.broadcast(known), run).withColumn("score", 1 / (1 + F.exp(-total)))
        return scored.drop("_intercept", "_weights")


def logistic_search(train: DataFrame, names: list[str], grid: list[dict] | None = None, folds: int = FOLDS) -> RunFits:
    """Per run, the setting with the best mean AUC over stratified folds (first one on ties), fitted on all its rows.

    ``train`` has run_id, sample_id, label and the feature columns. All runs, folds and settings are fitted
    together; the scaling of a model sees the rows of its folds only. Runs with one class have no model.
    """
    grid = grid or LOGISTIC_GRID
    folded = stratified_folds(train.select(*KEY, "label", *names), folds, ["run_id", "label"], KEY, SEED)
    rows = compact(lg.with_arrays(folded, names, ["fold"]))
    runs = [r[0] for r in rows.select("run_id").distinct().orderBy("run_id").collect()]
    masks = [(run, without) for run in runs for without in [(), *[((0, f),) for f in range(folds)]]]
    scales = lg.scalings(rows, masks, len(names), 1)
    specs, settings = [], []
    for run, without in masks:
        n, center, spread = scales.get((run, without), (0, (), ()))
        if n:
            for k, setting in enumerate(grid):
                specs.append(lg.Spec(run, 1.0 / setting["C"], setting["penalty"] == "l1", center, spread, without))
                settings.append(k)
    weights = lg.fit_all(rows, specs, len(names), 1)
    held = lg.held_out(rows, specs, settings, weights, len(names))
    by = ["run_id", "fold", "setting"]
    aucs: dict[tuple[str, int], list[float]] = {}
    for r in feature_auc(held, by).collect():
        if r["auc"] is not None:
            aucs.setdefault((r["run_id"], r["setting"]), []).append(r["auc"])
    models = {}
    for i, (spec, k) in enumerate(zip(specs, settings)):
        mean = fmean(aucs[spec.run, k]) if (spec.run, k) in aucs else None
        if spec.without or math.isnan(weights[i][0]):
            continue
        before = models.get(spec.run)
        if before is None or (mean is not None and (before.cv_auc is None or mean > before.cv_auc)):
            models[spec.run] = RunModel(*lg.raw_weights(weights[i], spec), grid[k], mean)
    return RunFits(names, models)


def report_of(scored: DataFrame, fits: DataFrame, name: str) -> DataFrame:
    """Metrics of scored test rows with the best setting of their model; one row per run.

    ``fits`` has run_id, best_params and cv_roc_auc.
    """
    scored = scored.withColumn("score_name", F.lit(name))
    at_half = confusion(scored, THRESHOLD).withColumnRenamed("accuracy", "accuracy_at_half")
    report = detector_report(scored, bounds=(0.0, 1.0)).join(at_half, ["run_id", "score_name"])
    return report.join(F.broadcast(fits.select("run_id", "best_params", "cv_roc_auc")), "run_id")


def supervised_detector(features: DataFrame, names: list[str], name: str, grid: list[dict] | None = None):
    """Fit each run on its train split, report on its test split, score every row: (fits, report, scored rows).

    ``features`` has run_id, sample_id, label, split and the feature columns.
    """
    rows = materialize(features)
    fits = logistic_search(rows.where("split = 'train'"), names, grid)
    scored = fits.score(rows).drop(*names)
    return fits, report_of(scored.where("split = 'test'"), fits.table(rows.sparkSession), name), scored


def feature_sets(known: list[str]) -> dict[str, list[str]]:
    """The four feature sets of the benchmark, cut to the known features."""
    sets = {"baseline": ft.STATIC, "markov": ft.DYNAMIC, "baseline_markov": ft.STATIC + ft.DYNAMIC, "cleaned": ft.CLEANED}
    return {k: [n for n in v if n in known] for k, v in sets.items()}


def four_models(features: DataFrame, grid: list[dict] | None = None) -> DataFrame:
    """Reports of the four feature sets, by run."""
    known = ft.feature_columns(features)
    out = None
    for name, names in feature_sets(known).items():
        report = supervised_detector(features.select(*KEY, "label", "split", *names), names, name, grid)[1]
        out = report if out is None else out.unionByName(report)
    return out


def cross_dataset(features: DataFrame, pairs: list[tuple[str, str]], names: list[str], grid: list[dict] | None = None) -> DataFrame:
    """Train on all of one run, test on all of another, for each (train run, test run).

    All train runs are fitted together; the rows of a test run are scored once per train run that names it.
    """
    rows = materialize(features)
    spark = rows.sparkSession
    fits = logistic_search(rows.where(F.col("run_id").isin(sorted({a for a, _ in pairs}))), names, grid)
    wanted = spark.createDataFrame(sorted(set(pairs)), "train_run string, run_id string")
    scored = fits.score(rows.join(F.broadcast(wanted), "run_id"), "train_run").drop(*names)
    # A report is by run: a pair stands in for one.
    pair = scored.withColumns({"test_run": F.col("run_id"), "run_id": F.concat_ws("\t", "train_run", "run_id")})
    known = wanted.join(fits.table(spark).withColumnRenamed("run_id", "train_run"), "train_run")
    known = known.withColumn("run_id", F.concat_ws("\t", "train_run", "run_id"))
    report = report_of(pair, known, "cross")
    parts = F.split("run_id", "\t")
    return report.withColumns({"train_run": parts[0], "test_run": parts[1]}).drop("run_id")


#: Picks features from training rows: names by run.
Selector = Callable[[DataFrame, list[str]], dict[str, list[str]]]


def evaluate(
    train: DataFrame, test: DataFrame, names: list[str], classifiers: dict[str, Classifier], select: Selector | None = None, folds: int = FOLDS
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Every classifier fitted on the train rows of each run and reported on its test rows; the features of each run.

    ``select`` sees train rows only. Runs with the same features are fitted together.
    """
    train, test = materialize(train), materialize(test)
    spark = train.sparkSession
    runs = [r[0] for r in train.select("run_id").distinct().orderBy("run_id").collect()]
    chosen = select(train, names) if select else {r: names for r in runs}
    reports: list[DataFrame] = []
    for own in sorted({tuple(chosen[r]) for r in runs}):
        group, columns = [r for r in runs if tuple(chosen[r]) == own], list(own)
        here = lambda rows: rows.where(F.col("run_id").isin(group)).select(*KEY, "label", *columns)
        for name, classifier in classifiers.items():
            if classifier.build is None:
                fits = logistic_search(here(train), columns, classifier.grid, folds)
                reports.append(report_of(fits.score(here(test)), fits.table(spark), name))
                continue

            def one(run: str, classifier: Classifier = classifier, columns: list[str] = columns) -> DataFrame:
                mine = lambda rows: assemble(rows.where(F.col("run_id") == run).select(*KEY, "label", *columns), columns)
                fitted = grid_search(mine(train), columns, classifier, folds)
                setting = ", ".join(f"{k}={v}" for k, v in fitted.params.items())
                table = spark.createDataFrame([(run, setting, float(fitted.cv_auc))], "run_id string, best_params string, cv_roc_auc double")
                return report_of(fitted.score(mine(test)), table, name)

            reports.extend(one(run) for run in group)
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out, chosen


def fixed_split_evaluation(
    features: DataFrame, names: list[str], classifiers: dict[str, Classifier], select: Selector | None = None
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Every classifier on the train/test split of each run; ``select`` picks the features on the train part only."""
    own = features.select(*KEY, "label", "split", *names)
    return evaluate(own.where("split = 'train'").drop("split"), own.where("split = 'test'").drop("split"), names, classifiers, select)


def nested_evaluation(
    features: DataFrame, names: list[str], classifiers: dict[str, Classifier], outer: int = FOLDS, inner: int = FOLDS,
    select: Selector | None = None,
) -> tuple[DataFrame, dict[tuple[str, int], list[str]]]:
    """Nested cross-validation per run: mean and population deviation of AUC and average precision, (run_id, classifier, ...).

    The rows outside an outer fold are a training set of their own, so that all outer folds of all runs are fitted
    together. With ``select`` the features are picked anew on the training part of every outer fold.
    """
    folded = materialize(stratified_folds(features.select(*KEY, "label", *names), outer, ["run_id", "label"], KEY, SEED))
    part = lambda fold: F.concat_ws("\t", "run_id", fold)
    outside = folded.withColumn("_outer", F.explode(F.array(*[F.lit(f) for f in range(outer)]))).where("_outer <> fold")
    train = outside.withColumn("run_id", part(F.col("_outer"))).drop("_outer", "fold")
    test = folded.withColumn("run_id", part(F.col("fold"))).drop("fold")
    report, chosen = evaluate(train, test, names, classifiers, select, inner)
    summary = [f(c).alias(f"{n}_{t}") for c, n in (("roc_auc", "auroc"), ("pr_auc", "auprc")) for f, t in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    summary = report.withColumn("run_id", F.split("run_id", "\t")[0]).groupBy("run_id", F.col("score_name").alias("classifier")).agg(*summary)
    return summary, {(k.rsplit("\t", 1)[0], int(k.rsplit("\t", 1)[1])): v for k, v in chosen.items()}


# ---------------------------------------------------------------- registry

@dataclass
class Inputs:
    """What detectors read: trace cells, answer variants, and the labelled pool (run_id, sample_id, label, split)."""

    cells: DataFrame | None = None
    variants: DataFrame | None = None
    pool: DataFrame | None = None


@dataclass
class Detector:
    """A plug-in detector: inputs to one row per sample with its score columns."""

    run: Callable[[Inputs], DataFrame]
    title: str
    columns: list[str]


REGISTRY: dict[str, Detector] = {}


def register(name: str, title: str, columns: list[str]):
    def add(fn):
        REGISTRY[name] = Detector(fn, title, columns)
        return fn

    return add


@register("perplexity", "Perplexity", ["perplexity"])
def _perplexity(inputs: Inputs) -> DataFrame:
    return ft.unmask_perplexity(inputs.cells)


@register("ln_entropy", "LN-Entropy", ["ln_entropy"])
def _ln_entropy(inputs: Inputs) -> DataFrame:
    steps = ft.step_stats(inputs.cells)
    return ft.static_from_steps(steps).select(*KEY, F.col("MeanEntropyJustUnmasked").alias("ln_entropy"))


@register("lexical_similarity", "Lexical similarity", ["lexical_similarity"])
def _lexical_similarity(inputs: Inputs) -> DataFrame:
    rows = lx.lexical_features(inputs.variants).join(inputs.pool.select(*KEY, "label", "split"), KEY)
    return supervised_detector(rows, lx.FEATURES, "lexical_similarity")[2].select(*KEY, F.col("score").alias("lexical_similarity"))


@register("semantic_entropy", "Semantic entropy", ["semantic_entropy"])
def _semantic_entropy(inputs: Inputs) -> DataFrame:
    return sm.semantic_entropy(sm.cluster_variants(inputs.variants))


@register("trace_features", "Trace features", ["trace_features"])
def _trace_features(inputs: Inputs) -> DataFrame:
    rows = materialize(ft.trace_features(inputs.cells).join(inputs.pool.select(*KEY, "label", "split"), KEY))
    kept = ft.drop_nan_columns(rows, ft.feature_columns(rows))[0]
    return supervised_detector(kept, ft.feature_columns(kept), "trace_features")[2].select(*KEY, F.col("score").alias("trace_features"))


SCORED = "run_id STRING, sample_id BIGINT, score_name STRING, score DOUBLE"


def _scores(name: str, inputs: Inputs) -> DataFrame:
    detector = REGISTRY[name]
    values = [F.col(c).cast("double").alias(c) for c in detector.columns]
    return detector.run(inputs).select(*KEY, *values).unpivot(KEY, detector.columns, "score_name", "score")


def run_detectors(names: list[str], inputs: Inputs) -> DataFrame:
    """(run_id, sample_id, score_name, score) of the named detectors; one that fails fails the job."""
    out = None
    for name in names:
        scores = _scores(name, inputs)
        out = scores if out is None else out.unionByName(scores)
    return out


def run_isolated(names: list[str], inputs: Inputs, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Scores of the detectors that succeed, and (detector, score_name, seconds, error), one row per score column of every detector.

    Each detector is a job of its own, whose scores are written before the next one starts: an error ends
    this detector only, and is kept with the time it took.
    """
    out, log = spark.createDataFrame([], SCORED), []
    for name in names:
        start, error = time.monotonic(), None
        try:
            out = out.unionByName(written(_scores(name, inputs).select(F.col("run_id").cast("string").alias("run_id"), F.col("sample_id").cast("bigint").alias("sample_id"), "score_name", "score")))
        except Exception as e:  # noqa: BLE001 - whatever a plug-in raises is its result
            error = f"{type(e).__name__}: {str(e)[:500]}"
        seconds = time.monotonic() - start
        log += [(name, column, seconds, error) for column in (REGISTRY[name].columns if name in REGISTRY else [name])]
    return out, spark.createDataFrame(log, "detector STRING, score_name STRING, seconds DOUBLE, error STRING")
