import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelab.operators import curves as cv, detectors as dt, logistic as lg, selection as sl
from tracelab.session import KEY

NAMES = ["MeanEntropy", "VarEntropy", "MeanLogProb", "VarLogProb"]
GRID = [{"C": c, "penalty": p} for c in (0.01, 1.0) for p in ("l1", "l2")]
LR = {"LR": dt.Classifier(None, GRID[-1:])}


@pytest.fixture(scope="module")
def features(spark):
    """Two informative features (the second a near copy of the first) and two that are noise."""
    rng = random.Random(7)
    rows = []
    for i in range(240):
        label = rng.random() < 0.5
        x = rng.gauss(1.5 if label else 0.0, 1.0)
        rows.append(("r", i, int(label), "train" if i < 192 else "test", x, x + rng.gauss(0, 0.01), rng.gauss(0, 1), rng.gauss(0, 1)))
    schema = "run_id STRING, sample_id BIGINT, label INT, split STRING, " + ", ".join(f"{n} DOUBLE" for n in NAMES)
    return spark.createDataFrame(rows, schema)


def test_detector_scores_every_row(features):
    fitted, report, scored = dt.supervised_detector(features, NAMES, "baseline", GRID[:2])
    assert scored.count() == 240 and scored.where("score < 0 OR score > 1").count() == 0
    row = report.first()
    assert row["n_samples"] == 48 and row["roc_auc"] > 0.7 and row["tp"] + row["fp"] + row["tn"] + row["fn"] == 48
    assert 0 <= fitted.models["r"].cv_auc <= 1 and set(fitted.coefficients("r")) == set(NAMES)


def test_scaler_and_model_see_train_rows_only(features):
    """Moving the test rows far away changes neither the setting nor the coefficients."""
    moved = features.withColumns({n: F.when(F.col("split") == "test", F.col(n) * 1000 + 5).otherwise(F.col(n)) for n in NAMES})
    a, b = (dt.supervised_detector(f, NAMES, "x", GRID[:2])[0] for f in (features, moved))
    assert a.models["r"].params == b.models["r"].params and a.coefficients("r") == pytest.approx(b.coefficients("r"))


def test_runs_do_not_see_each_other(features):
    """Changing one run leaves the models of the other as they are; runs with one class have none."""
    other = features.withColumn("run_id", F.lit("s")).withColumn("MeanEntropy", -F.col("MeanEntropy"))
    single = features.withColumns({"run_id": F.lit("t"), "label": F.lit(1)})
    changed = other.withColumns({n: F.col(n) * 3 + F.col("sample_id") % 5 for n in NAMES})
    a, b = (dt.supervised_detector(features.unionByName(o).unionByName(single), NAMES, "x", GRID)[0] for o in (other, changed))
    assert set(a.models) == {"r", "s"}
    assert a.models["r"].params == b.models["r"].params and a.coefficients("r") == pytest.approx(b.coefficients("r"))
    assert a.coefficients("s") != pytest.approx(b.coefficients("s"))


@pytest.mark.parametrize("penalty, c", [("l2", 0.5), ("l1", 0.05), ("l1", 1.0), ("l2", 100.0)])
def test_weights_minimise_the_objective(features, penalty, c):
    """No small change of any weight lowers the summed loss and penalty."""
    rows = lg.with_arrays(features.withColumn("fold", F.col("sample_id") % 3), NAMES, ["fold"])
    masks = [("r", ()), ("r", ((0, 1),))]
    scales = lg.scalings(rows, masks, 4, 1)
    specs = [lg.Spec("r", 1 / c, penalty == "l1", *scales[m][1:], m[1]) for m in masks]
    fitted = lg.fit_all(rows, specs, 4, 1)
    table = rows.select("sample_id", "label", "x").toPandas()
    for spec, weights in zip(specs, fitted):
        own = table if not spec.without else table[table.sample_id % 3 != 1]
        x, y = np.array(own.x.tolist()), own.label.to_numpy()
        assert np.allclose(spec.center, x.mean(axis=0)) and np.allclose(spec.spread, x.std(axis=0, ddof=1))
        z = lg.design(x, spec)

        def objective(w):
            size = np.abs(w[1:]).sum() if penalty == "l1" else 0.5 * (w[1:] ** 2).sum()
            return np.logaddexp(0, z @ w).sum() - (y * (z @ w)).sum() + size / c

        least = objective(weights)
        for j in range(5):
            for step in (1e-3, -1e-3, 1e-5, -1e-5):
                assert objective(weights + step * np.eye(5)[j]) >= least - 1e-7
        if (penalty, c) == ("l1", 0.05):
            assert (weights[1:] == 0).any()


def test_halves_of_rounds(features):
    hashes = np.array([r[0] for r in features.select(F.xxhash64("sample_id")).collect()])
    halves = np.array([lg.in_half(hashes, r) for r in range(200)])
    assert 0.47 < halves.mean() < 0.53 and abs(np.corrcoef(halves[0], halves[1])[0, 1]) < 0.2
    assert np.abs(halves.mean(axis=0) - 0.5).max() < 0.2

def test_selection_inside_evaluation_sees_train_rows_only(features):
    seen = []

    def select(rows, names):
        seen.append({r["run_id"]: r["n"] for r in rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("sample_id").alias("last")).collect()})
        return {r: names[i % 2 : 2] for i, r in enumerate(sorted(seen[-1]))}

    report, chosen = dt.fixed_split_evaluation(features, NAMES, LR, select)
    assert chosen == {"r": NAMES[:2]} and seen == [{"r": 192}] and report.first()["n_samples"] == 48
    seen.clear()
    summary, picked = dt.nested_evaluation(features, NAMES, LR, outer=3, inner=2, select=select)
    assert len(seen) == 1 and sum(seen[0].values()) == 480 and all(156 <= n <= 164 for n in seen[0].values())
    assert picked == {("r", 0): NAMES[:2], ("r", 1): NAMES[1:2], ("r", 2): NAMES[:2]}
    record = summary.first()
    assert 0.5 < record["auroc_mean"] <= 1 and record["auroc_std"] >= 0 and (record["run_id"], record["classifier"]) == ("r", "LR")


def test_prefilter_keeps_one_of_two_copies(features):
    kept, drops = sl.correlation_prefilter(features, NAMES)["r"]
    assert len(drops) == 1 and {drops[0]["dropped"], drops[0]["kept"]} == {"MeanEntropy", "VarEntropy"}
    assert [n for n in NAMES if n != drops[0]["dropped"]] == kept


def test_stability_prefers_signal(features):
    found = sl.stability_selection(features, ["MeanEntropy", "MeanLogProb"], rounds=60)["r"]
    assert found.probability["MeanEntropy"] > found.probability["MeanLogProb"]
    assert found.selected == [n for n, p in found.probability.items() if p > 0.6]
    assert found.expected_false_mean <= found.expected_false


def test_mutual_information_and_mrmr(features):
    chosen, scores = sl.mrmr_selection(features, NAMES, n_select=4)["r"]
    assert chosen[0] in ("MeanEntropy", "VarEntropy") and chosen[1] not in ("MeanEntropy", "VarEntropy")
    assert sl.positive_or_first(["a", "b"], {"a": 1.0, "b": -1.0}) == ["a"]
    assert sl.positive_or_first(["a", "b", "c", "d"], dict.fromkeys("abcd", -1.0)) == ["a", "b", "c"]


def test_boruta_and_its_coin_test(features):
    assert sl.binomial_tail(0, 5) == 1 and sl.binomial_tail(5, 5) == pytest.approx(1 / 32)
    shadow = sl.shadows(features, NAMES, 3)
    assert shadow.count() == 240
    for n in NAMES:
        a, b = (sorted(r[0] for r in shadow.select(c).collect()) for c in (n, f"shadow_{n}"))
        assert a == b
    found = sl.boruta_selection(features, NAMES, rounds=2, trees=10)
    assert sorted(found["confirmed"] + found["tentative"] + found["rejected"]) == sorted(NAMES)


def test_cross_dataset_reports_each_pair(features):
    both = features.withColumn("run_id", F.when(F.col("sample_id") % 2 == 0, "a").otherwise("b")).drop("split")
    report = dt.cross_dataset(both, [("a", "a"), ("a", "b"), ("b", "a")], NAMES, GRID[:1])
    assert sorted((r["train_run"], r["test_run"], r["n_samples"]) for r in report.collect()) == [("a", "a", 120), ("a", "b", 120), ("b", "a", 120)]


def test_detectors_run_as_isolated_jobs(spark, sf_dir, monkeypatch):
    from tracelab.operators import metrics as mt, score_tables as st
    from tracelab.plans import fixtures as fx
    from tracelab.plans.score_queries import sample_pool

    names = ["perplexity", "ln_entropy", "lexical_similarity", "semantic_entropy", "trace_features"]
    assert set(dt.REGISTRY) >= set(names) and KEY
    monkeypatch.setattr(dt, "LOGISTIC_GRID", GRID[:1])
    broken = dt.Detector(lambda inputs: inputs.cells.select(*KEY, F.raise_error(F.lit("no such model")).alias("ln_entropy")), "LN-Entropy", ["ln_entropy"])
    monkeypatch.setitem(dt.REGISTRY, "ln_entropy", broken)
    pool = sample_pool(spark, sf_dir).select(*KEY, "label", "split")
    inputs = dt.Inputs(fx.cells(spark, sf_dir), fx.variants(spark, sf_dir), pool)
    scores, log = dt.run_isolated(names, inputs, spark)
    results = mt.ranking_metrics(scores.join(pool.select(*KEY, "label"), KEY)).select(*mt.GROUP, "roc_auc")
    report = st.consolidated_report(results, pool.where(F.col("run_id") == fx.RUN_A), names, log).collect()
    assert sorted(r["score_name"] for r in report) == sorted(names) and all(r["seconds"] > 0 for r in report)
    for r in report:
        assert (r["error"] is not None and "no such model" in r["error"] and r["roc_auc"] is None and r["failed"]) == (r["score_name"] == "ln_entropy")


def test_pair_statistics_copy_no_rows(features):
    """Correlations and joint counts explode sums only: the plan moves one array per task and group."""
    holes = features.withColumn("VarEntropy", F.when(F.col("sample_id") % 7 > 0, F.col("VarEntropy"))).withColumn("MeanLogProb", F.lit(0.1))
    table = holes.toPandas()
    got = {(r["name_i"], r["name_j"]): r["r"] for r in cv.correlation_matrix(holes, NAMES).collect()}
    for i, a in enumerate(NAMES):
        for b in NAMES[i + 1 :]:
            want = table[[a, b]].dropna().corr().iloc[0, 1]
            assert got[a, b] is None if np.isnan(want) else got[a, b] == pytest.approx(want, abs=1e-9)
    by_label = cv.correlation_matrix(holes, NAMES, ["label"])
    assert by_label.count() == 12
    for plan in (cv.correlation_matrix(features, NAMES), sl.mutual_information(sl.binned(features, NAMES, 4, "width"), NAMES)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Generate ") == 1 and text.index("Generate ") < text.rindex("Aggregate ") < text.index("MapInArrow")
