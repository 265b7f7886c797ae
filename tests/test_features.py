import math

import numpy as np
import pytest
import traces
from pyspark.sql import functions as F

from tracelab.operators import ar1, cells as cl, features as ft
from tracelab.session import KEY
from tracelab.sources import trace


def by_sample(df):
    return {r["sample_id"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("steps,width,seed", [(8, 8, 1), (16, 5, 2), (12, 12, 3), (3, 4, 4)])
def test_features_equal_numpy(spark, steps, width, seed):
    samples = traces.random_samples(20, steps, width, seed)
    found = by_sample(ft.trace_features(traces.cells_of(spark, samples)))
    for i, s in enumerate(samples):
        for name, value in traces.expected(s).items():
            if value is None:
                assert found[i][name] is None, (i, name)
            else:
                assert found[i][name] == pytest.approx(value, rel=1e-9, abs=1e-12), (i, name)


def test_features_do_not_depend_on_partitions(spark):
    rows = traces.rows_of(spark, traces.random_samples(30, 8, 8, 5))
    one, many = (
        {r[:2]: r for r in map(tuple, ft.trace_features(trace.explode_trace(rows.repartition(n), pad_id=0)).collect())} for n in (1, 7)
    )
    assert one.keys() == many.keys()
    for key, row in one.items():
        assert row[2:] == pytest.approx(many[key][2:], nan_ok=True)


def test_window_and_array_flags_agree(spark):
    samples = traces.random_samples(10, 6, 5, 6)
    for post in (False, True):
        rows = traces.rows_of(spark, samples, post_commit=post)
        by_array = trace.explode_trace(rows, pad_id=0, with_lag=True)
        plain = by_array.select(*KEY, "step", "pos", *traces.CHANNELS).withColumn("post_commit", F.lit(post))
        by_window = cl.lag_entropy(trace.with_history(plain, pad_id=0))
        columns = [*KEY, "step", "pos", "masked_in", "just_unmasked", "just_unmasked_in", "padding", "entropy_before", "n_steps"]
        assert sorted(map(str, by_array.select(columns).collect())) == sorted(map(str, by_window.select(columns).collect()))


# Two samples, four steps, three positions; in the first, position 1 is never masked, position 2
# is never revealed and proposes the pad id throughout.
HAND = {
    "entropy": [[4.0, 1.0, 2.0], [3.0, 1.0, 4.0], [2.0, 1.0, 6.0], [1.0, 1.0, 8.0]],
    "prob": [[0.5, 0.5, 0.25], [0.5, 0.5, 0.25], [0.5, 0.5, 0.25], [0.5, 0.5, 0.25]],
    "x0_id": [[5, 0, 0], [5, 0, 0], [6, 0, 0], [6, 0, 0]],
    "masked": [[1, 0, 1], [1, 0, 1], [0, 0, 1], [0, 0, 1]],
}


def test_hand_worked_sample(spark):
    got = by_sample(ft.trace_features(traces.cells_of(spark, [HAND])))[0]
    assert got["MeanEntropy"] == pytest.approx(34 / 12)
    assert got["MeanMaskedEntropy"] == pytest.approx((4 + 2 + 3 + 4 + 6 + 8) / 6)
    # just unmasked: position 0 at step 2, position 2 at the last step
    assert got["MeanEntropyJustUnmasked"] == pytest.approx((2 + 8) / 2)
    # the first of them is left out, one value remains
    assert got["VarEntropyJustUnmasked"] == pytest.approx(0.0)
    # V(t) exists at steps 0 and 1 only
    assert got["MaxVarMaskedEntropyCurve"] == pytest.approx(1.0) and got["ArgmaxVarMaskedEntropyCurve"] == 0
    assert got["AUCVarMaskedEntropyCurve"] == pytest.approx((1.0 + 0.25) / 2)
    # position 2 is padding, position 1 was never masked and is not
    assert got["MeanMaskedEntropyNoPad"] == pytest.approx((4 + 3) / 2)


def test_post_commit_mask_shifts_one_step(spark):
    cells = traces.cells_of(spark, [HAND], post_commit=True).where("pos = 0").orderBy("step").collect()
    assert [r["masked"] for r in cells] == [True, True, False, False]
    assert [r["masked_in"] for r in cells] == [True, True, True, False]
    assert [r["just_unmasked"] for r in cells] == [False, False, True, False]
    assert [r["just_unmasked_in"] for r in cells] == [False, False, False, True]


def test_ragged_window(spark):
    rows = traces.rows_of(spark, [HAND]).withColumns({
        "start_idx": F.lit(1), "max_new_tokens": F.lit(4),
        "entropy": F.transform("entropy", lambda s: F.slice(s, 1, 2)),
    })
    cut = trace.window_rows(rows, traces.CHANNELS, pad_id=9).first()
    assert cut["entropy"][0] == [1.0, 0.0, 0.0, 0.0]
    assert cut["masked"][0] == [False, True, True, True] and cut["x0_id"][0] == [0, 0, 9, 9]
    assert trace.crop_or_zero(rows, "entropy").first()["entropy"][2] == [0.0] * 4


def with_prob(changes):
    s = {k: [list(r) for r in v] for k, v in HAND.items()}
    for t, d in changes:
        s["prob"][t][d] = 0.0
    return s


def test_perplexity_rules(spark):
    none = {**HAND, "masked": [[0] * 3] * 4}
    samples = [HAND, with_prob([(0, 1)]), with_prob([(2, 0)]), with_prob([(0, 1), (2, 0)]), none]
    cells = traces.cells_of(spark, samples)
    plain = {i: r["perplexity"] for i, r in by_sample(ft.unmask_perplexity(cells)).items()}
    strict = {i: r["perplexity"] for i, r in by_sample(ft.unmask_perplexity(cells, strict=True)).items()}
    value = math.exp(-(math.log(0.5) + math.log(0.25)) / 2)
    assert plain[0] == pytest.approx(value) and plain[1] == pytest.approx(value)
    assert plain[2] is None and plain[3] is None and plain[4] is None
    assert strict[0] == pytest.approx(value) and strict[1] is None
    assert strict[2] == math.inf and strict[3] is None and strict[4] is None


def test_constant_curve_and_no_curve(spark):
    flat = {**HAND, "entropy": [[1.0, 2.0, 3.0]] * 4, "masked": [[1, 1, 1]] * 4}
    bare = {**HAND, "masked": [[1, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0]]}
    got = by_sample(ft.trace_features(traces.cells_of(spark, [flat, bare])))
    assert got[0]["SkewnessVarMaskedEntropyCurve"] is None and got[0]["KurtosisVarMaskedEntropyCurve"] is None
    assert got[0]["MeanCurvatureMaskedEntropyCurve"] == 0.0 and got[0]["AlphaEntropy"] == pytest.approx(0.0)
    assert got[1]["MaxVarMaskedEntropyCurve"] is None and got[1]["ArgmaxVarMaskedEntropyCurve"] is None
    assert got[1]["AUCVarMaskedEntropyCurve"] == 0.0 and got[1]["VarEntropyJustUnmasked"] is None


def test_top_tokens_and_parametric_fit(spark):
    t = np.arange(10.0)
    tau, c, m = 3.0, 0.8, 9 / 2  # nine positive points
    y = c * t * np.exp(-(t - m) / tau)
    s = {"entropy": np.stack([y, y / 100], axis=1), "prob": np.ones((10, 2)) / 2, "x0_id": np.ones((10, 2)), "masked": np.ones((10, 2))}
    cells = traces.cells_of(spark, [s])
    assert [r["pos"] for r in ft.top_tokens(cells, 1).collect()] == [0]
    got = ft.curve_fits(ft.mean_curve(cells, 1)).first()
    assert (got["C_fit"], got["Tau_fit"], got["M_fit"]) == pytest.approx((c, tau, m))


def test_mean_of_token_fits_equals_fit_of_mean(spark):
    cells = traces.cells_of(spark, traces.random_samples(6, 9, 7, 8))
    fits, tokens = by_sample(ft.log_fits(ft.step_stats(cells))), by_sample(ft.token_fits(cells))
    for i in fits:
        assert fits[i]["AlphaEntropy"] == pytest.approx(tokens[i]["mean_a_e"]) and fits[i]["BetaLogProb"] == pytest.approx(tokens[i]["mean_b_p"])


def test_ar1_against_numpy_and_guards(spark):
    samples = traces.random_samples(12, 5, 3, 9)
    got = {(r["step"], r["pos"]): r for r in ar1.ar1_fit(traces.cells_of(spark, samples)).collect()}
    e = np.array([s["entropy"] for s in samples])
    for t in range(1, 5):
        for d in range(3):
            a, b = slope_of(e[:, t - 1, d], e[:, t, d])
            row = got[t, d]
            assert (row["phi"], row["intercept"]) == pytest.approx((a, b))
            assert row["sigma"] == pytest.approx(np.std(e[:, t, d] - a * e[:, t - 1, d] - b))
    assert got[0, 0]["phi"] == 0.0 and got[0, 0]["sigma"] == 0.0
    few = traces.cells_of(spark, [{**s, "x0_id": np.ones((5, 3))} for s in samples[:3]])
    assert {r["phi"] for r in ar1.ar1_fit(few, no_padding=True).collect()} == {0.0}
    flat = traces.cells_of(spark, [{**s, "entropy": np.full((5, 3), 0.1 * (i + 1)) * 0 + 1.0} for i, s in enumerate(samples)])
    plain = ar1.ar1_fit(flat).where("step > 0").first()
    assert plain["phi"] is None
    assert ar1.ar1_fit(flat, zero_if_constant=True).where("step > 0").first()["phi"] == 0.0


def slope_of(x, y):
    a = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    return a, y.mean() - a * x.mean()


def test_perfect_line_has_no_residual(spark):
    samples = [{"entropy": [[1.0 * i], [2.0 * i + 1]], "prob": [[0.5]] * 2, "x0_id": [[1]] * 2, "masked": [[1]] * 2} for i in range(5)]
    row = ar1.ar1_fit(traces.cells_of(spark, samples)).where("step = 1").first()
    assert (row["phi"], row["intercept"], row["sigma"]) == pytest.approx((2.0, 1.0, 0.0), abs=1e-9)


def test_feature_job_shuffles_only_stored_rows(spark, tmp_path):
    """On a bucketed table no exchange of cells at all; else one of the compact rows per pass."""
    rows = traces.rows_of(spark, traces.random_samples(20, 6, 4, 10))
    spark.sql("DROP TABLE IF EXISTS trace_rows_test")
    rows.write.bucketBy(4, *KEY).sortBy(*KEY).option("path", str(tmp_path / "t")).saveAsTable("trace_rows_test")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        stored = spark.table("trace_rows_test")
        plan = ft.static_from_steps(ft.step_stats(trace.explode_trace(stored, pad_id=0, colocate=False)))
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        shuffled = ft.static_from_steps(ft.step_stats(trace.explode_trace(rows, pad_id=0)))
        assert shuffled._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sql("DROP TABLE trace_rows_test")
