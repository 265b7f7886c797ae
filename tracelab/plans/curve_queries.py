"""Queries for AR(1) models, population curves, fits, histograms and correlations (D34-D50, C6, C7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.operators import ar1, cells as cl, curves as cv, features as ft
from tracelab.plans import fixtures as fx
from tracelab.plans.feature_queries import BYSTEP, all_features_sql
from tracelab.plans.registry import query
from tracelab.session import KEY
from tracelab.sources import trace

AR1 = """
lagged AS (SELECT *, lag(entropy) OVER (PARTITION BY run_id, sample_id, pos ORDER BY step) AS before, (cls >= 5)::INT AS label FROM flags)
"""


def _fit_sql(by="", where="true", zero="false"):
    group = f"{by}, " if by else ""
    return (
        f"SELECT {group}step, pos, CASE WHEN step = 0 OR {zero} THEN 0 ELSE regr_slope(entropy, before) END AS phi, "
        f"CASE WHEN step = 0 OR {zero} THEN 0 ELSE regr_intercept(entropy, before) END AS intercept, "
        f"CASE WHEN step = 0 OR {zero} THEN 0 ELSE sqrt(greatest(regr_syy(entropy, before) / regr_count(entropy, before) * (1 - regr_r2(entropy, before)), 0)) END AS sigma, "
        f"count(before) AS n FROM lagged WHERE {where} GROUP BY {group}step, pos"
    )


def lagged(spark, sf_dir, pad=True):
    cells = trace.explode_trace(fx.trace_rows(spark, sf_dir), keep=("cls",), pad_id=fx.PAD_ID if pad else None, with_lag=True)
    return cells.withColumn("label", (F.col("cls") >= 5).cast("int"))


@query("d34_ar1_fit", fx.with_cells(_fit_sql(), AR1), "phi intercept sigma")
def ar1_fit(spark, sf_dir):
    return ar1.ar1_fit(lagged(spark, sf_dir, pad=False))


@query("d35_ar1_fit_no_padding", fx.with_cells(_fit_sql(where="NOT padding", zero="count(before) <= 3"), AR1), "phi intercept sigma")
def ar1_fit_no_padding(spark, sf_dir):
    return ar1.ar1_fit(lagged(spark, sf_dir), no_padding=True)


@query("d36_ar1_class_fits", fx.with_cells(_fit_sql("label"), AR1), "phi intercept sigma")
def ar1_class_fits(spark, sf_dir):
    return ar1.ar1_fit(lagged(spark, sf_dir, pad=False), ["label"])


@query("d39_ar1_global_fit", fx.with_cells(_fit_sql("label", zero="stddev_pop(before) < 1e-12"), AR1), "phi intercept sigma")
def ar1_global_fit(spark, sf_dir):
    return ar1.ar1_fit(lagged(spark, sf_dir, pad=False), ["label"], zero_if_constant=True)


PRED = AR1 + """,
fits AS (SELECT step, pos, regr_slope(entropy, before) FILTER (WHERE label = 0) AS pc, regr_intercept(entropy, before) FILTER (WHERE label = 0) AS ic,
                regr_slope(entropy, before) FILTER (WHERE label = 1) AS ph, regr_intercept(entropy, before) FILTER (WHERE label = 1) AS ih FROM lagged GROUP BY ALL),
pred AS (SELECT l.*, pc * before + ic AS qc, ph * before + ih AS qh, CASE WHEN step = 0 THEN entropy ELSE pc * before + ic END AS rc,
                CASE WHEN step = 0 THEN entropy ELSE ph * before + ih END AS rh FROM lagged AS l JOIN fits USING (step, pos))
"""


def predicted(spark, sf_dir):
    cells = lagged(spark, sf_dir)
    return ar1.predict(cells, ar1.class_fits(cells))


@query("c6_ar1_predictions", fx.with_cells("SELECT run_id, sample_id, step, pos, qc AS pred_correct, qh AS pred_halluc FROM pred WHERE step > 0", PRED), "pred_correct pred_halluc")
def ar1_predictions(spark, sf_dir):
    return predicted(spark, sf_dir).where("step > 0").select(*KEY, "step", "pos", "pred_correct", "pred_halluc")


EFFECTIVE = "masked AND NOT padding"


@query(
    "d37_mean_prediction",
    fx.with_cells(
        f"SELECT run_id, sample_id, coalesce(sum(qc) FILTER (WHERE {EFFECTIVE}), 0) / greatest(count(*) FILTER (WHERE {EFFECTIVE}), 1) AS MeanPred_correct, "
        f"coalesce(sum(qh) FILTER (WHERE {EFFECTIVE}), 0) / greatest(count(*) FILTER (WHERE {EFFECTIVE}), 1) AS MeanPred_halluc FROM pred WHERE step > 0 GROUP BY ALL", PRED),
    "MeanPred_correct MeanPred_halluc",
)
def mean_prediction(spark, sf_dir):
    mask = F.col("masked_in") & ~F.col("padding")
    return ar1.prediction_features(predicted(spark, sf_dir), mask).select(*KEY, "MeanPred_correct", "MeanPred_halluc")


@query(
    "d38_var_prediction",
    fx.with_cells(
        f"SELECT run_id, sample_id, coalesce(avg(vc) FILTER (WHERE n >= 2), 0) AS VarPred_correct, coalesce(avg(vh) FILTER (WHERE n >= 2), 0) AS VarPred_halluc FROM "
        f"(SELECT run_id, sample_id, step, count(*) FILTER (WHERE {EFFECTIVE}) AS n, var_pop(qc) FILTER (WHERE {EFFECTIVE}) AS vc, var_pop(qh) FILTER (WHERE {EFFECTIVE}) AS vh "
        "FROM pred WHERE step > 0 GROUP BY ALL) AS t GROUP BY ALL", PRED),
    "VarPred_correct VarPred_halluc",
)
def var_prediction(spark, sf_dir):
    mask = F.col("masked_in") & ~F.col("padding")
    return ar1.prediction_features(predicted(spark, sf_dir), mask).select(*KEY, "VarPred_correct", "VarPred_halluc")


STATS = PRED + """,
twice AS (SELECT *, 'correct' AS model, rc AS recon FROM pred WHERE masked UNION ALL SELECT *, 'halluc', rh FROM pred WHERE masked),
stats AS (SELECT run_id, sample_id, label, model, step, count(*) AS n, avg(entropy) AS mean_data, var_pop(entropy) AS var_data, avg(recon) AS mean_recon, var_pop(recon) AS var_recon
          FROM twice GROUP BY run_id, sample_id, label, model, step)
"""


@query(
    "d40_ar1_population_stats",
    fx.with_cells(
        "SELECT label, model, step, avg(mean_data) AS mean_data, coalesce(avg(var_data) FILTER (WHERE n > 1), 0) AS var_data, avg(mean_recon) AS mean_recon, "
        "coalesce(avg(var_recon) FILTER (WHERE n > 1), 0) AS var_recon FROM stats GROUP BY ALL", STATS),
    "mean_data var_data mean_recon var_recon",
)
def ar1_population_stats(spark, sf_dir):
    return ar1.population_stats(predicted(spark, sf_dir), F.col("masked_in"))


@query("d41_ar1_sample_stats", fx.with_cells("SELECT * EXCLUDE (label) FROM stats", STATS), "mean_data var_data mean_recon var_recon")
def ar1_sample_stats(spark, sf_dir):
    return ar1.sample_stats(predicted(spark, sf_dir), F.col("masked_in"))


PICKS = """
unmask AS (SELECT run_id, sample_id, pos, coalesce(min(step) FILTER (WHERE was AND NOT masked), 8)::INT AS unmask_step, bool_or(padding) AS padding FROM flags GROUP BY ALL),
ranked AS (SELECT run_id, sample_id, pos, row_number() OVER (PARTITION BY run_id, sample_id ORDER BY unmask_step, pos) - 1 AS rank,
                  count(*) OVER (PARTITION BY run_id, sample_id) AS n FROM unmask WHERE unmask_step < 8 AND NOT padding),
picks AS (SELECT run_id, sample_id, pos FROM ranked WHERE n < 4 OR rank IN (0, floor((n - 1) / 3.0), floor(2 * (n - 1) / 3.0), n - 1))
"""


@query(
    "d42_ar1_token_reconstruction",
    fx.with_cells("SELECT run_id, sample_id, step, pos, entropy, rc AS recon_correct, rh AS recon_halluc FROM pred JOIN picks USING (run_id, sample_id, pos)", PRED + "," + PICKS),
    "entropy recon_correct recon_halluc",
)
def ar1_token_reconstruction(spark, sf_dir):
    cells = predicted(spark, sf_dir)
    return ar1.token_reconstruction(cells, cl.evenly_spaced(cl.unmask_order(cells), 4))


CURVES = """
sc AS (SELECT run_id, sample_id, (cls >= 5)::INT AS label, step, count(*) FILTER (WHERE masked) AS n, coalesce(avg(entropy) FILTER (WHERE masked), 0) AS m, coalesce(var_pop(entropy) FILTER (WHERE masked), 0) AS v,
              coalesce(avg(prob) FILTER (WHERE masked), 0) AS pm, coalesce(var_pop(prob) FILTER (WHERE masked), 0) AS pv FROM flags GROUP BY ALL),
pc AS (SELECT label, step, coalesce(avg(m) FILTER (WHERE n >= 1), 0) AS mean, coalesce(avg(v) FILTER (WHERE n >= 2), 0) AS var,
              coalesce(avg(pm) FILTER (WHERE n >= 1), 0) AS pmean, coalesce(avg(pv) FILTER (WHERE n >= 2), 0) AS pvar FROM sc GROUP BY ALL)
"""


def labelled(spark, sf_dir, pad=None):
    return fx.cells(spark, sf_dir, pad_id=pad, keep=("cls",)).withColumn("label", (F.col("cls") >= 5).cast("int"))


@query("d43_population_curve", fx.with_cells("SELECT label, step, mean, var FROM pc", CURVES), "mean var")
def population_curve(spark, sf_dir):
    return cv.population_curve(labelled(spark, sf_dir))


@query("d43_population_curve_prob", fx.with_cells("SELECT label, step, pmean AS mean, pvar AS var FROM pc", CURVES), "mean var")
def population_curve_prob(spark, sf_dir):
    return cv.population_curve(labelled(spark, sf_dir), "prob")


@query("d44_unmasked_curve", fx.with_cells("SELECT label, step, avg(m) AS mean FROM (SELECT run_id, sample_id, (cls >= 5)::INT AS label, step, avg(entropy) FILTER (WHERE NOT padding) AS m FROM flags GROUP BY ALL) AS t GROUP BY ALL"), "mean")
def unmasked_curve(spark, sf_dir):
    return cv.unmasked_curve(labelled(spark, sf_dir, fx.PAD_ID))


@query("d45_sample_curve", fx.with_cells("SELECT run_id, sample_id, step, n, m AS mean, v AS var FROM sc", CURVES), "mean var")
def sample_curve(spark, sf_dir):
    return cv.sample_curve(fx.cells(spark, sf_dir))


def _exp_sql(y, where):
    return fx.with_cells(
        f"SELECT label, alpha, beta, -1.0 / alpha AS tau, exp(beta) AS c, r_squared FROM (SELECT label, regr_slope({y}, step) FILTER (WHERE {where}) AS alpha, "
        f"regr_intercept({y}, step) FILTER (WHERE {where}) AS beta, regr_r2({y}, step) FILTER (WHERE {where}) AS r_squared FROM pc GROUP BY ALL) AS t", CURVES)


@query("d46_fit_exponential", _exp_sql("ln(mean)", "mean > 1e-10"), "alpha beta tau c r_squared")
def fit_exponential(spark, sf_dir):
    return cv.fit_exponential(cv.population_curve(labelled(spark, sf_dir)))


@query("d47_fit_t_exponential", _exp_sql("CASE WHEN step > 0 THEN ln(mean / step) END", "mean > 1e-10 AND step > 0"), "alpha beta tau c r_squared")
def fit_t_exponential(spark, sf_dir):
    return cv.fit_t_exponential(cv.population_curve(labelled(spark, sf_dir)))


NAMES = ft.STATIC + ft.NO_PADDING + ft.DYNAMIC
WIDE = BYSTEP + "," + all_features_sql() + f""",
labels AS (SELECT run_id, sample_id, (any_value(cls) >= 5)::INT AS label FROM flags GROUP BY run_id, sample_id),
wide AS MATERIALIZED (SELECT * FROM features JOIN labels USING (run_id, sample_id)),
long AS MATERIALIZED (UNPIVOT wide ON {", ".join(NAMES)} INTO NAME feature VALUE value)
"""


def wide(spark, sf_dir):
    features = ft.trace_features(fx.cells(spark, sf_dir, pad_id=fx.PAD_ID)).select(*KEY, *[F.col(n).cast("double").alias(n) for n in NAMES])
    return features.join(fx.sample_labels(spark, sf_dir).select(*KEY, "label"), KEY)


def long(spark, sf_dir):
    """Features that have a value, one row each."""
    return wide(spark, sf_dir).unpivot([*KEY, "label"], NAMES, "feature", "value").where("value IS NOT NULL")


@query(
    "d48_feature_histogram",
    fx.with_cells(
        "SELECT feature, label, bin, lo + bin * w AS left_edge, coalesce(c, 0) AS count, coalesce(c, 0) / (n * w) AS density FROM "
        "(SELECT feature, label, n, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN 1.0 ELSE hi - lo END / 30 AS w FROM spans) AS s "
        "CROSS JOIN (SELECT unnest(range(30))::INT AS bin) AS g LEFT JOIN (SELECT feature, label, least(29, floor((value - lo) / w))::INT AS bin, count(*) AS c FROM long JOIN "
        "(SELECT feature, label, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN 1.0 ELSE hi - lo END / 30 AS w FROM spans) AS z USING (feature, label) GROUP BY ALL) AS b USING (feature, label, bin)",
        WIDE + ", spans AS (SELECT feature, label, count(*) AS n, min(value) AS lo, max(value) AS hi FROM long GROUP BY ALL)"),
    "left_edge density",
)
def feature_histogram(spark, sf_dir):
    return cv.feature_histogram(long(spark, sf_dir))


def _each_pair(names, value):
    """One aggregate row with a struct for each pair, unnested."""
    pairs = [(i, j, a, b) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    structs = ", ".join(f"{{'i': {i}, 'j': {j}, 'name_i': '{a}', 'name_j': '{b}', {value(a, b)}}}" for i, j, a, b in pairs)
    return f"SELECT unnest([{structs}], recursive := true) FROM wide"


# DuckDB has no number for a constant side; the library gives NULL.
CORR_SQL = f"SELECT i, j, name_i, name_j, CASE WHEN isfinite(r) THEN r END AS r FROM ({_each_pair(NAMES, lambda a, b: f"'r': corr({a}, {b})")}) AS every"


@query("d49_correlation_matrix", fx.with_cells(CORR_SQL, WIDE), "r")
def correlation_matrix(spark, sf_dir):
    return cv.correlation_matrix(wide(spark, sf_dir), NAMES)


@query(
    "c7_feature_pairs",
    f"SELECT name_i, name_j, n, dot FROM ({fx.with_cells(_each_pair(sorted(NAMES), lambda a, b: f"'n': count({a} * {b}), 'dot': coalesce(sum({a} * {b}), 0)"), WIDE)}) AS every",
    "dot",
)
def feature_pairs(spark, sf_dir):
    """Products of every pair of features over the samples that have both."""
    return cv.pair_moments(wide(spark, sf_dir), sorted(NAMES), center=False).select("name_i", "name_j", "n", F.col("sxy").alias("dot"))


@query(
    "d50_label_correlation",
    fx.with_cells("SELECT feature, r, (row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, feature))::INT AS rank FROM "
        "(SELECT feature, CASE WHEN isfinite(corr(value, label)) THEN corr(value, label) END AS r FROM long GROUP BY ALL) AS t", WIDE),
    "r",
)
def label_correlation(spark, sf_dir):
    return cv.label_correlation(long(spark, sf_dir))


@query(
    "i11_correlation_prefilter",
    fx.with_cells(
        f"SELECT DISTINCT CASE WHEN a.c >= b.c THEN name_j ELSE name_i END AS dropped FROM ({CORR_SQL}) AS p JOIN (SELECT feature, abs(corr(value, label)) AS c FROM long GROUP BY ALL) AS a ON a.feature = name_i "
        "JOIN (SELECT feature, abs(corr(value, label)) AS c FROM long GROUP BY ALL) AS b ON b.feature = name_j WHERE abs(r) > 0.9", WIDE),
)
def correlation_prefilter(spark, sf_dir):
    from tracelab.operators.selection import prefilter_drops

    return prefilter_drops(wide(spark, sf_dir), NAMES, threshold=0.9).select("dropped").distinct()
