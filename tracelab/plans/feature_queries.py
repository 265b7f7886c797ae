"""Queries for the per-sample trace features (D1-D33, D51-D53), checked one feature at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.operators import features as ft
from tracelab.plans import fixtures as fx
from tracelab.plans.registry import query
from tracelab.session import KEY

PAD = fx.PAD_ID

BYSTEP = """
bystep AS (SELECT run_id, sample_id, step, avg(entropy) AS me, avg(prob) AS mp,
                  var_pop(entropy) AS ve, var_pop(prob) AS vp,
                  count(*) FILTER (WHERE masked) AS nm,
                  var_pop(entropy) FILTER (WHERE masked) AS vem, var_pop(prob) FILTER (WHERE masked) AS vpm,
                  count(*) FILTER (WHERE masked AND NOT padding) AS nn,
                  var_pop(entropy) FILTER (WHERE masked AND NOT padding) AS ven,
                  var_pop(prob) FILTER (WHERE masked AND NOT padding) AS vpn,
                  avg(ln(entropy + 1e-10)) AS le, avg(ln(prob + 1e-10)) AS lp
           FROM flags GROUP BY ALL),
bypos AS (SELECT run_id, sample_id, pos, var_pop(entropy) AS ve, var_pop(prob) AS vp, avg(entropy) AS me,
                 count(*) FILTER (WHERE masked) AS nm,
                 var_pop(entropy) FILTER (WHERE masked) AS vem, var_pop(prob) FILTER (WHERE masked) AS vpm,
                 regr_slope(ln(entropy + 1e-10), step) AS ae, regr_intercept(ln(entropy + 1e-10), step) AS be,
                 regr_slope(ln(prob + 1e-10), step) AS ap, regr_intercept(ln(prob + 1e-10), step) AS bp
          FROM flags GROUP BY ALL),
tau AS (SELECT run_id, sample_id, step, (lead(me, 5) OVER (PARTITION BY run_id, sample_id ORDER BY step) - me) / 5 AS tau
        FROM bystep),
curve AS (SELECT run_id, sample_id, step, vem AS v,
                 row_number() OVER (PARTITION BY run_id, sample_id ORDER BY step) - 1 AS k
          FROM bystep WHERE nm > 1),
grad AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM curve
         WINDOW w AS (PARTITION BY run_id, sample_id ORDER BY k)),
grad1 AS (SELECT *, CASE WHEN b IS NULL THEN a - v WHEN a IS NULL THEN v - b ELSE (a - b) / 2 END AS d FROM grad),
grad2 AS (SELECT *, lag(d) OVER w AS db, lead(d) OVER w AS da FROM grad1
          WINDOW w AS (PARTITION BY run_id, sample_id ORDER BY k)),
curv AS (SELECT run_id, sample_id,
                abs(CASE WHEN db IS NULL THEN da - d WHEN da IS NULL THEN d - db ELSE (da - db) / 2 END)
                / pow(1 + d * d, 1.5) AS c FROM grad2),
reveal AS (SELECT run_id, sample_id, entropy, prob,
                  row_number() OVER (PARTITION BY run_id, sample_id ORDER BY step, pos) AS rn FROM flags WHERE ju),
ids AS (SELECT DISTINCT run_id, sample_id FROM plain)
"""


def _sql(expr: str, name: str, source: str, zero: bool = False) -> str:
    value = f"coalesce(x.v, 0)" if zero else "x.v"
    return fx.with_cells(
        f"SELECT ids.run_id, ids.sample_id, ({value}) AS {name} FROM ids LEFT JOIN "
        f"(SELECT run_id, sample_id, {expr} AS v FROM {source} GROUP BY ALL) AS x USING (run_id, sample_id)",
        BYSTEP,
    )


MOMENTS = """
(SELECT run_id, sample_id, v, avg(v) OVER (PARTITION BY run_id, sample_id) AS m FROM curve) AS c
"""
# Key stem -> (feature, SQL expression, SQL source, 0 instead of NULL).
STATIC = {
    "d1_mean_entropy": ("MeanEntropy", "avg(entropy)", "flags", False),
    "d2_mean_masked_entropy": ("MeanMaskedEntropy", "coalesce(sum(entropy) FILTER (WHERE masked), 0) / greatest(count(*) FILTER (WHERE masked), 1)", "flags", False),
    "d3_mean_entropy_just_unmasked": ("MeanEntropyJustUnmasked", "avg(entropy)", "reveal", True),
    "d4_mean_prob": ("MeanLogProb", "avg(prob)", "flags", False),
    "d5_mean_prob_masked": ("MeanLogProbMasked", "coalesce(sum(prob) FILTER (WHERE masked), 0) / greatest(count(*) FILTER (WHERE masked), 1)", "flags", False),
    "d6_mean_prob_just_unmasked": ("MeanLogProbJustUnmasked", "avg(prob)", "reveal", True),
    "d7_var_entropy": ("VarEntropy", "avg(ve)", "bypos", False),
    "d8_var_entropy_across_tokens": ("VarEntropyAcrossTokens", "avg(ve)", "bystep", False),
    "d9_var_masked_entropy": ("VarMaskedEntropy", "avg(vem) FILTER (WHERE nm > 1)", "bypos", True),
    "d10_var_masked_entropy_across_tokens": ("VarMaskedEntropyAcrossTokens", "avg(vem) FILTER (WHERE nm > 1)", "bystep", True),
    "d11_var_entropy_just_unmasked": ("VarEntropyJustUnmasked", "var_pop(entropy) FILTER (WHERE rn > 1)", "reveal", False),
    "d12_var_prob": ("VarLogProb", "avg(vp)", "bypos", False),
    "d13_var_prob_across_tokens": ("VarLogProbAcrossTokens", "avg(vp)", "bystep", False),
    "d14_var_prob_masked": ("VarLogProbMasked", "avg(vpm) FILTER (WHERE nm > 1)", "bypos", True),
    "d15_var_prob_masked_across_tokens": ("VarLogProbMaskedAcrossTokens", "avg(vpm) FILTER (WHERE nm > 1)", "bystep", True),
    "d16_var_prob_just_unmasked": ("VarLogProbJustUnmasked", "var_pop(prob) FILTER (WHERE rn > 1)", "reveal", False),
    "d19_auc_variance_curve": ("AUCVarMaskedEntropyCurve", "sum((v + a) / 2)", "grad", True),
    "d20_max_variance_curve": ("MaxVarMaskedEntropyCurve", "max(v)", "curve", False),
    "d21_argmax_variance_curve": ("ArgmaxVarMaskedEntropyCurve", "arg_max(k, v)", "(SELECT * FROM curve ORDER BY k) AS c", False),
    "d22_skewness_variance_curve": ("SkewnessVarMaskedEntropyCurve", "CASE WHEN var_pop(v) > 0 THEN avg(pow(v - m, 3)) / pow(var_pop(v), 1.5) END", MOMENTS, False),
    "d23_kurtosis_variance_curve": ("KurtosisVarMaskedEntropyCurve", "CASE WHEN var_pop(v) > 0 THEN avg(pow(v - m, 4)) / pow(var_pop(v), 2) - 3 END", MOMENTS, False),
    "d24_mean_curvature_variance_curve": ("MeanCurvatureMaskedEntropyCurve", "avg(c)", "curv", False),
    "d25_mean_masked_entropy_nopad": ("MeanMaskedEntropyNoPad", "coalesce(sum(entropy) FILTER (WHERE masked AND NOT padding), 0) / greatest(count(*) FILTER (WHERE masked AND NOT padding), 1)", "flags", False),
    "d26_var_masked_entropy_across_tokens_nopad": ("VarMaskedEntropyAcrossTokensNoPad", "avg(ven) FILTER (WHERE nn > 1)", "bystep", True),
    "d27_mean_prob_masked_nopad": ("MeanLogProbMaskedNoPad", "coalesce(sum(prob) FILTER (WHERE masked AND NOT padding), 0) / greatest(count(*) FILTER (WHERE masked AND NOT padding), 1)", "flags", False),
    "d28_var_prob_masked_across_tokens_nopad": ("VarLogProbMaskedAcrossTokensNoPad", "avg(vpn) FILTER (WHERE nn > 1)", "bystep", True),
}


# The same for the features that a query gives several at a time; trace features take the curve of all tokens.
DYNAMIC = {
    "tau": [("MeanVarTauEntropy", "avg(tau) FILTER (WHERE step % 5 = 0 AND step < 8 - 5)"), ("VarTauEntropy", "var_pop(tau) FILTER (WHERE step % 5 = 0 AND step < 8 - 5)")],
    "bypos": [("AlphaEntropy", "avg(ae)"), ("BetaEntropy", "avg(be)"), ("AlphaLogProb", "avg(ap)"), ("BetaLogProb", "avg(bp)")],
    "bystep": [("AlphaEntropyAvg", "regr_slope(ln(me + 1e-10), step)"), ("BetaEntropyAvg", "regr_intercept(ln(me + 1e-10), step)")],
    "(SELECT run_id, sample_id, count(*) FILTER (WHERE me > 0) AS n, regr_slope(ln(me / step), step) FILTER (WHERE me > 0 AND step > 0) AS a, "
    "regr_intercept(ln(me / step), step) FILTER (WHERE me > 0 AND step > 0) AS b FROM bystep GROUP BY ALL) AS f":
        [(name, f"any_value(CASE WHEN n >= 3 THEN {e} END)") for name, e in (("C_fit", "exp(b + (n / 2.0) * a)"), ("Tau_fit", "-1.0 / a"), ("M_fit", "(n / 2.0)::DOUBLE"))],
}


def all_features_sql() -> str:
    """CTE ``features`` of all 37 features, one pass per source; needs ``BYSTEP``."""
    sources: dict[str, list[tuple[str, str, bool]]] = {}
    for feature, expr, source, zero in STATIC.values():
        sources.setdefault(source, []).append((feature, expr, zero))
    for source, own in DYNAMIC.items():
        sources.setdefault(source, []).extend((feature, expr, False) for feature, expr in own)
    names = [(f"s{i}.{f}", f, zero) for i, own in enumerate(sources.values()) for f, _, zero in own]
    columns = ", ".join(f"coalesce({c}, 0)::DOUBLE AS {f}" if zero else f"{c}::DOUBLE AS {f}" for c, f, zero in names)
    joins = " ".join(
        f"LEFT JOIN (SELECT run_id, sample_id, {', '.join(f'{e} AS {f}' for f, e, _ in own)} FROM {source} GROUP BY ALL) AS s{i} USING (run_id, sample_id)"
        for i, (source, own) in enumerate(sources.items()))
    return f"features AS MATERIALIZED (SELECT run_id, sample_id, {columns} FROM ids {joins})"


def _register_static():
    for key, (feature, expr, source, zero) in STATIC.items():
        doubles = "" if key == "d21_argmax_variance_curve" else feature

        def run(spark, sf_dir, feature=feature):
            pad = PAD if feature in ft.NO_PADDING else None
            cells = fx.cells(spark, sf_dir, pad_id=pad)
            if feature in ("VarEntropy", "VarMaskedEntropy", "VarLogProb", "VarLogProbMasked"):
                return ft.token_variances(cells).select(*KEY, feature)
            return ft.static_from_steps(ft.step_stats(cells)).select(*KEY, feature)

        query(key, _sql(expr, feature, source, zero), doubles)(run)


_register_static()


@query(
    "d17_tau_entropy",
    fx.with_cells(
        "SELECT run_id, sample_id, avg(tau) AS MeanVarTauEntropy, var_pop(tau) AS VarTauEntropy "
        "FROM tau WHERE step % 5 = 0 AND step < 8 - 5 GROUP BY ALL", BYSTEP),
    "MeanVarTauEntropy VarTauEntropy",
)
def tau_entropy(spark, sf_dir):
    steps = ft.step_stats(fx.cells(spark, sf_dir))
    return ft.static_from_steps(steps).select(*KEY, "MeanVarTauEntropy", "VarTauEntropy")


@query("d18_variance_curve", fx.with_cells("SELECT run_id, sample_id, step, k, v FROM curve", BYSTEP), "v")
def variance_curve(spark, sf_dir):
    return ft.variance_curve(ft.step_stats(fx.cells(spark, sf_dir)))


@query(
    "d29_log_fit_entropy",
    fx.with_cells("SELECT run_id, sample_id, avg(ae) AS AlphaEntropy, avg(be) AS BetaEntropy FROM bypos GROUP BY ALL", BYSTEP),
    "AlphaEntropy BetaEntropy",
)
def log_fit_entropy(spark, sf_dir):
    return ft.log_fits(ft.step_stats(fx.cells(spark, sf_dir))).select(*KEY, "AlphaEntropy", "BetaEntropy")


@query(
    "d30_token_fit_variance",
    fx.with_cells(
        "SELECT run_id, sample_id, avg(ae) AS mean_a_e, avg(be) AS mean_b_e, avg(ap) AS mean_a_p, avg(bp) AS mean_b_p, "
        "var_pop(ae) AS var_a_e, var_pop(be) AS var_b_e, var_pop(ap) AS var_a_p, var_pop(bp) AS var_b_p FROM bypos GROUP BY ALL", BYSTEP),
    "mean_a_e mean_b_e mean_a_p mean_b_p var_a_e var_b_e var_a_p var_b_p",
)
def token_fit_variance(spark, sf_dir):
    return ft.token_fits(fx.cells(spark, sf_dir))


TOP3 = """
ranked AS (SELECT run_id, sample_id, pos, row_number() OVER (PARTITION BY run_id, sample_id ORDER BY me DESC, pos DESC) AS rank
           FROM bypos),
topcurve AS (SELECT run_id, sample_id, step, avg(entropy) AS y FROM flags JOIN ranked USING (run_id, sample_id, pos)
             WHERE rank <= 3 GROUP BY ALL)
"""


@query(
    "d31_top_token_fit",
    fx.with_cells(
        "SELECT run_id, sample_id, regr_slope(ln(y + 1e-10), step) AS AlphaEntropyAvg, "
        "regr_intercept(ln(y + 1e-10), step) AS BetaEntropyAvg FROM topcurve GROUP BY ALL", BYSTEP + "," + TOP3),
    "AlphaEntropyAvg BetaEntropyAvg",
)
def top_token_fit(spark, sf_dir):
    curve = ft.mean_curve(fx.cells(spark, sf_dir), 3)
    return ft.curve_fits(curve).select(*KEY, "AlphaEntropyAvg", "BetaEntropyAvg")


@query(
    "d32_log_fit_prob",
    fx.with_cells("SELECT run_id, sample_id, avg(ap) AS AlphaLogProb, avg(bp) AS BetaLogProb FROM bypos GROUP BY ALL", BYSTEP),
    "AlphaLogProb BetaLogProb",
)
def log_fit_prob(spark, sf_dir):
    return ft.log_fits(ft.step_stats(fx.cells(spark, sf_dir))).select(*KEY, "AlphaLogProb", "BetaLogProb")


@query(
    "d33_parametric_fit",
    fx.with_cells(
        "SELECT run_id, sample_id, exp(b + (n / 2.0) * a) AS C_fit, -1.0 / a AS Tau_fit, (n / 2.0)::DOUBLE AS M_fit FROM "
        "(SELECT run_id, sample_id, count(*) FILTER (WHERE y > 0) AS n, "
        "regr_slope(ln(y / step), step) FILTER (WHERE y > 0 AND step > 0) AS a, "
        "regr_intercept(ln(y / step), step) FILTER (WHERE y > 0 AND step > 0) AS b FROM topcurve GROUP BY ALL) AS f "
        "WHERE n >= 3", BYSTEP + "," + TOP3),
    "C_fit Tau_fit M_fit",
)
def parametric_fit(spark, sf_dir):
    return ft.curve_fits(ft.mean_curve(fx.cells(spark, sf_dir), 3)).select(*KEY, "C_fit", "Tau_fit", "M_fit")


@query(
    "d51_perplexity",
    fx.with_cells("SELECT run_id, sample_id, exp(-avg(ln(prob)) FILTER (WHERE ju)) AS perplexity FROM flags GROUP BY ALL"),
    "perplexity",
)
def perplexity(spark, sf_dir):
    return ft.unmask_perplexity(fx.cells(spark, sf_dir, ("prob", "masked")))


@query(
    "d52_ln_entropy",
    fx.with_cells("SELECT run_id, sample_id, coalesce(avg(entropy) FILTER (WHERE ju), 0) AS ln_entropy FROM flags GROUP BY ALL"),
    "ln_entropy",
)
def ln_entropy(spark, sf_dir):
    steps = ft.step_stats(fx.cells(spark, sf_dir))
    return ft.static_from_steps(steps).select(*KEY, F.col("MeanEntropyJustUnmasked").alias("ln_entropy"))


@query(
    "d53_transfer_counts",
    fx.with_cells("SELECT run_id, sample_id, step, count(*) FILTER (WHERE ju) AS n_transfer FROM flags GROUP BY ALL"),
)
def transfer_counts(spark, sf_dir):
    return ft.transfer_counts(fx.cells(spark, sf_dir, ("masked",)))


@query(
    "g3_feature_union",
    fx.with_cells(
        "SELECT s.run_id, s.sample_id, s.m AS MeanEntropy, p.v AS VarEntropy, f.a AS AlphaEntropy FROM "
        "(SELECT run_id, sample_id, avg(entropy) AS m FROM flags GROUP BY ALL) AS s "
        "JOIN (SELECT run_id, sample_id, avg(ve) AS v FROM bypos GROUP BY ALL) AS p USING (run_id, sample_id) "
        "JOIN (SELECT run_id, sample_id, avg(ae) AS a FROM bypos GROUP BY ALL) AS f USING (run_id, sample_id)", BYSTEP),
    "MeanEntropy VarEntropy AlphaEntropy",
)
def feature_union(spark, sf_dir):
    return ft.trace_features(fx.cells(spark, sf_dir)).select(*KEY, "MeanEntropy", "VarEntropy", "AlphaEntropy")


def _cleaned_sql():
    return fx.with_cells(
        "SELECT s.*, p.VarMaskedEntropy, p.VarLogProb FROM (SELECT run_id, sample_id, "
        "coalesce(sum(entropy) FILTER (WHERE masked), 0) / greatest(count(*) FILTER (WHERE masked), 1) AS MeanMaskedEntropy, "
        "avg(prob) AS MeanLogProb FROM flags GROUP BY ALL) AS s JOIN "
        "(SELECT run_id, sample_id, coalesce(avg(vem) FILTER (WHERE nm > 1), 0) AS VarMaskedEntropy, avg(vp) AS VarLogProb "
        "FROM bypos GROUP BY ALL) AS p USING (run_id, sample_id)", BYSTEP)


@query("b10_select_features", _cleaned_sql(), "MeanMaskedEntropy MeanLogProb VarMaskedEntropy VarLogProb")
def select_features(spark, sf_dir):
    wanted = ["MeanMaskedEntropy", "MeanLogProb", "VarMaskedEntropy", "VarLogProb", "MeanTau", "Max_V"]
    kept, _ = ft.select_features(ft.trace_features(fx.cells(spark, sf_dir)), wanted)
    return kept


@query(
    "g5_known_features",
    "SELECT lang, count(*) FILTER (WHERE k.source IS NOT NULL) AS n_known, count(*) FILTER (WHERE k.source IS NULL) AS n_unknown FROM "
    "(SELECT DISTINCT lang, source FROM documents WHERE source IS NOT NULL) AS d LEFT JOIN "
    "(SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) AS k USING (source) GROUP BY lang",
)
def known_features(spark, sf_dir):
    """Of the names that each language asks for (sources of its documents), how many a registry knows (sources of labelled toxic ones)."""
    docs, labels = fx.table(spark, sf_dir, "documents"), fx.table(spark, sf_dir, "labels")
    requested = docs.where("source IS NOT NULL").select("lang", F.col("source").alias("name")).distinct()
    registry = docs.join(labels.where("toxic = 1"), "doc_id").select(F.col("source").alias("name")).distinct().withColumn("known", F.lit(True))
    met = requested.join(registry, "name", "left")
    return met.groupBy("lang").agg(F.count_if(F.col("known")).alias("n_known"), F.count_if(F.col("known").isNull()).alias("n_unknown"))
