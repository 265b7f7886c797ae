"""Per-sample uncertainty features of a trace.

Two groupings of the cells, by (sample, step) and by (sample, position), feed every feature. Both
group below a sample, so on co-located cells neither needs an exchange, and unused features cost
nothing because Catalyst prunes their aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.session import KEY

# Feature names and their order.
STATIC = [
    "MeanEntropy", "MeanMaskedEntropy", "MeanEntropyJustUnmasked",
    "MeanLogProb", "MeanLogProbMasked", "MeanLogProbJustUnmasked",
    "VarEntropy", "VarEntropyAcrossTokens", "VarMaskedEntropy", "VarMaskedEntropyAcrossTokens",
    "VarEntropyJustUnmasked", "VarLogProb", "VarLogProbAcrossTokens", "VarLogProbMasked",
    "VarLogProbMaskedAcrossTokens", "VarLogProbJustUnmasked",
    "MeanVarTauEntropy", "VarTauEntropy",
    "AUCVarMaskedEntropyCurve", "MaxVarMaskedEntropyCurve", "ArgmaxVarMaskedEntropyCurve",
    "SkewnessVarMaskedEntropyCurve", "KurtosisVarMaskedEntropyCurve", "MeanCurvatureMaskedEntropyCurve",
]
NO_PADDING = [
    "MeanMaskedEntropyNoPad", "VarMaskedEntropyAcrossTokensNoPad",
    "MeanLogProbMaskedNoPad", "VarLogProbMaskedAcrossTokensNoPad",
]
DYNAMIC = [
    "AlphaEntropy", "BetaEntropy", "AlphaEntropyAvg", "BetaEntropyAvg",
    "AlphaLogProb", "BetaLogProb", "C_fit", "Tau_fit", "M_fit",
]
# The reduced feature list of the benchmark; names that no feature carries are ignored.
CLEANED = [
    "MeanMaskedEntropy", "MeanLogProb", "VarMaskedEntropy", "VarMaskedEntropyAcrossTokens", "VarLogProb",
    "AlphaEntropy", "BetaEntropy", "AlphaEntropyAvg", "BetaEntropyAvg", "AlphaLogProb", "BetaLogProb",
    "C_fit", "Tau_fit", "M_fit", "MeanTau", "VarTau", "AUC_V", "Max_V", "Argmax_V", "Skewness_V",
    "Kurtosis_V", "MeanCurvature_V",
]
LOG_FLOOR = 1e-10
TAU_WINDOW = 5


def select_features(features: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """The known names in list order, and the names that were dropped."""
    known = [n for n in names if n in features.columns]
    return features.select(*KEY, *known), [n for n in names if n not in features.columns]


def _subset(value: str, when: Column | None, tag: str) -> list[Column]:
    picked = F.col(value) if when is None else F.when(when, F.col(value))
    return [F.sum(picked).alias(f"sum_{tag}"), F.var_pop(picked).alias(f"var_{tag}")]


def step_stats(cells: DataFrame) -> DataFrame:
    """One row per (sample, step): counts, sums and variances of every cell subset in use."""
    masked, revealed = F.col("masked_in"), F.col("just_unmasked")
    aggs = [
        F.count(F.lit(1)).alias("n"), F.count_if(masked).alias("n_masked"), F.count_if(revealed).alias("n_ju"),
    ]
    unpadded = masked & ~F.col("padding") if "padding" in cells.columns else None
    if unpadded is not None:
        aggs.append(F.count_if(unpadded).alias("n_nopad"))
    for value, tag in (("entropy", "e"), ("prob", "p")):
        aggs += _subset(value, None, tag)
        aggs += _subset(value, masked, f"{tag}_masked")
        aggs += _subset(value, revealed, f"{tag}_ju")
        aggs.append(F.min_by(value, F.when(revealed, F.col("pos"))).alias(f"first_{tag}_ju"))
        aggs.append(F.avg(F.ln(F.col(value) + LOG_FLOOR)).alias(f"ln_{tag}"))
        if unpadded is not None:
            aggs += _subset(value, unpadded, f"{tag}_nopad")
    return cells.groupBy(*KEY, "step").agg(*aggs)


def _ratio(total: str, count: str) -> Column:
    """Sum over a masked subset by max(count, 1)."""
    return F.coalesce(F.sum(total), F.lit(0.0)) / F.greatest(F.sum(count), F.lit(1))


def _mean_variance(variance: str, count: str) -> Column:
    """Mean over steps of the variance, steps with fewer than two cells left out; 0 if none is left."""
    return F.coalesce(F.avg(F.when(F.col(count) > 1, F.col(variance))), F.lit(0.0))


def _variance_without_first(tag: str) -> Column:
    """Population variance of the just-unmasked values without the first one in (step, pos) order.

    Step variances are merged around the sample mean, then one value is taken out again; neither
    step subtracts large squares.
    """
    count, total = F.col("n_ju"), F.col(f"sum_{tag}")
    n = F.sum("n_ju")
    mean = F.max(f"mean_{tag}")
    around = F.pow(total / F.when(count > 0, count) - F.col(f"mean_{tag}"), 2)
    spread = F.sum(count * (F.col(f"var_{tag}") + around))
    first = F.min_by(f"first_{tag}", F.when(count > 0, F.col("step")))
    rest = F.when(n > 1, n - 1)
    return at_least_zero((spread - (first - mean) * (first - (n * mean - first) / rest)) / rest)


def at_least_zero(value: Column) -> Column:
    """Rounding below zero taken away; NULL stays NULL, which ``greatest`` would turn into 0."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def variance_curve(steps: DataFrame) -> DataFrame:
    """V(t): masked variance by step over the steps with two masked cells or more, re-numbered k = 0.."""
    order = Window.partitionBy(*KEY).orderBy("step")
    return steps.where("n_masked > 1").select(
        *KEY, "step", (F.row_number().over(order) - 1).alias("k"), F.col("var_e_masked").alias("v")
    )


def gradient(name: str, order) -> Column:
    """Central difference with unit spacing, one-sided at both ends, NULL for a single point."""
    return _difference(F.col(name), F.lag(name).over(order), F.lead(name).over(order))


def _difference(here: Column, before: Column, after: Column) -> Column:
    return F.when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise((after - before) / 2)


def _on_curve(name: str, way: str) -> Column:
    """Neighbour of a value on the compacted curve: the next row of the sample where it is not NULL."""
    keys = ", ".join(KEY)
    return F.expr(f"{way}({name}) IGNORE NULLS OVER (PARTITION BY {keys} ORDER BY step)")


def static_features(cells: DataFrame) -> DataFrame:
    return static_from_steps(step_stats(cells)).join(token_variances(cells), KEY)


def static_from_steps(steps: DataFrame) -> DataFrame:
    """Every static feature except the four token variances."""
    return _curve_columns(steps).groupBy(*KEY).agg(*_static_aggs("n_nopad" in steps.columns))


def _curve_columns(steps: DataFrame) -> DataFrame:
    """Step rows with sample-wide means, rates of change and the V(t) curve alongside.

    The curve keeps its step rows: v is NULL where a step has fewer than two masked cells, and
    neighbours skip NULLs. So all windows share one sort by (sample, step).
    """
    order = Window.partitionBy(*KEY).orderBy("step")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*KEY)
    out = steps.withColumns(
        {"mean_e": F.col("sum_e") / F.col("n"), "v": F.when(F.col("n_masked") > 1, F.col("var_e_masked"))}
    )
    here = F.col("v").isNotNull()
    out = out.withColumns(
        {
            "ahead": F.lead("mean_e", TAU_WINDOW).over(order),
            "k": F.when(here, F.count("v").over(so_far) - 1).cast("int"),
            "v_next": F.when(here, _on_curve("v", "lead")),
            "v_before": F.when(here, _on_curve("v", "lag")),
        }
    )
    out = out.withColumn("dv", F.when(here, _difference(F.col("v"), F.col("v_before"), F.col("v_next"))))
    second = _difference(F.col("dv"), _on_curve("dv", "lag"), _on_curve("dv", "lead"))
    out = out.withColumn("d2v", F.when(F.col("dv").isNotNull(), second))
    out = out.withColumns(
        {
            "v_max": F.max("v").over(whole),
            "last_step": F.max("step").over(whole),
            "n_ju_all": F.sum("n_ju").over(whole),
            "sum_e_ju_all": F.sum("sum_e_ju").over(whole),
            "sum_p_ju_all": F.sum("sum_p_ju").over(whole),
        }
    )
    revealed = F.when(F.col("n_ju_all") > 0, F.col("n_ju_all"))
    in_window = (F.col("step") % TAU_WINDOW == 0) & (F.col("step") < F.col("last_step") + 1 - TAU_WINDOW)
    return out.withColumns(
        {
            "mean_e_ju": F.col("sum_e_ju_all") / revealed,
            "mean_p_ju": F.col("sum_p_ju_all") / revealed,
            "tau": F.when(in_window, (F.col("ahead") - F.col("mean_e")) / TAU_WINDOW),
        }
    )


def _static_aggs(no_padding: bool) -> list[Column]:
    """Sample aggregates over the step rows; skewness and kurtosis are Spark's population forms."""
    aggs = [
        (F.sum("sum_e") / F.sum("n")).alias("MeanEntropy"),
        _ratio("sum_e_masked", "n_masked").alias("MeanMaskedEntropy"),
        F.coalesce(F.max("mean_e_ju"), F.lit(0.0)).alias("MeanEntropyJustUnmasked"),
        (F.sum("sum_p") / F.sum("n")).alias("MeanLogProb"),
        _ratio("sum_p_masked", "n_masked").alias("MeanLogProbMasked"),
        F.coalesce(F.max("mean_p_ju"), F.lit(0.0)).alias("MeanLogProbJustUnmasked"),
        F.avg("var_e").alias("VarEntropyAcrossTokens"),
        _mean_variance("var_e_masked", "n_masked").alias("VarMaskedEntropyAcrossTokens"),
        _variance_without_first("e_ju").alias("VarEntropyJustUnmasked"),
        F.avg("var_p").alias("VarLogProbAcrossTokens"),
        _mean_variance("var_p_masked", "n_masked").alias("VarLogProbMaskedAcrossTokens"),
        _variance_without_first("p_ju").alias("VarLogProbJustUnmasked"),
        F.avg("tau").alias("MeanVarTauEntropy"),
        F.var_pop("tau").alias("VarTauEntropy"),
        F.coalesce(F.sum((F.col("v") + F.col("v_next")) / 2), F.lit(0.0)).alias("AUCVarMaskedEntropyCurve"),
        F.max("v").alias("MaxVarMaskedEntropyCurve"),
        F.min(F.when(F.col("v") == F.col("v_max"), F.col("k"))).alias("ArgmaxVarMaskedEntropyCurve"),
        F.skewness("v").alias("SkewnessVarMaskedEntropyCurve"),
        F.kurtosis("v").alias("KurtosisVarMaskedEntropyCurve"),
        F.avg(F.abs("d2v") / F.pow(1 + F.col("dv") * F.col("dv"), 1.5)).alias("MeanCurvatureMaskedEntropyCurve"),
    ]
    if no_padding:
        aggs += [
            _ratio("sum_e_nopad", "n_nopad").alias("MeanMaskedEntropyNoPad"),
            _mean_variance("var_e_nopad", "n_nopad").alias("VarMaskedEntropyAcrossTokensNoPad"),
            _ratio("sum_p_nopad", "n_nopad").alias("MeanLogProbMaskedNoPad"),
            _mean_variance("var_p_nopad", "n_nopad").alias("VarLogProbMaskedAcrossTokensNoPad"),
        ]
    return aggs


def token_variances(cells: DataFrame) -> DataFrame:
    """Variances over steps by position, averaged over positions."""
    masked = F.col("masked_in")
    aggs = [F.count_if(masked).alias("n_masked")]
    for value, tag in (("entropy", "e"), ("prob", "p")):
        aggs.append(F.var_pop(value).alias(f"var_{tag}"))
        aggs.append(F.var_pop(F.when(masked, F.col(value))).alias(f"var_{tag}_masked"))
    tokens = cells.groupBy(*KEY, "pos").agg(*aggs)
    return tokens.groupBy(*KEY).agg(
        F.avg("var_e").alias("VarEntropy"),
        _mean_variance("var_e_masked", "n_masked").alias("VarMaskedEntropy"),
        F.avg("var_p").alias("VarLogProb"),
        _mean_variance("var_p_masked", "n_masked").alias("VarLogProbMasked"),
    )


def _fit(y: str, slope: str, intercept: str) -> list[Column]:
    """Least squares of a column without NULLs on the step.

    Written out so that all fits of a grouping share the mean and variance of the step.
    """
    spread = F.var_pop("step")
    rise = F.covar_pop(y, "step") / F.when(spread > 0, spread)
    return [rise.alias(slope), (F.avg(y) - rise * F.avg("step")).alias(intercept)]


def _log_fit_aggs() -> list[Column]:
    return _fit("ln_e", "AlphaEntropy", "BetaEntropy") + _fit("ln_p", "AlphaLogProb", "BetaLogProb")


def log_fits(steps: DataFrame) -> DataFrame:
    """Mean over tokens of the per-token fit of ln(x + 1e-10) on the step.

    All tokens share the same steps, so the mean of their fits equals the fit of the mean curve;
    that removes the grouping by token.
    """
    return steps.groupBy(*KEY).agg(*_log_fit_aggs())


def token_fits(cells: DataFrame) -> DataFrame:
    """Mean and variance over tokens of the per-token fits."""
    logs = cells.withColumns(
        {"ln_e": F.ln(F.col("entropy") + LOG_FLOOR), "ln_p": F.ln(F.col("prob") + LOG_FLOOR)}
    )
    fits = logs.groupBy(*KEY, "pos").agg(*_fit("ln_e", "a_e", "b_e"), *_fit("ln_p", "a_p", "b_p"))
    return fits.groupBy(*KEY).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in ("a_e", "b_e", "a_p", "b_p")],
        *[F.var_pop(c).alias(f"var_{c}") for c in ("a_e", "b_e", "a_p", "b_p")],
    )


def top_tokens(cells: DataFrame, k: int) -> DataFrame:
    """The k positions with the highest mean entropy of each sample, later position first on ties."""
    means = cells.groupBy(*KEY, "pos").agg(F.avg("entropy").alias("mean_entropy"))
    order = Window.partitionBy(*KEY).orderBy(F.desc("mean_entropy"), F.desc("pos"))
    return means.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mean_curve(cells: DataFrame, k: int | None) -> DataFrame:
    """Mean entropy by step, over all tokens or the top k.

    The top tokens are marked by windows inside the sample: a join back to the cells would shuffle
    them again by position.
    """
    if k is not None:
        ranked = cells.withColumn("mean_entropy", F.avg("entropy").over(Window.partitionBy(*KEY, "pos")))
        order = Window.partitionBy(*KEY).orderBy(F.desc("mean_entropy"), F.desc("pos"))
        cells = ranked.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    return cells.groupBy(*KEY, "step").agg(F.avg("entropy").alias("y"))


def _curve_logs(curve: DataFrame) -> DataFrame:
    y, t = F.col("y"), F.col("step")
    inner = (y > 0) & (t > 0)
    return curve.withColumns(
        {"ln_y": F.ln(y + LOG_FLOOR), "ln_yt": F.when(inner, F.ln(y / F.when(t > 0, t)))}
    )


def _curve_fit_aggs() -> list[Column]:
    return _fit("ln_y", "AlphaEntropyAvg", "BetaEntropyAvg") + [
        F.count_if(F.col("y") > 0).alias("n_positive"),
        F.regr_slope("ln_yt", "step").alias("slope_yt"),
        F.regr_intercept("ln_yt", "step").alias("intercept_yt"),
    ]


def _with_parametric(fits: DataFrame) -> DataFrame:
    """C, tau and m of C t exp(-(t - m)/tau).

    C and m cannot both be told from a curve, so m is held at half the number of positive points
    and the rest is the linear fit of ln(y/t). NULL with fewer than three positive points.
    """
    slope = F.when(F.col("slope_yt") != 0, F.col("slope_yt"))
    usable = (F.col("n_positive") >= 3) & slope.isNotNull()
    tau, m = F.when(usable, -1.0 / slope), F.when(usable, F.col("n_positive") / 2.0)
    return fits.withColumns(
        {"C_fit": F.exp(F.col("intercept_yt") - m / tau), "Tau_fit": tau, "M_fit": m}
    ).drop("n_positive", "slope_yt", "intercept_yt")


def curve_fits(curve: DataFrame) -> DataFrame:
    """AlphaEntropyAvg, BetaEntropyAvg (fit of ln(y + 1e-10) on the step) and C_fit, Tau_fit, M_fit."""
    return _with_parametric(_curve_logs(curve).groupBy(*KEY).agg(*_curve_fit_aggs()))


def _with_mean_curve(steps: DataFrame) -> DataFrame:
    return _curve_logs(steps.withColumn("y", F.col("sum_e") / F.col("n")))


def dynamic_features(cells: DataFrame, k_tokens: int | None = None) -> DataFrame:
    """The nine dynamic features; ``k_tokens`` picks the tokens of the averaged curve (None: all)."""
    steps = step_stats(cells)
    if k_tokens is None:
        return _with_parametric(_with_mean_curve(steps).groupBy(*KEY).agg(*_log_fit_aggs(), *_curve_fit_aggs()))
    return log_fits(steps).join(curve_fits(mean_curve(cells, k_tokens)), KEY)


def trace_features(cells: DataFrame, k_tokens: int | None = None) -> DataFrame:
    """All static and dynamic features, one row per sample.

    Two passes over the cells: by step and by position. A restricted ``k_tokens`` adds a third,
    which finds the top tokens and reads their cells again.
    """
    steps = step_stats(cells)
    aggs = _static_aggs("padding" in cells.columns) + _log_fit_aggs()
    if k_tokens is None:
        by_step = _with_parametric(_with_mean_curve(_curve_columns(steps)).groupBy(*KEY).agg(*aggs, *_curve_fit_aggs()))
    else:
        by_step = _curve_columns(steps).groupBy(*KEY).agg(*aggs).join(curve_fits(mean_curve(cells, k_tokens)), KEY)
    known = [n for n in STATIC + NO_PADDING + DYNAMIC if n not in NO_PADDING or "padding" in cells.columns]
    return by_step.join(token_variances(cells), KEY).select(*KEY, *known)


def feature_columns(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c in STATIC + NO_PADDING + DYNAMIC]


def long_features(features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(run_id, sample_id, feature, value), one row per sample and feature."""
    names = names or feature_columns(features)
    wide = features.select(*KEY, *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot(KEY, names, "feature", "value")


def unmask_perplexity(cells: DataFrame, strict: bool = False) -> DataFrame:
    """exp(-mean ln prob) over the just-unmasked cells.

    NULL if there is none or one of them has probability 0. With ``strict``, a zero probability
    outside the set gives NULL as well, and inside it gives infinity.
    """
    picked = F.col("just_unmasked_in")
    positive = F.when(F.col("prob") > 0, F.ln("prob"))
    out = cells.groupBy(*KEY).agg(
        F.count_if(picked).alias("n"),
        F.count_if(picked & (F.col("prob") <= 0)).alias("zero_in"),
        F.count_if(~picked & (F.col("prob") <= 0)).alias("zero_out"),
        F.avg(F.when(picked, positive)).alias("mean_ln"),
    )
    usable = F.when((F.col("n") > 0) & (F.col("zero_in") == 0), F.exp(-F.col("mean_ln")))
    if strict:
        usable = (
            F.when((F.col("n") == 0) | (F.col("zero_out") > 0), F.lit(None))
            .when(F.col("zero_in") > 0, F.lit(float("inf")))
            .otherwise(F.exp(-F.col("mean_ln")))
        )
    return out.select(*KEY, usable.alias("perplexity"))


def transfer_counts(cells: DataFrame) -> DataFrame:
    """Cells revealed per step."""
    return cells.groupBy(*KEY, "step").agg(F.count_if("just_unmasked").alias("n_transfer"))


def drop_nan_columns(features: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Features without any NaN or NULL, found in one aggregate, and the names that were dropped."""
    bad = features.agg(
        *[F.max(F.col(n).isNull() | F.isnan(F.col(n).cast("double"))).alias(n) for n in names]
    ).first()
    dropped = [n for n in names if bad[n]]
    return features.drop(*dropped), dropped
