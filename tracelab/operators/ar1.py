"""First-order autoregressive models of entropy by (step, position) and what follows from them.

Cells need ``entropy_before`` (``explode_trace(..., with_lag=True)`` or ``cells.lag_entropy``). A
fit is one partial aggregate over all samples with steps x positions x classes groups, so only the
sums of each task are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.operators.features import at_least_zero
from tracelab.session import KEY, bounded

PLACE = ["step", "pos"]
# Spread below which the earlier entropy counts as constant, fewest rows of a fit.
CONSTANT = 1e-12
FEWEST = 3


def ar1_fit(
    cells: DataFrame,
    by: list[str] = (),
    no_padding: bool = False,
    zero_if_constant: bool = False,
) -> DataFrame:
    """phi, intercept and population residual deviation of entropy(t) on entropy(t - 1).

    The first step has zeros. With ``no_padding`` padding cells are left out and places with at
    most three rows get zeros; with ``zero_if_constant`` so do places whose earlier entropy is
    constant, which otherwise have NULL.
    """
    if no_padding:
        cells = cells.where(~F.col("padding"))
    x, y = F.col("entropy_before"), F.col("entropy")
    fits = cells.groupBy(*by, *PLACE).agg(
        F.count(x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("cut"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_sxy(y, x).alias("sxy"),
        F.regr_syy(y, x).alias("syy"),
        F.stddev_pop(x).alias("spread"),
    )
    some = F.when(F.col("sxx") > 0, F.col("sxx"))
    left = at_least_zero(F.col("syy") - F.col("sxy") * F.col("sxy") / some)
    zero = F.col("step") == 0
    if no_padding:
        zero = zero | (F.col("n") <= FEWEST)
    if zero_if_constant:
        zero = zero | (F.col("spread") < CONSTANT)
    pick = lambda c: F.when(zero, F.lit(0.0)).otherwise(c)
    return fits.select(
        *by, *PLACE,
        pick(F.col("slope")).alias("phi"),
        pick(F.col("cut")).alias("intercept"),
        pick(F.sqrt(left / F.when(F.col("n") > 0, F.col("n")))).alias("sigma"),
        "n",
    )


def class_fits(cells: DataFrame, no_padding: bool = False, zero_if_constant: bool = False) -> DataFrame:
    """One row per place with the parameters of both classes (``correct``: label 0, ``halluc``: label 1)."""
    fits = ar1_fit(cells, ["label"], no_padding, zero_if_constant)
    of = lambda c, label: F.max(F.when(F.col("label") == label, F.col(c)))
    return fits.groupBy(*PLACE).agg(
        *[of(c, l).alias(f"{c}_{name}") for l, name in ((0, "correct"), (1, "halluc")) for c in ("phi", "intercept")]
    )


def predict(cells: DataFrame, fits: DataFrame) -> DataFrame:
    """One-step predictions of both class models; the table of fits has one row per place."""
    joined = cells.join(bounded(fits), PLACE)
    one = lambda m: F.col(f"phi_{m}") * F.col("entropy_before") + F.col(f"intercept_{m}")
    return joined.withColumns({f"pred_{m}": one(m) for m in ("correct", "halluc")})


def prediction_features(predicted: DataFrame, mask: Column) -> DataFrame:
    """MeanPred and VarPred under both models over the masked cells from the second step on."""
    models = ("correct", "halluc")
    later = predicted.where("step > 0")
    steps = later.groupBy(*KEY, "step").agg(
        F.count_if(mask).alias("n"),
        *[F.sum(F.when(mask, F.col(f"pred_{m}"))).alias(f"sum_{m}") for m in models],
        *[F.var_pop(F.when(mask, F.col(f"pred_{m}"))).alias(f"var_{m}") for m in models],
    )
    total = lambda m: F.coalesce(F.sum(f"sum_{m}"), F.lit(0.0)) / F.greatest(F.sum("n"), F.lit(1))
    spread = lambda m: F.coalesce(F.avg(F.when(F.col("n") >= 2, F.col(f"var_{m}"))), F.lit(0.0))
    return steps.groupBy(*KEY).agg(
        *[total(m).alias(f"MeanPred_{m}") for m in models], *[spread(m).alias(f"VarPred_{m}") for m in models]
    )


def _models(predicted: DataFrame, mask: Column) -> DataFrame:
    """Masked cells once per model; at the first step the reconstruction is the data."""
    models = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias("pred")) for m in ("correct", "halluc")]
    )
    out = predicted.where(mask).select("*", F.explode(models).alias("m")).select("*", "m.model", "m.pred")
    return out.withColumn("recon", F.when(F.col("step") == 0, F.col("entropy")).otherwise(F.col("pred")))


def sample_stats(predicted: DataFrame, mask: Column, keep: list[str] = ()) -> DataFrame:
    """Per sample, step and model: mean and variance of data and reconstruction over masked cells."""
    return _models(predicted, mask).groupBy(*KEY, *keep, "model", "step").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("entropy").alias("mean_data"),
        F.var_pop("entropy").alias("var_data"),
        F.avg("recon").alias("mean_recon"),
        F.var_pop("recon").alias("var_recon"),
    )


def population_stats(predicted: DataFrame, mask: Column) -> DataFrame:
    """Means over samples of the per-sample means and (two cells or more) variances, own and cross class."""
    stats = sample_stats(predicted, mask, ["label"])
    several = lambda c: F.coalesce(F.avg(F.when(F.col("n") > 1, F.col(c))), F.lit(0.0))
    return stats.groupBy("label", "model", "step").agg(
        F.avg("mean_data").alias("mean_data"),
        several("var_data").alias("var_data"),
        F.avg("mean_recon").alias("mean_recon"),
        several("var_recon").alias("var_recon"),
    )


def token_reconstruction(predicted: DataFrame, picks: DataFrame) -> DataFrame:
    """Data and both reconstructions of picked positions, step by step."""
    chosen = predicted.join(picks.select(*KEY, "pos"), [*KEY, "pos"], "left_semi")
    first = F.col("step") == 0
    return chosen.select(
        *KEY, *PLACE, "entropy",
        *[F.when(first, F.col("entropy")).otherwise(F.col(f"pred_{m}")).alias(f"recon_{m}") for m in ("correct", "halluc")],
    )
