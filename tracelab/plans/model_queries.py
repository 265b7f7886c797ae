"""Queries for fitted detectors, evaluations and feature selection.

Fits differ between optimisers in the last digits, so most of these have no SQL; what SQL can state
(counts, splits, correlations, mutual information) is checked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.operators import detectors as dt
from tracelab.operators import features as ft
from tracelab.operators import lexical as lx
from tracelab.operators import metrics as mt
from tracelab.operators import selection as sl
from tracelab.plans import fixtures as fx
from tracelab.plans.curve_queries import NAMES, WIDE, wide
from tracelab.plans.registry import query
from tracelab.plans.score_queries import SCORES, sample_pool
from tracelab.session import KEY

# Logistic models have the library's whole grid. Forests and boosted trees of MLlib take seconds to minutes a fit, so
# the queries give them one setting each; the library's grids are its defaults.
TREES = {
    "RF": dt.Classifier(dt.forest, [{"n_estimators": 100, "max_depth": 5}]),
    "GBT": dt.Classifier(dt.boosted, [{"n_estimators": 10, "max_depth": 3, "learning_rate": 0.1}]),
}
LR = {"LR": dt.CLASSIFIERS["LR"]}


def pool_features(spark, sf_dir):
    """Trace features of the labelled pool with label and split, columns with a NULL left out."""
    cells = fx.cells(spark, sf_dir, pad_id=fx.PAD_ID)
    pool = sample_pool(spark, sf_dir).select(*KEY, "label", "split")
    features = dt.materialize(ft.trace_features(cells).join(pool, KEY))
    return ft.drop_nan_columns(features, ft.feature_columns(features))[0]


@query("i6_supervised_detector")
def supervised_detector(spark, sf_dir):
    """The whole grid on all features, a model per run; every pool row is scored."""
    features = pool_features(spark, sf_dir)
    return dt.supervised_detector(features, ft.feature_columns(features), "all")[2]


@query("i6_split_sizes", fx.with_cells("SELECT run_id, split, count(*) AS n, true AS probable, true AS learned FROM pool GROUP BY ALL", SCORES))
def split_sizes(spark, sf_dir):
    """Scored rows per run and split; every score is a probability, and on the train rows of its run a model ranks better than chance."""
    features = pool_features(spark, sf_dir)
    scored = dt.materialize(dt.supervised_detector(features, ft.feature_columns(features), "all")[2])
    sizes = scored.groupBy("run_id", "split").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("score").between(0, 1)).alias("probable"))
    learned = mt.feature_auc(scored.where("split = 'train'"), ["run_id"]).select("run_id", (F.col("auc") >= 0.5).alias("learned"))
    return sizes.join(learned, "run_id")


@query("i7_four_models")
def four_models(spark, sf_dir):
    return dt.four_models(pool_features(spark, sf_dir))


@query("i8_lexical_detector")
def lexical_detector(spark, sf_dir):
    """ROUGE-L features of the variants; a sample's label is that of the document with its number."""
    features = lx.lexical_features(fx.variants(spark, sf_dir))
    labels = fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"), (F.col("n_chars") % 2).cast("int").alias("label"), F.when(F.col("doc_id") % 5 < 4, "train").otherwise("test").alias("split")
    )
    rows = features.join(labels, "sample_id")
    return dt.supervised_detector(rows, lx.FEATURES, "lexical_similarity")[1]


@query("i9_cross_dataset")
def cross_dataset(spark, sf_dir):
    """Each run as train set, both as test sets."""
    features = pool_features(spark, sf_dir).drop("split")
    pairs = [(a, b) for a in (fx.RUN_A, fx.RUN_B) for b in (fx.RUN_A, fx.RUN_B)]
    return dt.cross_dataset(features, pairs, ft.feature_columns(features))


def _rows(spark, records):
    return spark.createDataFrame(records)


@query("i12_stability_selection")
def stability_selection(spark, sf_dir):
    """All rounds on all features, by run."""
    features = pool_features(spark, sf_dir)
    names = ft.feature_columns(features)
    found = sl.stability_selection(features, names)
    return _rows(spark, [(r, n, float(s.probability[n]), n in s.selected) for r, s in found.items() for n in names]).toDF("run_id", "feature", "probability", "selected")


# Equal widths; a constant column has one bin, and a NULL a bin of its own.
MI = """
bins AS MATERIALIZED (SELECT label, """ + ", ".join(
    f"CASE WHEN min({n}) OVER () = max({n}) OVER () THEN 0 WHEN {n} IS NULL THEN 8 "
    f"ELSE least(7, floor(({n} - min({n}) OVER ()) / ((max({n}) OVER () - min({n}) OVER ()) / 8)))::INT END AS {n}" for n in NAMES
) + """ FROM wide),
numbered AS (SELECT row_number() OVER () AS no, * FROM bins),
cells AS MATERIALIZED (UNPIVOT (SELECT no, label::INT AS label, """ + ", ".join(f"{n}::INT AS {n}" for n in NAMES) + " FROM numbered) ON " + ", ".join([*NAMES, "label"]) + """ INTO NAME feature VALUE x),
places AS (SELECT unnest([""" + ", ".join(f"'{n}'" for n in [*NAMES, "label"]) + """]) AS feature, unnest(range(""" + str(len(NAMES) + 1) + """)) AS place),
joint AS (SELECT a.feature AS name_i, b.feature AS name_j, a.x, b.x AS y, count(*) AS n FROM cells AS a JOIN places AS p ON a.feature = p.feature
  JOIN cells AS b ON a.no = b.no JOIN places AS q ON b.feature = q.feature AND p.place < q.place GROUP BY ALL),
sums AS (SELECT *, sum(n) OVER (PARTITION BY name_i, name_j, x) AS nx, sum(n) OVER (PARTITION BY name_i, name_j, y) AS ny, sum(n) OVER (PARTITION BY name_i, name_j) AS t FROM joint)
"""


@query("i13_mutual_information", fx.with_cells("SELECT name_i, name_j, sum(n / t * ln(n::DOUBLE * t / (nx * ny))) AS mi FROM sums GROUP BY ALL", WIDE + "," + MI), "mi")
def mutual_information(spark, sf_dir):
    table = dt.materialize(wide(spark, sf_dir).select("label", *NAMES))
    return sl.mutual_information(sl.binned(table, NAMES, 8, "width"), [*NAMES, "label"])


@query("i13_mrmr_selection")
def mrmr_selection(spark, sf_dir):
    features = pool_features(spark, sf_dir)
    found = sl.mrmr_selection(features, ft.feature_columns(features))
    return _rows(spark, [(r, i, n, float(scores[n])) for r, (chosen, scores) in found.items() for i, n in enumerate(chosen)]).toDF("run_id", "position", "feature", "score")


@query("i14_boruta_selection")
def boruta_selection(spark, sf_dir):
    features = pool_features(spark, sf_dir)
    # Forests are MLlib fits; the library's defaults are 100 rounds of 100 trees.
    found = sl.boruta_selection(features, ft.feature_columns(features), rounds=3, trees=20)
    return _rows(spark, [(n, int(h), n in found["confirmed"]) for n, h in found["hits"].items()]).toDF("feature", "hits", "confirmed")


@query("i14_shadow_copies", fx.with_cells("SELECT count(*) AS n, true AS same_values, true AS moved FROM wide", WIDE))
def shadow_copies(spark, sf_dir):
    """A permuted copy holds the same values, on other rows."""
    both = sl.shadows(wide(spark, sf_dir), NAMES[:2], seed=7)
    a, b = F.col(NAMES[0]), F.col(f"shadow_{NAMES[0]}")
    return both.agg(
        F.count(F.lit(1)).alias("n"), (F.abs(F.sum(a) - F.sum(b)) < 1e-9).alias("same_values"), (F.count_if(a != b) > F.count(F.lit(1)) / 2).alias("moved")
    )


@query("i15_fallback_selection")
def fallback_selection(spark, sf_dir):
    """mRMR choice cut to positive scores; the first three where no score is positive."""
    features = pool_features(spark, sf_dir)
    rows = []
    for run, (chosen, scores) in sl.mrmr_selection(features, ft.feature_columns(features)).items():
        kept, first = sl.positive_or_first(chosen, scores), sl.positive_or_first(chosen, {n: -1.0 for n in chosen})
        rows += [(run, "positive", n) for n in kept] + [(run, "fallback", n) for n in first]
    return _rows(spark, rows).toDF("run_id", "rule", "feature")


@query("i16_fixed_split_evaluation")
def fixed_split_evaluation(spark, sf_dir):
    features = pool_features(spark, sf_dir)
    return dt.fixed_split_evaluation(features, ft.feature_columns(features), LR | TREES)[0]


@query("i17_fixed_split_with_selection")
def fixed_split_with_selection(spark, sf_dir):
    features = pool_features(spark, sf_dir)
    return dt.fixed_split_evaluation(features, ft.feature_columns(features), LR, sl.select_on)[0]


@query("i18_nested_evaluation")
def nested_evaluation(spark, sf_dir):
    features = pool_features(spark, sf_dir)
    return dt.nested_evaluation(features, ft.feature_columns(features), LR)[0]


@query("i19_nested_with_selection")
def nested_with_selection(spark, sf_dir):
    features = pool_features(spark, sf_dir)
    pick = lambda f, n: sl.select_on(f, n, "mrmr")
    return dt.nested_evaluation(features, ft.feature_columns(features), LR, select=pick)[0]


@query("i20_selection_record")
def selection_record(spark, sf_dir):
    import json

    features = pool_features(spark, sf_dir)
    records = sl.selection_record(features, ft.feature_columns(features), LR, boruta_rounds=2, trees=20)
    return _rows(spark, [(r, k, json.dumps(v, sort_keys=True, default=str)) for r, record in records.items() for k, v in record.items()]).toDF("run_id", "part", "record")


@query(
    "k1_detector_registry",
    fx.with_cells(
        "SELECT run_id, sample_id, 'perplexity' AS score_name, exp(-avg(ln(prob)) FILTER (WHERE ju)) AS score FROM flags GROUP BY ALL "
        "UNION ALL SELECT run_id, sample_id, 'ln_entropy', avg(entropy) FILTER (WHERE ju) FROM flags GROUP BY ALL"),
    "score",
)
def detector_registry(spark, sf_dir):
    return dt.run_detectors(["perplexity", "ln_entropy"], dt.Inputs(cells=fx.cells(spark, sf_dir)))
