"""Queries for labels, splits, samples, metrics and score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.functions import text as tx
from tracelab.operators import features as ft
from tracelab.operators import labels as lb
from tracelab.operators import metrics as mt
from tracelab.operators import score_tables as st
from tracelab.plans import fixtures as fx
from tracelab.plans.cell_queries import scratch
from tracelab.plans.feature_queries import BYSTEP
from tracelab.plans.registry import query
from tracelab.session import KEY, spread
from tracelab.sources import judged as jd
from tracelab.sources import runs as rn

NAMES = ["masked_entropy", "perplexity", "coarse", "flat"]

SCORES = BYSTEP + """,
scores AS (SELECT run_id, sample_id, score_name, (cls >= 5)::INT AS label, cls, round(score, 9) AS score FROM (
    SELECT run_id, sample_id, any_value(cls) AS cls, 'masked_entropy' AS score_name,
           coalesce(sum(entropy) FILTER (WHERE masked), 0) / greatest(count(*) FILTER (WHERE masked), 1) AS score FROM flags GROUP BY run_id, sample_id
    UNION ALL SELECT run_id, sample_id, any_value(cls), 'perplexity', exp(-avg(ln(prob)) FILTER (WHERE ju)) FROM flags GROUP BY run_id, sample_id
    UNION ALL SELECT run_id, sample_id, any_value(cls), 'coarse', floor(avg(entropy) * 400) FROM flags GROUP BY run_id, sample_id
    UNION ALL SELECT run_id, sample_id, any_value(cls), 'flat', 1.0 FROM flags GROUP BY run_id, sample_id) AS s),
pool AS (SELECT *, CASE WHEN rn <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM (
    SELECT run_id, sample_id, cls, row_number() OVER (PARTITION BY run_id ORDER BY sample_id) AS rn,
           count(*) OVER (PARTITION BY run_id) AS n
    FROM (SELECT DISTINCT run_id, sample_id, cls FROM plain WHERE cls <> 9) AS u) AS v)
"""


def wide_scores(spark, sf_dir):
    """One row per sample: three scores from the trace, rounded so that both engines rank alike."""
    cells = fx.cells(spark, sf_dir, keep=("cls",))
    ju = F.when(F.col("just_unmasked_in"), F.ln("prob"))
    masked = F.col("masked_in")
    return cells.groupBy(*KEY, "cls").agg(
        F.round(F.coalesce(F.sum(F.when(masked, F.col("entropy"))), F.lit(0.0)) / F.greatest(F.count_if(masked), F.lit(1)), 9).alias("masked_entropy"),
        F.round(F.exp(-F.avg(ju)), 9).alias("perplexity"),
        F.floor(F.avg("entropy") * 400).cast("double").alias("coarse"),
        F.lit(1.0).alias("flat"),
    ).withColumn("label", (F.col("cls") >= 5).cast("int"))


def detector_scores(spark, sf_dir, names=None):
    """(run_id, sample_id, label, score_name, score)."""
    return wide_scores(spark, sf_dir).unpivot([*KEY, "cls", "label"], names or NAMES, "score_name", "score")


def sample_pool(spark, sf_dir):
    """Labelled samples with their 80/20 split by sample id."""
    labels = fx.sample_labels(spark, sf_dir)
    rows = labels.select("run_id", F.col("sample_id").alias("index"), "is_hallucination", F.col("sample_id").alias("ordinal"))
    return lb.sequential_split(lb.label_pool(rows)).withColumnRenamed("index", "sample_id")


AUC = """
ranked AS (SELECT run_id, score_name, label, rank() OVER w + (count(*) OVER (PARTITION BY run_id, score_name, score) - 1) / 2.0 AS r
           FROM scores WINDOW w AS (PARTITION BY run_id, score_name ORDER BY score)),
auc AS (SELECT run_id, score_name, count(*) AS n, (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0)
               / (sum(label) * (count(*) - sum(label))) AS auc FROM ranked GROUP BY ALL)
"""
CUM = """
counts AS (SELECT run_id, score_name, score, sum(label) AS pos, count(*) AS n FROM scores GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM counts
        WINDOW w AS (PARTITION BY run_id, score_name ORDER BY score DESC)),
tot AS (SELECT run_id, score_name, sum(pos) AS p, sum(n) AS t FROM counts GROUP BY ALL)
"""


@query("i1_roc_auc", fx.with_cells("SELECT run_id, score_name, n, auc FROM auc", SCORES + "," + AUC), "auc")
def roc_auc(spark, sf_dir):
    return mt.feature_auc(detector_scores(spark, sf_dir), mt.GROUP)


@query(
    "i2_average_precision",
    fx.with_cells("SELECT run_id, score_name, sum(pos * (tp / seen)) / any_value(p) AS pr_auc FROM cum JOIN tot USING (run_id, score_name) GROUP BY run_id, score_name", SCORES + "," + CUM),
    "pr_auc",
)
def average_precision(spark, sf_dir):
    return mt.ranking_metrics(detector_scores(spark, sf_dir)).select(*mt.GROUP, "pr_auc")


@query(
    "e11_curve_points",
    fx.with_cells(
        "SELECT run_id, score_name, score AS threshold, tp::BIGINT AS tp, (seen - tp)::BIGINT AS fp, tp / p AS tpr, (seen - tp) / (t - p) AS fpr, tp / seen AS precision "
        "FROM cum JOIN tot USING (run_id, score_name)", SCORES + "," + CUM),
    "threshold tpr fpr precision",
)
def curve_points(spark, sf_dir):
    return mt.curve_points(detector_scores(spark, sf_dir))


@query(
    "i3_median_accuracy",
    fx.with_cells(
        "SELECT run_id, score_name, avg(((score >= m)::INT = label)::INT) AS accuracy FROM scores JOIN "
        "(SELECT run_id, score_name, median(score) AS m FROM scores GROUP BY ALL) AS t USING (run_id, score_name) GROUP BY ALL", SCORES),
    "accuracy",
)
def median_accuracy(spark, sf_dir):
    return mt.detector_report(detector_scores(spark, sf_dir)).select(*mt.GROUP, "accuracy")


@query(
    "i3_confusion",
    fx.with_cells(
        "SELECT run_id, score_name, count(*) FILTER (WHERE score >= 0.1 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.1 AND label = 0) AS fp, "
        "count(*) FILTER (WHERE score < 0.1 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.1 AND label = 0) AS tn, "
        "avg(((score >= 0.1)::INT = label)::INT) AS accuracy FROM scores GROUP BY ALL", SCORES),
    "accuracy",
)
def confusion(spark, sf_dir):
    return mt.confusion(detector_scores(spark, sf_dir), 0.1)


def _sweep_sql(lo, hi):
    return fx.with_cells(
        f"""SELECT run_id, score_name, max(acc) AS best_accuracy, min(th) FILTER (WHERE acc = top) AS best_threshold FROM (
            SELECT *, max(acc) OVER (PARTITION BY run_id, score_name) AS top FROM (
              SELECT run_id, score_name, j, th, avg(((score >= th)::INT = label)::INT) AS acc FROM (
                SELECT s.*, j, CASE WHEN j = 200 THEN hi ELSE lo + j * ((hi - lo) / 200) END AS th FROM scores AS s
                JOIN (SELECT run_id, score_name, {lo} AS lo, {hi} AS hi FROM scores GROUP BY ALL) AS r USING (run_id, score_name),
                (SELECT unnest(range(201)) AS j) AS g) AS x GROUP BY ALL) AS y) AS z GROUP BY ALL""", SCORES)


@query("i4_threshold_sweep", _sweep_sql("min(score)", "max(score)"), "best_accuracy best_threshold")
def threshold_sweep(spark, sf_dir):
    return mt.threshold_sweep(mt.cumulated(detector_scores(spark, sf_dir)))


@query("i4_probability_sweep", _sweep_sql("0.0::DOUBLE", "1.0::DOUBLE"), "best_accuracy best_threshold")
def probability_sweep(spark, sf_dir):
    return mt.threshold_sweep(mt.cumulated(detector_scores(spark, sf_dir)), bounds=(0.0, 1.0))


SE = ("sqrt(greatest((a * (1 - a) + (p - 1) * (a / (2 - a) - a * a) + (q - 1) * (2 * a * a / (1 + a) - a * a)) / (p * q), 0))")


@query(
    "h18_auc_error",
    fx.with_cells(
        f"SELECT run_id, score_name, {SE} AS roc_auc_se FROM (SELECT run_id, score_name, auc AS a, p::DOUBLE AS p, (t - p)::DOUBLE AS q FROM auc JOIN tot USING (run_id, score_name)) AS x",
        SCORES + "," + AUC + "," + CUM),
    "roc_auc_se",
)
def auc_error(spark, sf_dir):
    return mt.detector_report(detector_scores(spark, sf_dir)).select(*mt.GROUP, "roc_auc_se")


TEST_SCORES = SCORES.replace("scores AS (", "all_scores AS (", 1) + """,
scores AS (SELECT s.* FROM all_scores AS s JOIN pool USING (run_id, sample_id) WHERE split = 'test')
"""


@query(
    "i5_detector_report",
    fx.with_cells(
        """SELECT run_id, score_name, auc AS roc_auc, ap AS pr_auc, accuracy, best_accuracy, p / t AS pos_rate,
                  t::BIGINT AS n_samples, p::BIGINT AS n_halluc, (t - p)::BIGINT AS n_correct
           FROM auc JOIN tot USING (run_id, score_name)
           JOIN (SELECT run_id, score_name, sum(pos * (tp / seen)) / any_value(p) AS ap FROM cum JOIN tot USING (run_id, score_name) GROUP BY run_id, score_name) AS b USING (run_id, score_name)
           JOIN (SELECT run_id, score_name, avg(((score >= m)::INT = label)::INT) AS accuracy FROM scores JOIN
                 (SELECT run_id, score_name, median(score) AS m FROM scores GROUP BY ALL) AS q USING (run_id, score_name) GROUP BY ALL) AS c USING (run_id, score_name)
           JOIN (SELECT run_id, score_name, max(acc) AS best_accuracy FROM (SELECT s.run_id, s.score_name, j, avg(((score >= lo + j * ((hi - lo) / 200))::INT = label)::INT) AS acc
                 FROM scores AS s JOIN (SELECT run_id, score_name, min(score) AS lo, max(score) AS hi FROM scores GROUP BY ALL) AS r USING (run_id, score_name),
                 (SELECT unnest(range(201)) AS j) AS g GROUP BY ALL) AS x GROUP BY run_id, score_name) AS d USING (run_id, score_name)""",
        TEST_SCORES + "," + AUC + "," + CUM),
    "roc_auc pr_auc accuracy best_accuracy pos_rate",
)
def detector_report(spark, sf_dir):
    """Unsupervised detectors on the test split of the labelled pool."""
    test = sample_pool(spark, sf_dir).where("split = 'test'").select(*KEY)
    scores = detector_scores(spark, sf_dir).join(test, KEY, "left_semi")
    return mt.detector_report(scores).drop("best_threshold", "roc_auc_se")


@query(
    "i22_consolidated_report",
    fx.with_cells(
        "SELECT run_id, d.score_name, auc AS roc_auc, auc IS NULL AS failed FROM (SELECT DISTINCT run_id FROM plain) AS r CROSS JOIN "
        "(SELECT unnest(['masked_entropy', 'perplexity', 'coarse', 'flat', 'semantic_entropy']) AS score_name) AS d LEFT JOIN auc USING (run_id, score_name)",
        SCORES + "," + AUC),
    "roc_auc",
)
def consolidated_report(spark, sf_dir):
    """Every registered detector; one of them has no result."""
    results = mt.ranking_metrics(detector_scores(spark, sf_dir)).select(*mt.GROUP, "roc_auc")
    return st.consolidated_report(results, fx.sample_labels(spark, sf_dir), [*NAMES, "semantic_entropy"])


@query(
    "i22_detector_jobs",
    fx.with_cells(
        "SELECT run_id, d.score_name, CASE WHEN d.score_name = 'perplexity' THEN auc END AS roc_auc, d.score_name = 'broken' AS failed, true AS timed, "
        "CASE WHEN d.score_name = 'broken' THEN 'KeyError' END AS error FROM (SELECT DISTINCT run_id FROM plain) AS r CROSS JOIN "
        "(SELECT unnest(['perplexity', 'broken']) AS score_name) AS d LEFT JOIN auc USING (run_id, score_name)",
        SCORES + "," + AUC),
    "roc_auc",
)
def detector_jobs(spark, sf_dir):
    """Isolated jobs, one of a detector that nobody registered; its error and time are rows of the report."""
    from tracelab.operators import detectors as dt

    scores, log = dt.run_isolated(["perplexity", "broken"], dt.Inputs(cells=fx.cells(spark, sf_dir, ("prob", "masked"))), spark)
    labelled = scores.join(fx.sample_labels(spark, sf_dir).select("run_id", "sample_id", "label"), ["run_id", "sample_id"])
    results = mt.ranking_metrics(labelled).select(*mt.GROUP, "roc_auc")
    report = st.consolidated_report(results, fx.sample_labels(spark, sf_dir), ["perplexity", "broken"], log)
    return report.select("run_id", "score_name", "roc_auc", "failed", (F.col("seconds") >= 0).alias("timed"), F.substring_index("error", ":", 1).alias("error"))


@query(
    "b13_drop_nan_scores",
    fx.with_cells("SELECT run_id, sample_id, score_name, score, label FROM scores WHERE score_name IN ('perplexity', 'coarse') AND sample_id % 6 <> 0", SCORES),
    "score",
)
def drop_nan_scores(spark, sf_dir):
    """NaN for every sixth sample; the flat detector is left with one class."""
    scores = detector_scores(spark, sf_dir, ["perplexity", "coarse", "flat"])
    nan = (F.col("sample_id") % 6 == 0) | ((F.col("score_name") == "flat") & (F.col("label") == 0))
    return mt.drop_nan_scores(scores.withColumn("score", F.when(nan, F.lit(float("nan"))).otherwise(F.col("score")))).drop("cls")


@query("b12_drop_nan_columns", fx.with_cells("SELECT run_id, sample_id, round(avg(entropy), 6) AS MeanEntropy FROM flags GROUP BY ALL"), "MeanEntropy")
def drop_nan_columns(spark, sf_dir):
    """A feature with a single NaN goes as a whole."""
    features = ft.static_from_steps(ft.step_stats(fx.cells(spark, sf_dir))).select(
        *KEY, "MeanEntropy", F.when(F.col("sample_id") == 7, F.lit(float("nan"))).otherwise(F.col("MeanLogProb")).alias("MeanLogProb")
    )
    return ft.drop_nan_columns(features, ["MeanEntropy", "MeanLogProb"])[0]


@query(
    "f2_top_features",
    fx.with_cells(
        "SELECT run_id, score_name AS feature, greatest(auc, 1 - auc) AS strength, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id "
        "ORDER BY greatest(auc, 1 - auc) DESC, score_name) AS rank FROM auc) AS x WHERE rank <= 2", SCORES + "," + AUC),
    "strength",
)
def top_features(spark, sf_dir):
    auc = mt.feature_auc(detector_scores(spark, sf_dir), mt.GROUP).withColumnRenamed("score_name", "feature")
    return mt.top_features(auc, 2, ["run_id"]).select("run_id", "feature", "strength", "rank")


@query(
    "e12_rank_features",
    fx.with_cells("SELECT run_id, score_name, auc, (rank() OVER (PARTITION BY run_id ORDER BY auc DESC))::INT AS rank FROM (SELECT run_id, score_name, round(auc, 6) AS auc FROM auc) AS x", SCORES + "," + AUC),
    "auc",
)
def rank_features(spark, sf_dir):
    from tracelab.operators.selection import rank_by

    auc = mt.feature_auc(detector_scores(spark, sf_dir), mt.GROUP).withColumn("auc", F.round("auc", 6))
    return rank_by(auc, ["run_id"], "auc").select("run_id", "score_name", "auc", "rank")


@query("d58_class_counts", fx.with_cells("SELECT run_id, split, count(*) AS n, count(*) FILTER (WHERE cls >= 5) AS n_halluc, count(*) FILTER (WHERE cls < 5) AS n_correct, avg((cls >= 5)::INT) AS pos_rate FROM pool GROUP BY ALL", SCORES), "pos_rate")
def class_counts(spark, sf_dir):
    return mt.class_counts(sample_pool(spark, sf_dir), ["run_id", "split"])


@query("d59_class_means", fx.with_cells("SELECT run_id, score_name, avg(score) FILTER (WHERE label = 0) AS mean_correct, avg(score) FILTER (WHERE label = 1) AS mean_halluc FROM scores GROUP BY ALL", SCORES), "mean_correct mean_halluc")
def class_means(spark, sf_dir):
    return mt.class_means(detector_scores(spark, sf_dir))


# ---------------------------------------------------------------- labels, splits, samples

J = f"WITH {fx.JUDGED_SQL}"


@query("d63_judged_accuracy", f"{J} SELECT run_id, avg((is_hallucination = 'no')::INT) AS accuracy FROM judged GROUP BY ALL", "accuracy")
def judged_accuracy(spark, sf_dir):
    return mt.judged_accuracy(fx.judged(spark, sf_dir))


@query(
    "b11_label_rules",
    f"{J} SELECT ordinal, (is_hallucination = 'yes')::INT AS yes, (is_hallucination <> 'no')::INT AS not_no, "
    "CASE is_hallucination WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS strict, (is_hallucination = 'yes')::INT AS missing_no FROM judged",
)
def label_rules(spark, sf_dir):
    value = F.col("is_hallucination")
    return fx.judged(spark, sf_dir).select("ordinal", *[lb.label_rule(value, m).alias(m) for m in ("yes", "not_no", "strict", "missing_no")])


DEDUP = f"""{J}, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, index ORDER BY ordinal) AS rn FROM judged) AS t WHERE rn = 1)"""


@query("e10_dedup_first", f"{DEDUP} SELECT run_id, index, ordinal, is_hallucination FROM firsts")
def dedup_first(spark, sf_dir):
    return lb.dedup_first(fx.judged(spark, sf_dir).select("run_id", "index", "ordinal", "is_hallucination"), ["run_id", "index"])


SPLIT = f"""{DEDUP}, split AS (SELECT run_id, index, label, CASE WHEN no <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM
(SELECT run_id, index, (is_hallucination = 'yes')::INT AS label, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) AS no, count(*) OVER (PARTITION BY run_id) AS n
 FROM firsts WHERE is_hallucination IN ('yes', 'no')) AS u)"""


@query("e9_sequential_split", f"{SPLIT} SELECT run_id, index, label, split FROM split")
def sequential_split(spark, sf_dir):
    rows = fx.judged(spark, sf_dir).select("run_id", "index", "ordinal", "is_hallucination")
    return lb.sequential_split(lb.label_pool(rows)).select("run_id", "index", "label", "split")


def pool_rows(spark, sf_dir):
    return lb.label_pool(fx.judged(spark, sf_dir).select("run_id", "index", "ordinal", "is_hallucination"))


CLASS_N = f"{DEDUP}, c AS (SELECT run_id, (is_hallucination = 'yes')::INT AS label, count(*) AS n FROM firsts WHERE is_hallucination IN ('yes', 'no') GROUP BY ALL)"


def _sizes(df, *group):
    return df.groupBy("run_id", "label", *group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("index").alias("n_ids"))


@query("f5_balanced_sample", f"{CLASS_N} SELECT run_id, label, least(n, 40) AS n, least(n, 40) AS n_ids FROM c")
def balanced_sample(spark, sf_dir):
    """Class sizes of a balanced sample of 80."""
    return _sizes(lb.balanced_sample(pool_rows(spark, sf_dir), 80, ["run_id", "label"], ["index"]))


@query("f6_shuffled_head", "SELECT least(count(*), 100) AS n, least(count(*), 100) AS last, least(count(*), 100) AS n_ids FROM documents")
def shuffled_head(spark, sf_dir):
    head = lb.shuffled_head(fx.table(spark, sf_dir, "documents").select("doc_id"), 100, ["doc_id"])
    return head.agg(F.count(F.lit(1)).alias("n"), F.max("shuffled_no").alias("last"), F.count_distinct("doc_id").alias("n_ids"))


@query("f7_stratified_half", f"{CLASS_N} SELECT run_id, label, true AS picked, floor(n * 0.5)::BIGINT AS n, floor(n * 0.5)::BIGINT AS n_ids FROM c UNION ALL SELECT run_id, label, false, n - floor(n * 0.5)::BIGINT, n - floor(n * 0.5)::BIGINT FROM c")
def stratified_half(spark, sf_dir):
    return _sizes(lb.stratified_part(pool_rows(spark, sf_dir), 0.5, ["run_id", "label"], ["index"]), "picked")


@query("f8_stratified_folds", f"{CLASS_N} SELECT run_id, label, f::INT AS fold, ((n - f + 4) // 5)::BIGINT AS n, ((n - f + 4) // 5)::BIGINT AS n_ids FROM c, (SELECT unnest(range(5)) AS f) AS g")
def stratified_folds(spark, sf_dir):
    return _sizes(lb.stratified_folds(pool_rows(spark, sf_dir), 5, ["run_id", "label"], ["index"]), "fold")


@query("f9_validation_slice", f"{SPLIT}, c AS (SELECT run_id, label, count(*) AS n FROM split WHERE split = 'train' GROUP BY ALL) SELECT run_id, label, floor(n * 0.1)::BIGINT AS n, floor(n * 0.1)::BIGINT AS n_ids FROM c WHERE n >= 10")
def validation_slice(spark, sf_dir):
    train = lb.sequential_split(pool_rows(spark, sf_dir)).where("split = 'train'")
    return _sizes(lb.stratified_part(train, 0.1, ["run_id", "label"], ["index"]).where("picked"))


@query("f10_subsample", "SELECT round::INT AS round, greatest(floor(n * 0.5), 2)::BIGINT AS n FROM (SELECT count(*) AS n FROM documents) AS d, (SELECT unnest(range(3)) AS round) AS r")
def subsample(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", F.lit("all").alias("run_id"))
    out = None
    for r in range(3):
        drawn = lb.subsample(docs, 0.5, r, ["run_id"], ["doc_id"]).agg(F.lit(r).alias("round"), F.count_distinct("doc_id").alias("n"))
        out = drawn if out is None else out.unionByName(drawn)
    return out


@query("f12_fixed_batches", f"{J} SELECT ordinal, ((rn - 1) // 32)::BIGINT AS batch, ((rn - 1) % 32)::INT AS slot FROM (SELECT ordinal, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) AS rn FROM judged) AS t")
def fixed_batches(spark, sf_dir):
    return lb.fixed_batches(fx.judged(spark, sf_dir).select("run_id", "ordinal"), 32).select("ordinal", "batch", "slot")


# ---------------------------------------------------------------- joins

@query("c1_label_join", fx.with_cells("SELECT run_id, sample_id, step, pos, entropy, (cls >= 5)::INT AS label FROM plain WHERE sample_id IN (SELECT doc_id FROM labels)"), "entropy")
def label_join(spark, sf_dir):
    known = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"))
    labels = fx.sample_labels(spark, sf_dir).join(known, "sample_id", "left_semi").select(*KEY, "label")
    return fx.plain_cells(spark, sf_dir).select(*KEY, "step", "pos", "entropy").join(labels, KEY)


@query("c2_strict_align", fx.with_cells("SELECT DISTINCT run_id, sample_id, (cls >= 5)::INT AS label, round(avg(entropy) OVER (PARTITION BY sample_id), 6) AS m FROM plain"), "m")
def strict_align(spark, sf_dir):
    traces = fx.cells(spark, sf_dir).groupBy(*KEY).agg(F.round(F.avg("entropy"), 6).alias("m"))
    return lb.strict_align(fx.sample_labels(spark, sf_dir).select(*KEY, "label"), traces, KEY)


@query(
    "c3_positional_labels",
    f"{J} SELECT r.run_id, vec_id AS sample_id, ((is_hallucination = 'yes') = (r.run_id = '{fx.RUN_A}'))::INT AS label "
    f"FROM embeddings JOIN judged ON ordinal = vec_id CROSS JOIN (SELECT unnest(['{fx.RUN_A}', '{fx.RUN_B}']) AS run_id) AS r")
def positional_labels(spark, sf_dir):
    """Two runs whose judged files disagree on every row."""
    first = fx.judged(spark, sf_dir).select(F.lit(fx.RUN_A).alias("run_id"), "ordinal", lb.label_rule(F.col("is_hallucination"), "yes").alias("label"))
    second = first.select(F.lit(fx.RUN_B).alias("run_id"), "ordinal", (1 - F.col("label")).alias("label"))
    runs = F.explode(F.array(F.lit(fx.RUN_A), F.lit(fx.RUN_B))).alias("run_id")
    samples = fx.table(spark, sf_dir, "embeddings").select(runs, F.col("vec_id").alias("sample_id"))
    return lb.positional_labels(samples, first.unionByName(second))


@query("c11_missing_results", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_results(spark, sf_dir):
    docs, labels = fx.table(spark, sf_dir, "documents").select("doc_id"), fx.table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left_anti")


@query("g4_set_difference", "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def set_difference(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id").exceptAll(fx.table(spark, sf_dir, "labels").select("doc_id"))


@query("c15_original_ids", f"{DEDUP} SELECT no AS position, index FROM (SELECT index, row_number() OVER (ORDER BY ordinal) - 1 AS no FROM firsts) AS t")
def original_ids(spark, sf_dir):
    """Position in the pool -> original id."""
    from tracelab.functions.ordering import row_numbers

    first = lb.dedup_first(fx.judged(spark, sf_dir).select("run_id", "index", "ordinal"), ["run_id", "index"])
    return row_numbers(first, ["run_id"], "ordinal", name="no").select((F.col("no") - 1).alias("position"), "index")


# ---------------------------------------------------------------- score tables

TABLES = """
base AS (SELECT run_id, sample_id, CASE WHEN sample_id % 4 = 0 THEN NULL ELSE (any_value(cls) >= 5)::INT END AS label_hallucination,
                CASE WHEN sample_id % 5 < 4 THEN 'train' ELSE 'test' END AS split, avg(entropy) AS perplexity,
                CASE WHEN sample_id % 7 <> 0 THEN avg(prob) END AS baseline FROM plain WHERE sample_id % 3 <> 1 GROUP BY run_id, sample_id),
fresh AS (SELECT run_id, sample_id, (any_value(cls) >= 5)::INT AS label_hallucination, 'test' AS split, max(entropy) AS perplexity, min(prob) AS ln_entropy
          FROM plain WHERE sample_id % 3 <> 2 GROUP BY run_id, sample_id)
"""


def base_scores(spark, sf_dir):
    stats = fx.cells(spark, sf_dir, keep=("cls",)).where("sample_id % 3 <> 1").groupBy(*KEY, "cls").agg(F.avg("entropy").alias("perplexity"), F.avg("prob").alias("b"))
    return stats.select(
        *KEY, F.when(F.col("sample_id") % 4 != 0, (F.col("cls") >= 5).cast("int")).alias("label_hallucination"),
        F.when(F.col("sample_id") % 5 < 4, "train").otherwise("test").alias("split"), "perplexity",
        F.when(F.col("sample_id") % 7 != 0, F.col("b")).alias("baseline"),
    )


def fresh_scores(spark, sf_dir):
    stats = fx.cells(spark, sf_dir, keep=("cls",)).where("sample_id % 3 <> 2").groupBy(*KEY, "cls").agg(F.max("entropy").alias("perplexity"), F.min("prob").alias("ln_entropy"))
    return stats.select(*KEY, (F.col("cls") >= 5).cast("int").alias("label_hallucination"), F.lit("test").alias("split"), "perplexity", "ln_entropy")


@query(
    "a11_upsert_scores",
    fx.with_cells(
        "SELECT run_id, sample_id, coalesce(b.label_hallucination, f.label_hallucination) AS label_hallucination, coalesce(b.split, f.split) AS split, "
        "CASE WHEN f.split IS NOT NULL THEN f.perplexity ELSE b.perplexity END AS perplexity, baseline, ln_entropy FROM base AS b FULL JOIN fresh AS f USING (run_id, sample_id)", TABLES),
    "perplexity baseline ln_entropy",
)
def upsert_scores(spark, sf_dir):
    """Merged, written as a new version, read back."""
    merged = st.upsert_scores(base_scores(spark, sf_dir), fresh_scores(spark, sf_dir), ["perplexity", "ln_entropy"])
    return spark.read.parquet(st.write_version(merged, scratch(spark, "scores")))


@query(
    "a12_update_scores",
    fx.with_cells(
        "SELECT run_id, sample_id, b.label_hallucination, b.split, CASE WHEN f.split IS NOT NULL THEN f.perplexity ELSE b.perplexity END AS perplexity, baseline, ln_entropy "
        "FROM base AS b LEFT JOIN fresh AS f USING (run_id, sample_id)", TABLES),
    "perplexity baseline ln_entropy",
)
def update_scores(spark, sf_dir):
    return st.update_scores(base_scores(spark, sf_dir), fresh_scores(spark, sf_dir), ["perplexity", "ln_entropy"])


@query(
    "a13_consolidate_scores",
    fx.with_cells(
        "SELECT run_id, sample_id, CASE WHEN b.split IS NOT NULL THEN b.label_hallucination ELSE f.label_hallucination END AS label_hallucination, "
        "coalesce(b.split, f.split) AS split, baseline, ln_entropy FROM base AS b FULL JOIN fresh AS f USING (run_id, sample_id)", TABLES),
    "baseline ln_entropy",
)
def consolidate_scores(spark, sf_dir):
    return st.consolidate([base_scores(spark, sf_dir).drop("perplexity"), fresh_scores(spark, sf_dir).drop("perplexity")])


@query("a14_scan_scores", fx.with_cells("SELECT split_part(run_id, '_', 1) AS model, sample_id, label_hallucination, split, round(perplexity, 6) AS perplexity FROM base WHERE split = 'test' AND label_hallucination IS NOT NULL", TABLES), "perplexity")
def scan_scores(spark, sf_dir):
    """CSV files in one folder per model; unlabelled rows carry -1."""
    path = scratch(spark, "csv")
    rows = base_scores(spark, sf_dir).withColumn("label_hallucination", F.coalesce("label_hallucination", F.lit(-1)))
    for model in ("llada", "dream"):
        part = rows.where(F.col("run_id").startswith(model)).select("sample_id", "label_hallucination", "split", F.round("perplexity", 6).alias("perplexity"))
        part.write.option("header", True).csv(f"{path}/{model}")
    return st.read_scores(spark, path, "sample_id BIGINT, label_hallucination INT, split STRING, perplexity DOUBLE")


@query("a15_write_metrics", fx.with_cells("SELECT run_id, score_name, auc AS roc_auc FROM auc WHERE score_name <> 'flat' UNION ALL SELECT run_id, score_name, NULL FROM auc WHERE score_name = 'flat'", SCORES + "," + AUC), "roc_auc")
def write_metrics(spark, sf_dir):
    """Metric records as JSON and back; a NaN metric comes back as null."""
    path = scratch(spark, "metrics")
    report = mt.ranking_metrics(detector_scores(spark, sf_dir)).withColumn(
        "roc_auc", F.when(F.col("score_name") == "flat", F.lit(float("nan"))).otherwise(F.col("roc_auc"))
    )
    st.write_metrics(report, path)
    back = spark.read.schema("run_id STRING, results MAP<STRING, STRUCT<roc_auc: DOUBLE, pr_auc: DOUBLE>>").json(path)
    return back.select("run_id", F.explode("results").alias("score_name", "m")).select("run_id", "score_name", "m.roc_auc")


REQUESTS = "SELECT doc_id, n_chars % 50 AS prompt_tokens, n_chars % 90 AS sequence_tokens, doc_id % 4 AS new_valid_tokens, n_chars AS decoder_forward_passes, n_chars / 100.0 AS batch_generation_seconds, doc_id % 3 AS batch_size FROM documents"


@query(
    "a16_generation_metrics",
    f"SELECT doc_id, CASE WHEN new_valid_tokens > 0 THEN decoder_forward_passes / new_valid_tokens END AS denoising_forwards_per_valid_token, "
    f"batch_generation_seconds / greatest(batch_size, 1) AS seconds_per_sample, greatest(0, sequence_tokens - prompt_tokens) AS new_token_slots FROM ({REQUESTS}) AS r",
    "denoising_forwards_per_valid_token seconds_per_sample",
)
def generation_metrics(spark, sf_dir):
    n = F.col("n_chars")
    requests = fx.table(spark, sf_dir, "documents").select(
        "doc_id", (n % 50).alias("prompt_tokens"), (n % 90).alias("sequence_tokens"), (F.col("doc_id") % 4).alias("new_valid_tokens"),
        n.alias("decoder_forward_passes"), (n / 100.0).alias("batch_generation_seconds"), (F.col("doc_id") % 3).alias("batch_size"),
    )
    return st.generation_metrics(requests).select("doc_id", "denoising_forwards_per_valid_token", "seconds_per_sample", "new_token_slots")


SYNC = TABLES + "," + SCORES.split(",\npool AS")[0].replace(BYSTEP, "", 1).lstrip(",\n") + ",\npool AS" + SCORES.split(",\npool AS")[1] + """,
synced AS (SELECT run_id, sample_id, b.split IS NOT NULL AS here, coalesce(b.split, '') AS old, coalesce(p.split, 'excluded') AS due, p.split IS NOT NULL AS in_pool, baseline
           FROM base AS b FULL JOIN pool AS p USING (run_id, sample_id))
"""


@query("i10_sync_split", fx.with_cells("SELECT run_id, sample_id, here AS in_scores, old AS old_split, due AS split FROM synced", SYNC))
def sync_split(spark, sf_dir):
    return st.sync_split(base_scores(spark, sf_dir), sample_pool(spark, sf_dir)).select(*KEY, "in_scores", "old_split", "split")


@query(
    "i10_sync_report",
    fx.with_cells(
        "SELECT run_id, count(*) FILTER (WHERE in_pool) AS n_pool, count(*) FILTER (WHERE here) AS n_rows, count(*) FILTER (WHERE here AND old <> due) AS n_fixed, "
        "count(*) FILTER (WHERE here AND old <> due AND due <> 'excluded') AS n_flipped, count(*) FILTER (WHERE here AND NOT in_pool) AS n_out_of_pool, "
        "count(*) FILTER (WHERE NOT here) AS n_missing, count(*) FILTER (WHERE here AND old <> due AND due <> 'excluded' AND baseline IS NOT NULL) AS stale_baseline FROM synced GROUP BY ALL", SYNC),
)
def sync_report(spark, sf_dir):
    return st.sync_report(st.sync_split(base_scores(spark, sf_dir), sample_pool(spark, sf_dir)))


@query("g1_union_shards", "SELECT doc_id, n_chars FROM documents")
def union_shards(spark, sf_dir):
    from tracelab.sources.trace import merge_batches

    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return merge_batches([docs.where(F.col("doc_id") % 3 == r) for r in range(3)])


@query("g2_last_writer", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN n_chars + 1 ELSE n_chars END AS value, CASE WHEN doc_id % 10 = 0 THEN 5 ELSE (doc_id % 3)::INT END AS shard, CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS n_lost FROM documents")
def last_writer(spark, sf_dir):
    """Every tenth key is written again by a later shard."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("value"), (F.col("doc_id") % 3).cast("int").alias("shard"))
    again = docs.where("doc_id % 10 = 0").withColumns({"value": F.col("value") + 1, "shard": F.lit(5)})
    return st.last_writer(docs.unionByName(again), ["doc_id"])


# ---------------------------------------------------------------- runs and cross-run tables

CROSS = """
names AS (SELECT o_orderkey, ['llada', 'dream', 'gemma', 'other'][(o_custkey % 4 + 1)::INT] AS model, (16 * (o_custkey % 2 + 1))::INT AS steps, (32 * (o_custkey % 2 + 1))::INT AS tokens,
                 ['triviaqa', 'naturalquestion', 'hotpotqa'][(o_orderkey % 3 + 1)::INT] AS train, ['triviaqa', 'naturalquestion', 'hotpotqa'][((o_custkey // 4) % 3 + 1)::INT] AS test,
                 (o_totalprice % 1000) / 1000 AS roc, (o_totalprice % 700) / 700 AS pr FROM orders),
named AS (SELECT *, model || '_' || steps || 'steps_' || tokens || 'tokens_' || train || '_2500samples_eval_' || test || '_seed42' AS run_id FROM names),
results AS (SELECT run_id, model, steps, tokens, train, test, 'CleanedFeatures' AS method, avg(roc) AS roc, avg(pr) AS pr FROM named
            WHERE NOT (model = 'other' AND train = 'hotpotqa') GROUP BY ALL)
"""


def cross_names(spark, sf_dir):
    sets = F.array(F.lit("triviaqa"), F.lit("naturalquestion"), F.lit("hotpotqa"))
    models = F.array(F.lit("llada"), F.lit("dream"), F.lit("gemma"), F.lit("other"))
    c, o, price = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    wide = (c % 2 + 1).cast("int")
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.format_string(
            "%s_%dsteps_%dtokens_%s_2500samples_eval_%s_seed42", F.get(models, (c % 4).cast("int")), wide * 16, wide * 32,
            F.get(sets, (o % 3).cast("int")), F.get(sets, (F.floor(c / 4) % 3).cast("int")),
        ).alias("run_id"),
        ((price % 1000) / 1000).alias("roc"), ((price % 700) / 700).alias("pr"),
    )


def cross_results(spark, sf_dir):
    """(model, steps, tokens, train, test, method) -> (roc, pr), averaged over the orders of a name."""
    mean = cross_names(spark, sf_dir).groupBy("run_id").agg(F.avg("roc").alias("roc"), F.avg("pr").alias("pr"))
    parsed = rn.parse_names(mean, rn.CROSS_NAME, rn.CROSS_FIELDS).drop("n", "seed")
    return parsed.where("NOT (model = 'other' AND train = 'hotpotqa')").withColumn("method", F.lit("CleanedFeatures"))


@query("a6_read_runs", f"WITH {CROSS} SELECT o_orderkey, model, steps, tokens, train, 2500 AS n, test, 42 AS seed FROM named")
def read_runs(spark, sf_dir):
    return rn.parse_names(cross_names(spark, sf_dir).select("o_orderkey", "run_id"), rn.CROSS_NAME, rn.CROSS_FIELDS).drop("run_id")


@query("a6_run_name", "SELECT o_orderkey, 'llada_' || (o_custkey % 64) || 'steps_32tokens_hotpotqa_' || (o_orderkey % 1000) || 'samples_seed42' AS run_id FROM orders")
def run_name(spark, sf_dir):
    """Formatted from its parts, parsed, and formatted again."""
    orders = fx.table(spark, sf_dir, "orders")
    named = orders.select("o_orderkey", rn.run_name(F.lit("llada"), F.col("o_custkey") % 64, F.lit(32), F.lit("hotpotqa"), F.col("o_orderkey") % 1000, F.lit(42)).alias("run_id"))
    parsed = rn.parse_names(named, rn.RUN_NAME, rn.RUN_FIELDS)
    return parsed.select("o_orderkey", rn.run_name(*[F.col(f) for f in rn.RUN_FIELDS]).alias("run_id"))


@query("b21_model_folder", f"WITH {CROSS} SELECT o_orderkey, CASE model WHEN 'gemma' THEN 'gemma' WHEN 'dream' THEN 'dream' ELSE 'llada' END AS folder FROM named")
def model_folder(spark, sf_dir):
    return cross_names(spark, sf_dir).select("o_orderkey", rn.model_folder(F.col("run_id")).alias("folder"))


@query("c9_run_pairs", f"WITH {CROSS}, r AS (SELECT DISTINCT model, steps, tokens, train AS dataset FROM named) SELECT a.model, a.steps, a.tokens, a.dataset AS train, b.dataset AS test FROM r AS a JOIN r AS b USING (model, steps, tokens)")
def run_pairs(spark, sf_dir):
    names = rn.parse_names(cross_names(spark, sf_dir).select("run_id").distinct(), rn.CROSS_NAME, rn.CROSS_FIELDS)
    runs = names.groupBy("model", "steps", "tokens", F.col("train").alias("dataset")).agg(F.min("run_id").alias("run_id"))
    return rn.run_pairs(runs).drop("train_run", "test_run")


@query("g6_union_results", f"WITH {CROSS} SELECT run_id, roc, pr FROM results", "roc pr")
def union_results(spark, sf_dir):
    """Result files of two models, read as one set."""
    path, table = scratch(spark, "results"), cross_results(spark, sf_dir)
    table.where("model IN ('llada', 'dream')").write.parquet(f"{path}/a")
    table.where("model NOT IN ('llada', 'dream')").write.parquet(f"{path}/b")
    return spark.read.parquet(f"{path}/a", f"{path}/b").select("run_id", "roc", "pr")


COMPLETE = f"""WITH {CROSS}, complete AS (SELECT model, steps, tokens, method, count(DISTINCT train || '/' || test) AS n_pairs FROM results GROUP BY ALL HAVING count(DISTINCT train || '/' || test) = 9)"""


@query("g7_complete_models", f"{COMPLETE} SELECT model, steps, tokens, method, n_pairs, n_models FROM complete JOIN (SELECT steps, tokens, method, count(*) AS n_models FROM complete GROUP BY ALL HAVING count(*) >= 2) AS s USING (steps, tokens, method)")
def complete_models(spark, sf_dir):
    return st.complete_models(cross_results(spark, sf_dir))


@query(
    "h20_cross_pivot",
    f"WITH {CROSS} SELECT model, steps, tokens, method, train, "
    + ", ".join(f"avg({m}) FILTER (WHERE test = '{t}') AS {t}_{m}" for t in ("triviaqa", "naturalquestion", "hotpotqa") for m in ("roc", "pr"))
    + ", CASE model WHEN 'llada' THEN 0 WHEN 'dream' THEN 1 WHEN 'gemma' THEN 2 ELSE 3 END AS model_rank FROM results GROUP BY model, steps, tokens, method, train",
    " ".join(f"{t}_{m}" for t in ("triviaqa", "naturalquestion", "hotpotqa") for m in ("roc", "pr")),
)
def cross_pivot(spark, sf_dir):
    return st.cross_pivot(cross_results(spark, sf_dir), ["triviaqa", "naturalquestion", "hotpotqa"], ["llada", "dream", "gemma"])


DIFF = f"WITH {CROSS} SELECT a.model, a.steps, a.tokens, a.train, b.roc - a.roc AS roc_diff, b.pr - a.pr AS pr_diff FROM results AS a JOIN results AS b USING (model, steps, tokens, train) WHERE a.test = 'triviaqa' AND b.test = 'hotpotqa'"


@query("c10_result_difference", DIFF, "roc_diff pr_diff")
def result_difference(spark, sf_dir):
    table = cross_results(spark, sf_dir)
    keys = ["model", "steps", "tokens", "train"]
    return st.score_difference(table.where("test = 'triviaqa'"), table.where("test = 'hotpotqa'"), keys, ["roc", "pr"])


@query("h21_difference_columns", DIFF.replace("b.roc - a.roc AS roc_diff, b.pr - a.pr AS pr_diff", "(b.roc - a.roc) + (b.pr - a.pr) AS total_diff"), "total_diff")
def difference_columns(spark, sf_dir):
    table = cross_results(spark, sf_dir)
    keys = ["model", "steps", "tokens", "train"]
    diff = st.score_difference(table.where("test = 'triviaqa'"), table.where("test = 'hotpotqa'"), keys, ["roc", "pr"])
    return diff.select(*keys, (F.col("roc_diff") + F.col("pr_diff")).alias("total_diff"))


FREQ = "freq AS (SELECT word AS feature, count(*) / (SELECT count(*) FROM documents) AS frequency FROM (SELECT unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))) AS word FROM documents) AS t GROUP BY word)"


def frequency(spark, sf_dir):
    """Each document as a selection record, its words as the selected features."""
    from tracelab.operators.selection import feature_frequency

    records = spread(fx.table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("config"), tx.word_tokens(F.col("text")).alias("selected"))
    return feature_frequency(records)


@query("d57_feature_frequency", f"WITH {FREQ} SELECT feature, frequency FROM freq", "frequency")
def feature_frequency(spark, sf_dir):
    return frequency(spark, sf_dir)


@query("f3_top_frequency", f"WITH {FREQ} SELECT feature, frequency FROM freq ORDER BY frequency DESC, feature LIMIT 31", "frequency")
def top_frequency(spark, sf_dir):
    return frequency(spark, sf_dir).orderBy(F.desc("frequency"), "feature").limit(31)


# ---------------------------------------------------------------- judged answers and question sets

@query("a5_read_judged", f"{J} SELECT ordinal AS index, question, is_hallucination FROM judged")
def read_judged(spark, sf_dir):
    path = scratch(spark, "judged")
    jd.write_answers(fx.judged(spark, sf_dir).select(F.col("ordinal").alias("index"), "question", "is_hallucination"), path)
    return jd.read_judged(spark, path).select("index", "question", "is_hallucination")


@query("a10_write_answers", f"{J} SELECT count(*) AS n, true AS sorted FROM judged")
def write_answers(spark, sf_dir):
    """Rows written, and whether every file starts after the one before it ends."""
    from pyspark.sql import Window

    path = scratch(spark, "answers")
    jd.write_answers(fx.judged(spark, sf_dir).select(F.col("ordinal").alias("index"), "question"), path)
    files = jd.read_judged(spark, path).groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min("index").alias("lo"), F.max("index").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    order = Window.orderBy("file")  # one row per file
    return files.withColumn("gap", F.col("lo") > F.lag("hi").over(order)).agg(
        F.sum("n").alias("n"), F.coalesce(F.bool_and("gap"), F.lit(True)).alias("sorted")
    )


WORDS = "regexp_split_to_array(text, ' ')"


def _words(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("question"), F.split("text", " ").alias("w"))


@query("a7_load_triviaqa", "SELECT doc_id AS id, lang AS question, list_concat([w[1]], list_filter(w, lambda a: a <> w[1])) AS label FROM (SELECT doc_id, lang, string_split(text, ' ') AS w FROM documents) AS t")
def load_triviaqa(spark, sf_dir):
    """Words of a document as gold answer and aliases."""
    source = _words(spark, sf_dir).select("id", "question", F.struct(F.col("w")[0].alias("value"), F.col("w").alias("aliases")).alias("answer"))
    return jd.load_triviaqa(source).drop("messages")


@query("a8_load_naturalquestions", "SELECT doc_id AS id, lang AS question, list(w ORDER BY i) AS label FROM (SELECT doc_id, lang, w, min(i) AS i FROM (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents WHERE doc_id % 4 <> 0) AS t WHERE w <> '' GROUP BY ALL) AS u GROUP BY ALL")
def load_naturalquestions(spark, sf_dir):
    """Words of a document in two nested short answers; every fourth question has none."""
    half = F.ceil(F.size("w") / 2).cast("int")
    answers = F.array(F.struct(F.slice("w", F.lit(1), half).alias("text")), F.struct(F.slice("w", half + 1, F.size("w")).alias("text")))
    none = F.filter(answers, lambda a: F.lit(False))
    source = _words(spark, sf_dir).select(
        "id", F.struct(F.col("question").alias("text")).alias("question"),
        F.struct(F.when(F.col("id") % 4 == 0, none).otherwise(answers).alias("short_answers")).alias("annotations"),
    )
    return jd.load_naturalquestions(source).drop("messages")


@query("a9_load_hotpotqa", "SELECT doc_id AS id, lang AS question, [string_split(text, ' ')[1]] AS label, lang AS content FROM documents")
def load_hotpotqa(spark, sf_dir):
    source = _words(spark, sf_dir).select("id", "question", F.col("w")[0].alias("answer"))
    return jd.load_hotpotqa(source).select("id", "question", "label", F.col("messages")[0]["content"].alias("content"))


@query("h6_safe_name", r"""SELECT doc_id, left(CASE WHEN s = '' THEN 'untitled' ELSE s END, 120) AS name FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\\/:*?"<>|]+', '_', 'g'), '\s+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS s FROM documents) AS t""")
def safe_name(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", tx.safe_name(F.col("text")).alias("name"))


@query("h22_sample_title", f"{J} SELECT ordinal, '[' || CASE WHEN is_hallucination = 'no' THEN 'Correct' ELSE 'Halluc' END || '] ' || CASE WHEN length(question) > 40 THEN left(question, 40) || '...' ELSE question END AS title FROM judged")
def sample_title(spark, sf_dir):
    label = lb.label_rule(F.col("is_hallucination"), "not_no")
    return fx.judged(spark, sf_dir).select("ordinal", tx.sample_title(label, F.col("question")).alias("title"))


@query(
    "h7_spec_options",
    "SELECT doc_id, source || '/' || lang AS name, '1' || n_chars AS train, lang AS kind FROM documents",
)
def spec_options(spark, sf_dir):
    spec = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("[train:1_"), F.col("n_chars").cast("string"), F.lit(" , kind: "), F.col("lang"), F.lit("]"))
    name, options = tx.spec_options(spec)
    return fx.table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), options["train"].alias("train"), options["kind"].alias("kind"))


@query("h7_outer_options", "SELECT doc_id, lang AS kind, '7' AS n FROM documents")
def outer_options(spark, sf_dir):
    spec = F.concat(F.lit("kind=old,n="), F.lit("7"), F.lit("[kind:"), F.col("lang"), F.lit("]"))
    _, options = tx.spec_options(spec)
    return fx.table(spark, sf_dir, "documents").select("doc_id", options["kind"].alias("kind"), options["n"].alias("n"))
