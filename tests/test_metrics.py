import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelab.functions.ordering import row_numbers, running_totals
from tracelab.functions.skew import hot_keys, lookup_join, skew_join
from tracelab.operators import labels as lb, metrics as mt


def scores_of(spark, groups):
    rows = [(g, "s", float(x) if x is not None else None, int(y)) for g, (xs, ys) in groups.items() for x, y in zip(xs, ys)]
    return spark.createDataFrame(rows, "run_id STRING, score_name STRING, score DOUBLE, label INT")


def brute(xs, ys):
    xs, ys = np.asarray(xs, float), np.asarray(ys)
    pos, neg = xs[ys == 1], xs[ys == 0]
    auc = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) if len(pos) and len(neg) else None
    ap, seen = 0.0, 0.0
    for s in sorted(set(xs), reverse=True):
        above = xs >= s
        recall = ys[above].sum() / max(ys.sum(), 1)
        ap += (recall - seen) * ys[above].mean()
        seen = recall
    ths = np.linspace(xs.min(), xs.max(), 201)
    acc = [((xs >= t).astype(int) == ys).mean() for t in ths]
    return auc, ap, ((xs >= np.median(xs)).astype(int) == ys).mean(), max(acc), ths[int(np.argmax(acc))]


def test_report_against_brute_force(spark):
    rng = np.random.default_rng(3)
    groups = {
        "ties": (rng.integers(0, 4, 60), rng.integers(0, 2, 60)),
        "plain": (rng.normal(size=81), rng.integers(0, 2, 81)),
        "equal": ([1.0] * 6, [0, 1, 0, 1, 1, 1]),
        "two": ([0.1, 0.9], [0, 1]),
    }
    got = {r["run_id"]: r for r in mt.detector_report(scores_of(spark, groups)).collect()}
    for name, (xs, ys) in groups.items():
        auc, ap, median, best, at = brute(xs, ys)
        row = got[name]
        assert row["roc_auc"] == pytest.approx(auc) and row["pr_auc"] == pytest.approx(ap)
        assert row["accuracy"] == pytest.approx(median), name
        assert row["best_accuracy"] == pytest.approx(best) and row["best_threshold"] == pytest.approx(at), name


def test_single_class_and_nan(spark):
    got = mt.detector_report(scores_of(spark, {"one": ([0.1, 0.2, float("nan"), None], [1, 1, 0, 0])})).first()
    assert got["roc_auc"] is None and got["roc_auc_se"] is None and got["n_samples"] == 2
    assert mt.drop_nan_scores(scores_of(spark, {"one": ([0.1, 0.2, float("nan")], [1, 1, 0])})).count() == 0


def test_probability_thresholds_above_every_score(spark):
    xs, ys = [0.2, 0.3, 0.4], [0, 0, 0]
    got = mt.detector_report(scores_of(spark, {"p": (xs, ys)}), bounds=(0.0, 1.0)).first()
    assert got["best_accuracy"] == 1.0 and got["best_threshold"] == pytest.approx(0.405)


def test_ranks_and_totals_of_a_hot_group(spark):
    """One group holds almost everything; buckets spread it and results stay exact."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 40 == 0, F.concat(F.lit("g"), (F.col("id") % 3).cast("string"))).otherwise("hot").alias("g"),
        (F.col("id") * 7919 % 4001).alias("o"), (F.col("id") % 5).alias("v"),
    )
    pdf = rows.toPandas().sort_values("o")
    pdf["n"], pdf["s"] = pdf.groupby("g").cumcount() + 1, pdf.groupby("g")["v"].cumsum()
    want = {(r.g, r.o): (r.n, r.s) for r in pdf.itertuples()}
    numbered = row_numbers(rows, ["g"], "o", name="n", buckets=16, size="size")
    assert {(r["g"], r["o"]): r["n"] for r in numbered.collect()} == {k: v[0] for k, v in want.items()}
    assert {r["size"] for r in numbered.where("g = 'hot'").collect()} == {3900}
    totals = running_totals(rows, ["g"], "o", {"v": "s"}, buckets=16)
    assert {(r["g"], r["o"]): r["s"] for r in totals.collect()} == {k: v[1] for k, v in want.items()}
    down = running_totals(rows, ["g"], "o", {"v": "s"}, descending=True, buckets=16)
    full = pdf.groupby("g")["v"].sum()
    v = {(r.g, r.o): r.v for r in pdf.itertuples()}
    assert all(r["s"] == full[r["g"]] - want[r["g"], r["o"]][1] + v[r["g"], r["o"]] for r in down.collect())


def test_skew_join_equals_join(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")).unionByName(spark.createDataFrame([(1, 9)], "k BIGINT, x BIGINT"))
    for how in ("inner", "left"):
        assert sorted(map(str, skew_join(big, small, ["k"], ["id"], how, least=10).collect())) == sorted(map(str, big.join(small, "k", how).collect()))


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    def folds(n):
        return sorted((r["id"], r["fold"]) for r in lb.stratified_folds(rows.repartition(n), 5, ["label"], ["id"]).collect())
    assert folds(1) == folds(9)
    first, second = (sorted(r["id"] for r in lb.subsample(rows.withColumn("all", F.lit(0)), 0.5, k, ["all"], ["id"]).collect()) for k in (0, 1))
    assert len(first) == len(second) == 500 and first != second
    assert lb.subsample(rows.limit(3).withColumn("all", F.lit(0)), 0.1, 0, ["all"], ["id"]).count() == 2


def test_dedup_before_label(spark):
    rows = spark.createDataFrame(
        [("r", 1, 0, None), ("r", 1, 1, "yes"), ("r", 2, 2, "YES"), ("r", 3, 3, "no"), ("r", 4, 4, "unclear"), ("r", 2, 5, "no")],
        "run_id STRING, index BIGINT, ordinal BIGINT, is_hallucination STRING",
    )
    assert sorted((r["index"], r["label"]) for r in lb.label_pool(rows).collect()) == [(2, 1), (3, 0)]


def test_split_boundaries(spark):
    for n in (1, 4, 5, 10, 13):
        rows = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").alias("ordinal"))
        train = [r["ordinal"] for r in lb.sequential_split(rows).where("split = 'train'").collect()]
        assert sorted(train) == list(range(int(0.8 * n)))


def test_strict_align_raises(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "id BIGINT, label INT")
    traces = spark.createDataFrame([(1, 5.0)], "id BIGINT, x DOUBLE")
    assert lb.strict_align(labels.where("id = 1"), traces, ["id"]).count() == 1
    with pytest.raises(Exception, match="no trace for 2"):
        lb.strict_align(labels, traces, ["id"]).collect()


def test_salts_grow_with_a_key(spark):
    """A pad id on nine cells of ten: its rows are spread by their number, and the join is that of the dictionary."""
    cells = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id") % 700 + 1).alias("token"))
    names = spark.range(500).select(F.col("id").alias("token"), F.concat(F.lit("t"), "id").alias("text"))
    salts = {r["token"]: r["_salts"] for r in hot_keys(cells, ["token"], least=100).collect()}
    assert salts == {0: 180}
    for how in ("inner", "left"):
        want = cells.join(names, "token", how).agg(F.count("text"), F.count(F.lit(1)), F.sum(F.xxhash64("id", "text") % 1000)).first()
        for most in (10, 10_000):
            joined = lookup_join(cells, names, ["token"], ["id"], how, max_rows=most, least=100)
            assert joined.agg(F.count("text"), F.count(F.lit(1)), F.sum(F.xxhash64("id", "text") % 1000)).first() == want


def test_many_range_partitions(spark):
    """Positions over 400 partitions, with ties at one value, from one written table."""
    rows = spark.range(6000).select("id", (F.col("id") % 3).alias("g"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.xxhash64("id")).alias("v"))
    numbered = row_numbers(rows, ["g"], "v", ["id"], buckets=400, size="total").collect()
    for g in range(3):
        own = sorted((r for r in numbered if r["g"] == g), key=lambda r: (r["v"], r["id"]))
        assert [r["row_no"] for r in own] == list(range(1, 2001)) and {r["total"] for r in own} == {2000}
    plan = row_numbers(rows, ["g"], "v", ["id"], buckets=400)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" not in plan and "RepartitionByExpression" not in plan
