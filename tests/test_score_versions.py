"""Versions of a score table, and judges that fail."""

import pytest
from pyspark.sql import functions as F

from tracelab.operators import judging as jd, labels as lb, score_tables as st

SCHEMA = "run_id STRING, sample_id BIGINT, label_hallucination STRING, split STRING, a DOUBLE"


def test_two_writers_and_a_reader(spark, tmp_path):
    base = f"file://{tmp_path}/scores"
    assert st.current_scores(spark, base) == (None, 0)
    assert st.commit_scores(spark.createDataFrame([("r", 1, "yes", "train", 0.5), ("r", 2, "no", "test", 0.25)], SCHEMA), base, 0) == 1
    one, number = st.current_scores(spark, base)
    two, same = st.current_scores(spark, base)
    assert number == same == 1
    first = spark.createDataFrame([("r", 1, 0.75)], "run_id STRING, sample_id BIGINT, a DOUBLE")
    second = spark.createDataFrame([("r", 2, 7.0)], "run_id STRING, sample_id BIGINT, b DOUBLE")
    assert st.commit_scores(st.update_scores(one, first, ["a"]), base, number) == 2
    with pytest.raises(st.StaleVersion):
        st.commit_scores(st.update_scores(two, second, ["b"]), base, same)
    # A reader that began before the commit still reads its version, whole.
    assert sorted(r["a"] for r in two.collect()) == [0.25, 0.5]
    assert st.swap_scores(spark, base, lambda table: st.update_scores(table, second, ["b"])) == 3
    rows = {r["sample_id"]: (r["a"], r["b"]) for r in st.current_scores(spark, base)[0].collect()}
    assert rows == {1: (0.75, None), 2: (0.25, 7.0)}


def test_writers_that_race_lose_no_update(spark, tmp_path, monkeypatch):
    """Another writer commits while this one writes: the rename is refused, and the change is made anew."""
    base = f"file://{tmp_path}/scores"
    st.commit_scores(spark.createDataFrame([("r", 1, "yes", "train", 0.0)], SCHEMA), base, 0)
    plain, raced = st.write_version, []

    def write(scores, where):
        if not raced:
            raced.append(True)
            monkeypatch.setattr(st, "write_version", plain)
            st.swap_scores(spark, base, lambda t: t.withColumn("a", F.col("a") + 1))
        return plain(scores, where)

    monkeypatch.setattr(st, "write_version", write)
    assert st.swap_scores(spark, base, lambda t: t.withColumn("a", F.col("a") + 10)) == 3
    assert st.current_scores(spark, base)[0].first()["a"] == 11.0


def answers(spark, n):
    rows = [("r", i, i, f"q{i}?", ["yes"], "yes" if i % 2 else "no") for i in range(n)]
    return spark.createDataFrame(rows, "run_id STRING, index BIGINT, ordinal BIGINT, question STRING, labels ARRAY<STRING>, answer STRING")


def test_judge_that_raises(spark, tmp_path):
    """Every row has a verdict, and no request that was answered is asked again, not by a second job either."""
    log, calls = f"file://{tmp_path}/log", str(tmp_path / "calls")
    open(calls, "w").close()

    def asked(prompts):
        import hashlib

        with open(calls, "a") as file:
            file.writelines(hashlib.md5(p.encode()).hexdigest() + "\n" for p in prompts)

    def by_batch(prompts):
        raise ConnectionError("the service is down")

    def one_by_one(prompts):
        if any("q7?" in p for p in prompts):
            raise TimeoutError("too slow")
        asked(prompts)
        return ['{"judgment": "true", "explanation": "ok"}' if "q1" in p else '{"judgment": "false"}' for p in prompts]

    batch, single = jd.python_judge(by_batch, tries=2), jd.logged(jd.python_judge(one_by_one, tries=2), log)
    for _ in range(2):
        rows = jd.judge_answers(answers(spark, 20), batch, single, batch_size=6).collect()
        assert len(rows) == 20
        for r in rows:
            want = "unclear" if r["index"] == 7 else "no" if "q1" in r["question"] else "yes"
            assert r["is_hallucination"] == want
            assert ("TimeoutError" in r["explanation"]) == (r["index"] == 7)
    told = open(calls).read().split()
    assert len(told) == len(set(told)) == 19


def test_positions_belong_to_runs(spark):
    labels = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("b", 0, 0)], "run_id STRING, ordinal BIGINT, label INT")
    samples = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 1)], "run_id STRING, sample_id BIGINT")
    found = lb.positional_labels(samples, labels).collect()
    assert sorted((r["run_id"], r["sample_id"], r["label"]) for r in found) == [("a", 0, 1), ("a", 1, 0), ("b", 0, 0)]
