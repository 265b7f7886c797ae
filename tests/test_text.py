import json
import random
import re

import oracle
import pytest
from pyspark.sql import functions as F

from tracelab.functions import text as tx
from tracelab.operators import corpus as cp, judging as jg, lexical as lx, semantic as sem
from tracelab.session import KEY
from tracelab.sources import runs as rn


def value(spark, column, **inputs):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in inputs.items())
    return spark.createDataFrame([tuple(v for _, v in inputs.values())], schema).select(column.alias("x")).first()["x"]


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_lcs_against_table(spark):
    rng = random.Random(1)
    pairs = [([rng.choice("abcde") for _ in range(rng.randint(0, 90))], [rng.choice("abcde") for _ in range(rng.randint(0, 90))]) for _ in range(60)]
    pairs += [([], ["a"]), (list("abc"), list("abc")), (list("abc"), list("cba"))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i INT, a ARRAY<STRING>, b ARRAY<STRING>")
    got = {r["i"]: r["n"] for r in df.select("i", tx.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {i: lcs_table(a, b) for i, (a, b) in enumerate(pairs)}


def test_word_tokens_split_on_accents(spark):
    assert value(spark, tx.word_tokens(F.col("t")), t=("STRING", "Été 2 FOIS, co-op!")) == ["t", "2", "fois", "co", "op"]
    assert value(spark, tx.word_tokens(F.col("t")), t=("STRING", "")) == []


def test_lexical_features(spark):
    rows = [("r", 1, 0, "the cat sat"), ("r", 1, 1, "the cat sat"), ("r", 1, 2, "dogs bark"), ("r", 2, 0, "alone"), ("r", 3, 0, ""), ("r", 3, 1, "x")]
    # first best F1 wins a tie: both alternatives of sample 4 have F1 = 1/2 with different precision
    rows += [("r", 4, 0, "a b"), ("r", 4, 1, "a c"), ("r", 4, 2, "a d")]
    got = {r["sample_id"]: r for r in lx.lexical_features(spark.createDataFrame(rows, "run_id STRING, sample_id BIGINT, variant_no INT, text STRING")).collect()}
    assert (got[1]["MaxRougeLF1"], got[1]["MeanRougeLF1"], got[1]["RougeLVar"]) == pytest.approx((1.0, 0.5, 0.25))
    assert all(got[2][c] == 0 for c in lx.FEATURES) and all(got[3][c] == 0 for c in lx.FEATURES)
    assert got[4]["MaxRougeLF1"] == pytest.approx(0.5) and got[4]["MaxRougeLPrec"] == pytest.approx(0.5)


def test_many_variants_use_blocks(spark):
    n = 700
    rows = spark.range(n).select(F.lit("r").alias("run_id"), F.lit(7).cast("bigint").alias("sample_id"), F.col("id").cast("int").alias("variant_no"), F.lit("same words").alias("text"))
    pairs = lx.variant_pairs(rows)
    assert pairs.count() == n - 1 and pairs.select("variant_no").distinct().count() == n - 1
    assert lx.lexical_features(rows).first()["MeanRougeLF1"] == 1.0


def greedy(texts, same):
    clusters, reps, seen = [], [], {}
    out = []
    for i, t in enumerate(texts):
        t = t.strip()
        if not t:
            out.append(i)
            continue
        if t in seen:
            out.append(seen[t])
            continue
        home = next((r for r in reps if same(t, texts[r].strip()) and same(texts[r].strip(), t)), None)
        if home is None:
            home = i
            reps.append(i)
        seen[t] = home
        out.append(home)
    return out


def test_greedy_clusters_follow_the_order(spark):
    """A relation that is not transitive, and one that holds in one direction only."""
    texts = ["b", "a", "c", "a", " ", "d", "", "bb", "b "]
    near = lambda p, h: abs(ord(p[0]) - ord(h[0])) <= 1 and not (len(p) > len(h))
    rows = spark.createDataFrame([("r", s, i, t) for s in (1, 2) for i, t in enumerate(texts)], "run_id STRING, sample_id BIGINT, variant_no INT, text STRING")
    scorer = sem.python_scorer(lambda p, h: [1.0 if abs(ord(a[0]) - ord(b[0])) <= 1 and not len(a) > len(b) else 0.0 for a, b in zip(p, h)])
    got = {(r["sample_id"], r["variant_no"]): r["cluster"] for r in sem.greedy_clusters(rows, scorer).collect()}
    assert got == {(s, i): c for s in (1, 2) for i, c in enumerate(greedy(texts, near))}


def test_semantic_entropy_of_shares(spark):
    rows = spark.createDataFrame([("r", 1, i, t) for i, t in enumerate(["x y", "y x", "z", ""])], "run_id STRING, sample_id BIGINT, variant_no INT, text STRING")
    import math

    got = sem.semantic_entropy(sem.cluster_variants(rows)).first()["semantic_entropy"]
    assert got == pytest.approx(-(0.5 * math.log(0.5) + 0.5 * math.log(0.25)))


def test_tokens_made_visible(spark):
    cases = {" ": "[SPACE]", "\n": "[NEWLINE]", "\t": "[TAB]", "\r": "[CARRIAGE_RETURN]", "": "[EMPTY]", "<|mdm_mask|>": "[MDM_MASK]", "  ": "['  ']", "\n\n": "['\\n\\n']", " a": " a"}
    for raw, shown in cases.items():
        assert value(spark, tx.visible_token(F.col("t")), t=("STRING", raw)) == shown


def test_safe_names(spark):
    cases = {"a/b:c": "a_b_c", "  x  y ": "x_y", "...": "untitled", "": "untitled", "a" * 130: "a" * 120, "what?": "what"}
    for raw, name in cases.items():
        assert value(spark, tx.safe_name(F.col("t")), t=("STRING", raw)) == name


def test_specs(spark):
    def parse(spec):
        df = spark.createDataFrame([(spec,)], "s STRING")
        name, options = tx.spec_options(F.col("s"))
        return tuple(df.select(name.alias("n"), options.alias("o")).first())

    assert parse("org/data[train:1_000, test:all]") == ("org/data", {"train": "1000", "test": "all"})
    assert parse("a=1,b=x=y") == (None, {"a": "1", "b": "x=y"})
    assert parse("a=1,b=2[b:3]") == (None, {"a": "1", "b": "3"})
    assert parse("plain") == ("plain", {}) and parse("plain[]") == ("plain", {})
    with pytest.raises(Exception, match="expected key:value"):
        parse("x[nocolon]")


def test_run_names(spark):
    good = spark.createDataFrame([("gemma_16steps_32tokens_triviaqa_2500samples_eval_hotpotqa_seed42",)], "run_id STRING")
    row = rn.parse_names(good, rn.CROSS_NAME, rn.CROSS_FIELDS).first()
    assert (row["model"], row["steps"], row["train"], row["test"], row["seed"]) == ("gemma", 16, "triviaqa", "hotpotqa", 42)
    with pytest.raises(Exception, match="run name not recognised"):
        rn.parse_names(spark.createDataFrame([("nonsense",)], "run_id STRING"), rn.CROSS_NAME, rn.CROSS_FIELDS).collect()


@pytest.mark.parametrize("reply,judgment,explanation", [
    ('{"judgment": true, "explanation": "ok"}', "true", "ok"),
    ('{"judgment": "TRUE "}', "true", "No explanation provided"),
    ('x {"a": 1} y', "unclear", 'x {"a": 1} y'),
    ('{"judgment": 1}', "unclear", "No explanation provided"),
    ('{"judgment": null}', "unclear", "No explanation provided"),
    ("{broken", "unclear", "{broken"),
    ("", "unclear", "Empty or invalid input text"),
    (None, "unclear", "Empty or invalid input text"),
    (" \n", "false", "Empty input text"),
])
def test_single_replies(spark, reply, judgment, explanation):
    got = value(spark, jg.parse_reply("r"), r=("STRING", reply))
    assert (got["judgment"], got["explanation"]) == (judgment, explanation)


@pytest.mark.parametrize("reply,want", [
    (json.dumps([{"index": 1, "judgment": False}, {"index": 0, "judgment": "True", "explanation": "e"}]), ["true", "false"]),
    ("```json\n" + json.dumps([{"index": 0, "judgment": True}, {"index": 1}]) + "\n```", ["true", "unclear"]),
    (json.dumps([{"index": 0, "judgment": True}]), None),
    (json.dumps([{"index": 0}, {"index": 0}]), None),
    (json.dumps([{"index": 0}, {"index": 2}]), None),
    (json.dumps([{"judgment": True}, {"index": 1}]), None),
    ("[1, 2]", None), ("nothing", None), ("", None),
])
def test_batch_replies(spark, reply, want):
    got = value(spark, jg.parse_batch_reply("r", "n"), r=("STRING", reply), n=("INT", 2))
    assert (None if got is None else [g["judgment"] for g in got]) == want


def test_labels_flatten(spark):
    assert value(spark, jg.flat_labels("l"), l=("ARRAY<STRING>", [" a ", "b"])) == ["a", "b"]
    assert value(spark, jg.flat_labels("l", nested=True), l=("ARRAY<ARRAY<STRING>>", [["x ", "y"], [], ["z"]])) == ["x", "z"]
    assert value(spark, jg.flat_labels("l", single=True), l=("STRING", " s ")) == ["s"]


def test_judge_that_never_answers_gives_unclear(spark):
    rows = spark.createDataFrame([("r", i, i, "q", ["a"], "a" if i else " ") for i in range(5)], "run_id STRING, index BIGINT, ordinal BIGINT, question STRING, labels ARRAY<STRING>, answer STRING")
    silent = lambda prompts: prompts.withColumn("reply", F.lit("sorry"))
    got = {r["index"]: r["is_hallucination"] for r in jg.judge_answers(rows, silent, silent, batch_size=2).collect()}
    assert got == {0: "yes", 1: "unclear", 2: "unclear", 3: "unclear", 4: "unclear"}


def tokens(spark, ids, **more):
    schema = "input_ids ARRAY<INT>" + "".join(f", {k} INT" for k in more)
    return spark.createDataFrame([(ids, *more.values())], schema)


def test_clipping(spark):
    ids = list(range(10))
    assert cp.clip_rows(tokens(spark, ids), 3).first()[0] == [0, 1, 2]
    assert cp.clip_rows(tokens(spark, ids), 3, "left").first()[0] == [7, 8, 9]
    assert cp.clip_rows(tokens(spark, ids), 30, "left").first()[0] == ids
    with pytest.raises(ValueError):
        cp.clip_rows(tokens(spark, ids), 3, "middle")
    keep = lambda n, size, side="right": cp.clip_keep_prompt(tokens(spark, ids, prompt_len=n), size, side).first()[0]
    assert keep(4, 6) == [0, 1, 2, 3, 4, 5] and keep(4, 2) == [0, 1, 2, 3]
    assert keep(4, 6, "left") == [0, 1, 2, 3, 8, 9] and keep(4, 4, "left") == ids
    assert keep(None, 2) == [0, 1] and keep(20, 3) == ids


def test_stop_trimming(spark):
    def gen(full, prompt, **stops):
        df = spark.createDataFrame([(full, prompt)], "full ARRAY<INT>, prompt ARRAY<INT>")
        return cp.trim_generation(df, **stops).first()["generated"]

    assert gen([0, 0, 7, 8, 1, 2, 5, 3], [0, 7, 8], pad_id=0, end_of_sequence=5) == [1, 2]
    assert gen([7, 8, 1, 9, 2, 5], [7, 8], pad_id=0, end_of_sequence=9, end_of_turn=5) == [1, 9, 2]
    assert gen([5, 5, 7, 8, 1, 5, 2], [7, 8], pad_id=5, end_of_sequence=5) == [1]  # pad is the stop: search
    assert gen([5, 7, 5, 3, 4], [5, 7, 5], pad_id=None, end_of_sequence=5) == [3, 4]  # stop inside the prompt
    assert gen([7, 8], [7, 8], pad_id=0, end_of_sequence=5) == []
    assert gen([7, 1, 2], [7], pad_id=0, end_of_sequence=None) == [1, 2]
    df = spark.createDataFrame([([0, 4, 1, 6, 5, 2], [0, 4, 99, 6, 99, 99])], "full ARRAY<INT>, prompt ARRAY<INT>")
    assert cp.trim_infill(df, 99, 0, 5).first()["generated"] == [1]
    assert value(spark, cp.trim_at_stop(F.col("i"), [5, 9]), i=("ARRAY<INT>", [1, 9, 5])) == [1, 9]
    assert value(spark, cp.trim_at_stop(F.col("i"), [5]), i=("ARRAY<INT>", [1, 2])) == [1, 2]


@pytest.mark.parametrize("drop_tail,end_id", [(True, None), (False, None), (False, 99), (True, 99)])
def test_packing_against_a_loop(spark, drop_tail, end_id):
    rng = random.Random(4)
    docs = [("hot" if i % 10 else "cold", i, [rng.randint(0, 9) for _ in range(rng.choice([0, 1, 3, 40]))] + ([99] if i % 7 == 0 else [])) for i in range(300)]
    df = spark.createDataFrame(docs, "g STRING, o BIGINT, ids ARRAY<INT>")
    got = {(r["g"], r["chunk"]): r["input_ids"] for r in cp.pack_tokens(df, 16, "g", "o", drop_tail, end_id).collect()}
    want = {}
    for g in ("hot", "cold"):
        line = []
        for h, _, ids in docs:
            if h == g:
                line += ids + ([] if end_id is None or (ids and ids[-1] == end_id) else [end_id])
        for k in range(0, len(line), 16):
            if not drop_tail or len(line[k:k + 16]) == 16:
                want[g, k // 16] = line[k:k + 16]
    assert got == want


def test_segments_join_to_rows(spark):
    roles = {"user": 1, "assistant": 2}
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"words {c} of turn {t}") for c in range(5) for t in range(c + 2)]
    pieces = cp.response_segments(spark.createDataFrame(turns, "c BIGINT, t BIGINT, role STRING, text STRING"), "c", "t", roles).collect()
    for c in range(5):
        messages = [(r, x) for k, _, r, x in turns if k == c]
        row = cp.response_rows(spark.createDataFrame([(messages,)], "messages ARRAY<STRUCT<role: STRING, content: STRING>>"), roles).first()
        mine = sorted((p for p in pieces if p["c"] == c), key=lambda p: p["offset"])
        assert sum((p["input_ids"] for p in mine), []) == row["input_ids"] and sum((p["labels"] for p in mine), []) == row["labels"]
        assert {p["prompt_len"] for p in mine} == {row["prompt_len"]}


def test_no_query_name_or_folder_is_reserved():
    from tracelab.plans import all_queries

    assert not [n for n in all_queries.QUERIES if n == "pipeline" or re.match(r"op\d+_", n)]
    assert KEY == ["run_id", "sample_id"]


def test_variant_list_of_a_large_sample_is_one_row(spark):
    sql = "SELECT 'r' AS run_id, s AS sample_id, v AS variant_no, 't' || v AS text FROM (SELECT unnest(range(300)) AS v, 1 AS s UNION ALL SELECT unnest(range(3)), 2)"
    rows = [("r", 1, i, f"t{i}") for i in range(300)] + [("r", 2, i, f"t{i}") for i in range(3)]
    random.Random(2).shuffle(rows)
    lists = lx.variant_lists(spark.createDataFrame(rows, "run_id STRING, sample_id BIGINT, variant_no INT, text STRING"))
    want = f"SELECT run_id, sample_id, list(text ORDER BY variant_no) AS variants FROM ({sql}) GROUP BY ALL"
    assert oracle.compare(lists, oracle.connect("/none"), want) is None
