"""Judging answers: prompts, reply parsing, verdicts, and the route from batch to single requests.

The judge itself is a hook, a function from a DataFrame with ``prompt`` to one with ``reply``.
Everything around it is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.text import strip
from tracelab.operators.labels import fixed_batches
from tracelab.session import materialize

Judge = Callable[[DataFrame], DataFrame]

# Verdict words and the explanations given without a judge.
VERDICTS = ["true", "false", "unclear"]
NO_EXPLANATION = "No explanation provided"
EMPTY_ANSWER = "Empty generated answer; classified locally without LLM evaluation."
INVALID_TEXT = "Empty or invalid input text"
EMPTY_TEXT = "Empty input text"


def flat_labels(label: str = "label", nested: bool = False, single: bool = False) -> Column:
    """Trimmed answer list from a string, a list, or a list of lists (first entry of each)."""
    if single:
        return F.array(strip(F.col(label)))
    if nested:
        return F.transform(F.filter(label, lambda g: F.size(g) > 0), lambda g: strip(g[0]))
    return F.transform(label, strip)


def _fields() -> Column:
    aliases = F.slice("labels", F.lit(2), F.greatest(F.size("labels") - 1, F.lit(0)))
    return F.concat(
        F.lit("Question: "), strip(F.coalesce("question", F.lit(""))),
        F.lit("\nExpected answer: "), F.coalesce(F.get("labels", F.lit(0)), F.lit("")),
        F.when(F.size(aliases) > 0, F.concat(F.lit("\nAlso accepted: "), F.concat_ws("; ", aliases))).otherwise(F.lit("")),
        F.lit("\nGiven answer: "), strip(F.coalesce("answer", F.lit(""))),
    )


def single_prompts(answers: DataFrame, instruction: str = "Judge the given answer. Reply with JSON.") -> DataFrame:
    """``prompt`` for one answer; ``labels`` holds the flat answer list."""
    return answers.withColumn("prompt", F.concat(F.lit(instruction + "\n\n"), _fields()))


def batch_prompts(batched: DataFrame, instruction: str = "Judge each item. Reply with a JSON list.") -> DataFrame:
    """One ``prompt`` per batch, items numbered by slot; a batch has a fixed, small size."""
    item = F.concat(F.lit("Item "), F.col("slot").cast("string"), F.lit("\n"), _fields())
    packed = F.array_sort(F.collect_list(F.struct("slot", item.alias("text"))))
    return batched.groupBy("run_id", "batch").agg(
        F.concat(F.lit(instruction + "\n\n"), F.array_join(packed["text"], "\n\n")).alias("prompt"),
        F.count(F.lit(1)).cast("int").alias("n_items"),
    )


def _verdict(raw: Column) -> Column:
    word = F.lower(strip(raw))
    return F.when(word.isin(VERDICTS), word).otherwise("unclear")


def parse_reply(reply: str = "reply") -> Column:
    """(judgment, explanation) from free text with one JSON object in it."""
    text = F.col(reply)
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, "judgment STRING, explanation STRING")
    keys = F.json_object_keys(body)
    has = F.coalesce(F.array_contains(keys, "judgment"), F.lit(False))
    said = F.when(F.array_contains(keys, "explanation"), parsed["explanation"]).otherwise(F.lit(NO_EXPLANATION))
    judgment = (
        F.when(text.isNull() | (text == ""), "unclear").when(strip(text) == "", "false")
        .when(has, _verdict(parsed["judgment"])).otherwise("unclear")
    )
    explanation = (
        F.when(text.isNull() | (text == ""), INVALID_TEXT).when(strip(text) == "", EMPTY_TEXT)
        .when(has, said).otherwise(strip(text))
    )
    return F.struct(judgment.alias("judgment"), explanation.alias("explanation"))


def parse_batch_reply(reply: str = "reply", n_items: str = "n_items") -> Column:
    """Array of (judgment, explanation) in item order, or NULL when the reply does not hold exactly
    one entry for each of the items 0 .. n - 1."""
    body = F.regexp_extract(F.col(reply), r"(?s)\[.*\]", 0)
    entries = F.from_json(body, "ARRAY<STRUCT<index: INT, judgment: STRING, explanation: STRING>>")
    order = F.array_sort(entries)
    n = F.col(n_items)
    exact = (F.size(entries) == n) & (order["index"] == F.sequence(F.lit(0), n - 1))
    out = F.transform(
        order,
        lambda e: F.struct(
            _verdict(e["judgment"]).alias("judgment"),
            F.coalesce(e["explanation"], F.lit(NO_EXPLANATION)).alias("explanation"),
        ),
    )
    return F.when(F.coalesce(exact, F.lit(False)), out)


def verdict_label(judgment: Column) -> Column:
    """false -> yes (hallucination), true -> no, anything else -> unclear."""
    return F.when(judgment == "false", "yes").when(judgment == "true", "no").otherwise("unclear")


def is_empty(answer: str = "answer") -> Column:
    return strip(F.coalesce(F.col(answer), F.lit(""))) == ""


def _with_error(replies: DataFrame) -> DataFrame:
    """Replies of a judge that reports no errors have none."""
    return replies if "error" in replies.columns else replies.withColumn("error", F.lit(None).cast("string"))


def judge_answers(answers: DataFrame, judge_batch: Judge, judge_single: Judge, batch_size: int = 32) -> DataFrame:
    """``is_hallucination`` and ``explanation`` for every answer.

    Empty answers are settled without the judge. The rest go out in fixed batches; a batch whose
    reply is missing or cannot be read is sent again as single requests; what still fails is unclear, with the judge's
    ``error`` as explanation if it reports one. ``answers`` needs run_id, index, ordinal, question, labels and answer.
    """
    settled = answers.where(is_empty()).withColumns(
        {"is_hallucination": F.lit("yes"), "explanation": F.lit(EMPTY_ANSWER)}
    )
    # Written once each: three steps read the batches and two the replies, and a service must not be asked twice.
    batched = materialize(fixed_batches(answers.where(~is_empty()), batch_size))
    replies = materialize(
        judge_batch(batch_prompts(batched)).select("run_id", "batch", parse_batch_reply().alias("verdicts"))
    )
    routed = batched.join(replies, ["run_id", "batch"], "left")
    read = routed.where("verdicts IS NOT NULL").withColumn("v", F.get("verdicts", F.col("slot")))
    again = _with_error(judge_single(single_prompts(routed.where("verdicts IS NULL").drop("verdicts", "batch", "slot"))))
    said = F.when(F.col("error").isNotNull(), F.struct(F.lit("unclear").alias("judgment"), F.col("error").alias("explanation")))
    again = materialize(again.withColumn("v", F.coalesce(said, parse_reply())).drop("prompt", "reply", "error", "tries"))
    both = read.drop("verdicts", "batch", "slot").unionByName(again)
    judged = both.withColumns(
        {"is_hallucination": verdict_label(F.col("v.judgment")), "explanation": F.col("v.explanation")}
    ).drop("v")
    return judged.unionByName(settled)


def exact_match(answers: DataFrame) -> DataFrame:
    """The default judge: the trimmed lower-case answer equals one of the accepted ones."""
    wanted = F.transform("labels", lambda a: F.lower(a))
    hit = F.array_contains(wanted, F.lower(strip(F.col("answer"))))
    return answers.withColumn("judgment", F.when(hit, "true").otherwise("false"))


def _asked(call: Callable[[list[str]], list[str]], prompts: list[str], tries: int) -> list[tuple[str | None, str | None, int]]:
    """(reply, error, tries) of each prompt. Prompts that fail together are asked one by one."""
    if len(prompts) > 1:
        try:
            replies = list(call(prompts))
            if len(replies) == len(prompts):
                return [(r, None, 1) for r in replies]
        except Exception:  # noqa: BLE001 - which prompt it was shows below
            pass
        return [_asked(call, [p], tries)[0] for p in prompts]
    for no in range(1, tries + 1):
        try:
            (reply,) = call(prompts)
            return [(reply, None, no)]
        except Exception as e:  # noqa: BLE001 - the error is the answer
            error = f"{type(e).__name__}: {str(e)[:200]}"
    return [(None, error, tries)]


def python_judge(call: Callable[[list[str]], list[str]], tries: int = 3) -> Judge:
    """Wrap a service call (prompts -> replies) as a judge; it runs on Arrow batches inside tasks.

    Adds ``reply``, ``error`` and ``tries``. An exception ends no job: prompts that fail together are asked one by one, up to
    ``tries`` times each, and one that still fails has a null reply and the kind of error.
    """

    def apply(prompts: DataFrame) -> DataFrame:
        def batches(frames):
            for frame in frames:
                asked = _asked(call, list(frame["prompt"]), tries) if len(frame) else []
                for i, name in enumerate(("reply", "error", "tries")):
                    frame[name] = [a[i] for a in asked]
                yield frame

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
        return prompts.mapInPandas(batches, f"{fields}, reply string, error string, tries int")

    return apply


#: Parts in which a log of requests grows.
LOG_PARTS = 8


def logged(judge: Judge, folder: str, parts: int = LOG_PARTS) -> Judge:
    """A judge that asks each distinct prompt once and keeps the answers under ``folder``.

    Prompts with an answer in the log are not asked again, by this job or by one that is started after it broke off. Answers are appended
    part by part, so at most one part is lost; a prompt that failed is asked again by a later job only.
    """

    def apply(prompts: DataFrame) -> DataFrame:
        spark = prompts.sparkSession
        keyed = materialize(prompts.withColumn("_key", F.sha2("prompt", 256)))
        distinct = keyed.select("_key", "prompt").dropDuplicates(["_key"])
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        kind = "_key string, reply string, error string, tries int"
        known = spark.read.schema(kind).parquet(folder).where("reply IS NOT NULL").select("_key") if there else spark.createDataFrame([], "_key string")
        new = materialize(distinct.join(known, "_key", "left_anti").withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(parts))))
        for part in range(parts):
            own = new.where(F.col("_part") == part).drop("_part")
            answers = _with_error(judge(own))
            answers = answers if "tries" in answers.columns else answers.withColumn("tries", F.lit(1))
            answers.select("_key", "reply", "error", F.col("tries").cast("int").alias("tries")).write.mode("append").parquet(folder)
        log = spark.read.schema(kind).parquet(folder)
        # An answer stands before an error.
        best = log.groupBy("_key").agg(F.min_by(F.struct("reply", "error", "tries"), F.col("reply").isNull()).alias("a"))
        return keyed.join(best.select("_key", "a.*"), "_key", "left").drop("_key")

    return apply
