"""Domain tables derived from the given parquet tables, in Spark and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.functions.ordering import row_numbers
from tracelab.session import written
from tracelab.sources import trace

STEPS = 8
WIDTH = 8
PAD_ID = 0
MASK_ID = 99
RUN_A = "llada_8steps_8tokens_triviaqa_250samples_seed42"
RUN_B = "dream_8steps_8tokens_hotpotqa_250samples_seed42"
TAKEN = ("entropy", "prob", "x0_id", "masked")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_of(id_col: str):
    return F.when(F.col(id_col) % 2 == 0, F.lit(RUN_A)).otherwise(F.lit(RUN_B))


def trace_rows(spark: SparkSession, sf_dir: str, channels=TAKEN) -> DataFrame:
    """``embeddings`` read as an 8-step x 8-position trace: one stored row per vector."""
    steps = F.sequence(F.lit(0), F.lit(STEPS - 1))

    def grid(fn):
        row = lambda t: F.slice("embedding", t * WIDTH + 1, WIDTH)
        return F.transform(steps, lambda t: F.transform(row(t), lambda v, p: fn(F.abs(v.cast("double")), t, p)))

    masked = lambda t, p: t < 1 + (F.col("vec_id") * 7 + p * 3) % 9
    x0 = lambda v: (F.floor(v * 1000) % 16).cast("int")
    prob = lambda v: 1.0 / (1.0 + v)
    grids = {
        "entropy": lambda v, t, p: v,
        "prob": lambda v, t, p: prob(v),
        "unmask_prob": lambda v, t, p: F.when(masked(t, p), F.lit(0.0)).otherwise(prob(v) * prob(v)),
        "x0_id": lambda v, t, p: x0(v),
        "x_id": lambda v, t, p: F.when(masked(t, p), F.lit(MASK_ID)).otherwise(x0(v)),
        "masked": lambda v, t, p: masked(t, p),
    }
    return (
        table(spark, sf_dir, "embeddings")
        .select(
            run_of("vec_id").alias("run_id"),
            F.col("vec_id").alias("sample_id"),
            F.lit(0).alias("start_idx"),
            F.lit(WIDTH).alias("max_new_tokens"),
            F.lit(False).alias("post_commit"),
            F.col("label").alias("cls"),
            *[grid(grids[c]).alias(c) for c in channels],
        )
    )


def cells(spark: SparkSession, sf_dir: str, channels=TAKEN, pad_id: int | None = None, keep=()) -> DataFrame:
    return trace.explode_trace(trace_rows(spark, sf_dir, channels), channels, keep=keep, pad_id=pad_id)


def plain_cells(spark: SparkSession, sf_dir: str, channels=TAKEN) -> DataFrame:
    """Long cells without history flags, as a long-form table would hold them."""
    drop = ("masked_in", "just_unmasked", "just_unmasked_in", "n_steps")
    return cells(spark, sf_dir, channels).drop(*drop)


def hallucination(cls: str = "cls"):
    return F.when(F.col(cls) == 9, "unclear").when(F.col(cls) >= 5, "yes").otherwise("no")


def sample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, sample_id, is_hallucination, label) of every vector."""
    return table(spark, sf_dir, "embeddings").select(
        run_of("vec_id").alias("run_id"),
        F.col("vec_id").alias("sample_id"),
        hallucination("label").alias("is_hallucination"),
        (F.col("label") >= 5).cast("int").alias("label"),
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as judged answers; some indices come twice, the copy later in file order."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("index"), "text", F.col("doc_id").alias("ordinal"), "lang", "source"
    )
    copies = docs.where("index % 50 = 0").withColumn("ordinal", F.col("ordinal") + 10**9)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("index"), "quality")
    return (
        docs.unionByName(copies)
        .join(labels, "index", "left")
        .select(
            F.lit(RUN_A).alias("run_id"),
            "index",
            F.split("text", "\n")[0].alias("question"),
            "text",
            "ordinal",
            F.when(F.col("quality") == 0, "yes").when(F.col("quality") == 1, "no").otherwise("unclear").alias("is_hallucination"),
        )
    )


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns of a conversation as the answer variants of one sample, as a stored table."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    numbered = row_numbers(turns, ["conv_id"], "turn", name="no").select(
        F.lit(RUN_A).alias("run_id"),
        F.col("conv_id").alias("sample_id"),
        (F.col("no") - 1).cast("int").alias("variant_no"),
        "text",
    )
    return written(numbered)


# ------------------------------------------------------------------ the same tables in SQL

RUN_SQL = f"CASE WHEN {{id}} % 2 = 0 THEN '{RUN_A}' ELSE '{RUN_B}' END"

CELLS_SQL = f"""
raw AS (SELECT vec_id AS sample_id, {RUN_SQL.format(id='vec_id')} AS run_id, label AS cls, i,
               abs(embedding[i + 1]::DOUBLE) AS entropy
        FROM embeddings, (SELECT unnest(range(64)) AS i) AS g),
plain AS (SELECT run_id, sample_id, cls, (i // 8)::INT AS step, (i % 8)::INT AS pos, entropy,
                 1.0::DOUBLE / (1.0 + entropy) AS prob, (floor(entropy * 1000)::BIGINT % 16)::INT AS x0_id,
                 (i // 8) < 1 + (sample_id * 7 + (i % 8) * 3) % 9 AS masked
          FROM raw),
hist AS (SELECT *, coalesce(lag(masked) OVER (PARTITION BY run_id, sample_id, pos ORDER BY step), false) AS was
         FROM plain),
flags AS (SELECT *, (was AND NOT masked) OR (step = 7 AND masked) AS ju,
                 coalesce(bool_and(x0_id = 0) FILTER (WHERE masked)
                          OVER (PARTITION BY run_id, sample_id, pos), false) AS padding
          FROM hist)
"""


def with_cells(body: str, more: str = "") -> str:
    return f"WITH {CELLS_SQL}{',' + more if more else ''} {body}"


JUDGED_SQL = f"""
docs AS (SELECT doc_id AS index, text, doc_id AS ordinal FROM documents
         UNION ALL SELECT doc_id, text, doc_id + 1000000000 FROM documents WHERE doc_id % 50 = 0),
judged AS (SELECT '{RUN_A}' AS run_id, docs.index, string_split(text, chr(10))[1] AS question, text, ordinal,
                  CASE quality WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unclear' END AS is_hallucination
           FROM docs LEFT JOIN labels ON docs.index = labels.doc_id)
"""

VARIANTS_SQL = f"""
variants AS (SELECT '{RUN_A}' AS run_id, conv_id AS sample_id,
                    (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS variant_no, text
             FROM conversations WHERE role = 'assistant')
"""
