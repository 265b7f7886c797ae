"""Registered queries of the numbered operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm import alignment, ball_tree, conversation_repair, id_files, importance, mixing, packing, prefix_counts, sharding, shingle_join, toxic_passages, url_templates, vp_tree
from tracelab.llm.store import Scratch, tokenizer_file

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (verdict, host, path) of the url rules.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@register("op1_url_filter", url_templates.judge_sql(URL_RULES))
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_templates.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


TOP_K_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5"""


@register("op2_exact_top_k", TOP_K_SQL)
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.exact_top_k(table(spark, sf_dir, "embeddings"), k=5, query_every=50, scale=256)


@register("op3_quality_resampling")
def quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_nearest_vectors")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_tree.nearest(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


LINKS_SQL = """WITH RECURSIVE words AS (
  SELECT doc_id, string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '[\\x20\\x09-\\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, CASE WHEN len(w) = 1 AND w[1] = '' THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM runs),
rows AS (SELECT doc_id, unnest(s) AS x FROM runs),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM rows a JOIN rows b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT sizes.doc_id, n AS n_shingles, min(reach.b) AS component_id FROM sizes JOIN reach ON sizes.doc_id = reach.a GROUP BY ALL"""


@register("op5_shingle_links", LINKS_SQL)
def shingle_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = shingle_join.link_components(table(spark, sf_dir, "documents"), words=4, percent=85)
    return linked.select("doc_id", "n_shingles", "component_id")


@register("op6_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxic_passages.train(docs, labels.where(toxic_passages.fold(F.col("doc_id")) != 0))
    held_out = F.coalesce(toxic_passages.fold(F.col("doc_id")) == 0, F.lit(False))
    scored = toxic_passages.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op7_source_mix", mixing.mix_sql())
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_position").alias("position"))


@register("op8_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts.prefix_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@register("op9_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=1, length=2048)


@register("op10_token_id_files")
def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "token-ids").folder
    id_files.write_ids(table(spark, sf_dir, "documents"), folder, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return id_files.digests(spark, folder)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversation rows with known faults, dealt by a checksum of conversation and turn; nulls of role and text are one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key) % 20).alias("_fate"))
    text = F.when(F.col("_fate") == 1, F.lit("")).when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fate") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("_fate") == 0, 0).when(F.col("_fate") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


@register("op11_conversation_repair")
def conversation_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    repaired = conversation_repair.repair(damaged(conversations))
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    found = every.join(repaired.report, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    found = found.join(repaired.digests(), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(
        F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@register("op12_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@register("op13_shard_shuffle")
def shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shuffled(sharding.sized(table(spark, sf_dir, "documents")), shards=40)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
