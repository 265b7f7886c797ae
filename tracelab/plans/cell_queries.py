"""Queries for trace sources and cell-level operators (A, B, C, E and the token tables)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracelab.functions import text as tx
from tracelab.operators import cells as cl
from tracelab.operators import semantic as sem
from tracelab.plans import fixtures as fx
from tracelab.plans.registry import query
from tracelab.session import KEY, checkpoint_dir
from tracelab.sources import trace

ALL = ("entropy", "prob", "unmask_prob", "x0_id", "x_id", "masked")


def scratch(spark, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("a1_read_trace", fx.with_cells("SELECT run_id, sample_id, step, pos, entropy, prob, x0_id, masked FROM plain"), "entropy prob")
def read_trace(spark, sf_dir):
    """Write the trace as one folder per run, read it back with the enforced schema."""
    path = scratch(spark, "trace")
    trace.write_trace(fx.trace_rows(spark, sf_dir).drop("cls"), path)
    cells = trace.explode_trace(trace.read_trace(spark, path))
    return cells.select(*KEY, "step", "pos", "entropy", "prob", "x0_id", "masked")


@query(
    "a2_merge_batches",
    fx.with_cells(
        "SELECT run_id, sample_id, step, pos, entropy, CASE WHEN sample_id % 2 = 0 THEN prob END AS prob FROM plain"),
    "entropy prob",
)
def merge_batches(spark, sf_dir):
    """Two batches, the second without the prob channel."""
    cells = fx.plain_cells(spark, sf_dir).select(*KEY, "step", "pos", "entropy", "prob")
    return trace.merge_batches([cells.where("sample_id % 2 = 0"), cells.where("sample_id % 2 = 1").drop("prob")])


@query(
    "a3_densify",
    fx.with_cells(
        "SELECT g.run_id, g.sample_id, s.step, p.pos, coalesce(c.entropy, 0) AS entropy, coalesce(c.masked, true) AS masked, "
        "coalesce(c.x0_id, 0) AS x0_id FROM (SELECT DISTINCT run_id, sample_id FROM plain WHERE x0_id <> 15) AS g "
        "CROSS JOIN (SELECT unnest(range(8))::INT AS step) AS s CROSS JOIN (SELECT unnest(range(10))::INT AS pos) AS p "
        "LEFT JOIN (SELECT * FROM plain WHERE x0_id <> 15) AS c "
        "ON c.run_id = g.run_id AND c.sample_id = g.sample_id AND c.step = s.step AND c.pos = p.pos"),
    "entropy",
)
def densify(spark, sf_dir):
    """A trace with missing cells completed to 8 x 10."""
    ragged = fx.plain_cells(spark, sf_dir).where("x0_id <> 15")
    return trace.densify(ragged, 8, 10, {"entropy": 0.0, "masked": True, "x0_id": fx.PAD_ID})


@query("a4_order_shards", fx.with_cells("SELECT run_id, sample_id, pos AS n_seen, entropy FROM plain WHERE step = 0 AND pos = 0"), "entropy")
def order_shards(spark, sf_dir):
    first = fx.plain_cells(spark, sf_dir).where("step = 0 AND pos = 0")
    return trace.order_shards(first.select(*KEY, F.col("pos").alias("n_seen"), "entropy"))


SLICE = (
    "SELECT run_id, sample_id, step, (pos - sample_id % 3)::INT AS pos, entropy, x0_id FROM plain "
    "WHERE pos >= sample_id % 3 AND pos < sample_id % 3 + 5"
)


@query("b1_window_slice", fx.with_cells(SLICE), "entropy")
def window_slice(spark, sf_dir):
    cells = fx.plain_cells(spark, sf_dir).select(*KEY, "step", "pos", "entropy", "x0_id")
    samples = fx.sample_labels(spark, sf_dir).select(
        *KEY, (F.col("sample_id") % 3).cast("int").alias("start_idx"), F.lit(5).alias("max_new_tokens")
    )
    return trace.window_slice(cells, samples)


@query(
    "b1_window_rows",
    fx.with_cells(
        "SELECT g.run_id, g.sample_id, s.step, p.pos, coalesce(c.entropy, 0) AS entropy, coalesce(c.masked, true) AS masked "
        "FROM (SELECT DISTINCT run_id, sample_id FROM plain) AS g CROSS JOIN (SELECT unnest(range(8))::INT AS step) AS s "
        "CROSS JOIN (SELECT unnest(range(7))::INT AS pos) AS p LEFT JOIN plain AS c ON c.run_id = g.run_id "
        "AND c.sample_id = g.sample_id AND c.step = s.step AND c.pos = p.pos + g.sample_id % 3"),
    "entropy",
)
def window_rows(spark, sf_dir):
    """The same cut inside stored rows; the window may pass the recorded width, which is padded."""
    rows = fx.trace_rows(spark, sf_dir, ("entropy", "masked")).withColumns(
        {"start_idx": (F.col("sample_id") % 3).cast("int"), "max_new_tokens": F.lit(7)}
    )
    cut = trace.window_rows(rows, ("entropy", "masked"))
    return trace.explode_trace(cut, ("entropy", "masked")).select(*KEY, "step", "pos", "entropy", "masked")


@query(
    "b2_channels",
    fx.with_cells(
        "SELECT run_id, sample_id, step, pos, prob, CASE WHEN masked THEN 0 ELSE prob * prob END AS unmask_prob, entropy FROM plain"),
    "prob unmask_prob entropy",
)
def channels(spark, sf_dir):
    return fx.cells(spark, sf_dir, ("prob", "unmask_prob", "entropy", "masked")).select(
        *KEY, "step", "pos", "prob", "unmask_prob", "entropy"
    )


@query(
    "b3_step_mask",
    fx.with_cells(
        "SELECT run_id, sample_id, step, pos, CASE WHEN sample_id % 2 = 1 THEN step = 0 OR was ELSE masked END AS masked_in FROM hist"),
)
def step_mask(spark, sf_dir):
    """One run recorded before, the other after committing."""
    cells = fx.plain_cells(spark, sf_dir, ("masked",)).withColumn("post_commit", F.col("run_id") == fx.RUN_B)
    return trace.with_history(cells).select(*KEY, "step", "pos", "masked_in")


VOCAB_SQL = """
vocab AS (SELECT DISTINCT x0_id AS token_id, CASE WHEN x0_id % 5 = 0 THEN ' ' ELSE repeat(chr(97 + x0_id), 1 + x0_id % 4) END AS token
          FROM plain WHERE x0_id <> 13)
"""


def vocab(cells):
    """Token texts for the ids seen in a trace; id 13 stays unknown."""
    letter = F.expr("repeat(char(97 + x0_id), 1 + x0_id % 4)")
    return cells.select("x0_id").where("x0_id <> 13").distinct().select(
        F.col("x0_id").alias("token_id"),
        F.when(F.col("x0_id") % 5 == 0, F.lit(" ")).otherwise(letter).alias("text"),
    )


@query(
    "b4_proposed_tokens",
    fx.with_cells("SELECT run_id, sample_id, step, list(x0_id ORDER BY pos) AS tokens FROM plain GROUP BY ALL"),
)
def proposed_tokens(spark, sf_dir):
    return cl.token_rows(fx.plain_cells(spark, sf_dir))


@query(
    "b4_generated_tokens",
    fx.with_cells(
        "SELECT run_id, sample_id, step, list(CASE WHEN masked THEN 99 ELSE x0_id END ORDER BY pos) AS tokens FROM plain GROUP BY ALL"),
)
def generated_tokens(spark, sf_dir):
    return cl.token_rows(fx.plain_cells(spark, sf_dir, ("x_id", "masked")), "x_id")


@query(
    "b4_decode_tokens",
    fx.with_cells(
        "SELECT run_id, sample_id, step, pos, coalesce(token, '') AS token FROM plain LEFT JOIN vocab ON x0_id = token_id", VOCAB_SQL),
)
def decode_tokens(spark, sf_dir):
    cells = fx.plain_cells(spark, sf_dir)
    return cl.decode_tokens(cells, vocab(cells)).select(*KEY, "step", "pos", "token")


@query("b5_just_unmasked", fx.with_cells("SELECT run_id, sample_id, step, pos, ju AS just_unmasked FROM flags"))
def just_unmasked(spark, sf_dir):
    cells = trace.with_history(fx.plain_cells(spark, sf_dir, ("masked",)))
    return cells.select(*KEY, "step", "pos", "just_unmasked")


@query(
    "b6_first_revealed",
    fx.with_cells(
        "SELECT run_id, sample_id, step, pos, coalesce(step = min(step) FILTER (WHERE NOT masked) "
        "OVER (PARTITION BY run_id, sample_id, pos), false) AS first_revealed FROM plain"),
)
def first_revealed(spark, sf_dir):
    return cl.first_revealed(fx.plain_cells(spark, sf_dir, ("masked",))).select(*KEY, "step", "pos", "first_revealed")


PADDING_SQL = "SELECT run_id, sample_id, pos, coalesce(bool_and(x0_id = 0) FILTER (WHERE masked), false) AS padding FROM plain GROUP BY ALL"


@query("b7_padding_mask", fx.with_cells(PADDING_SQL))
def padding_mask(spark, sf_dir):
    return trace.padding_mask(fx.plain_cells(spark, sf_dir), fx.PAD_ID)


@query("b8_effective_mask", fx.with_cells("SELECT run_id, sample_id, step, pos, masked AND NOT padding AS effective FROM flags"))
def effective_mask(spark, sf_dir):
    return cl.effective_mask(fx.cells(spark, sf_dir, pad_id=fx.PAD_ID)).select(*KEY, "step", "pos", "effective")


@query(
    "b9_h_score",
    fx.with_cells(
        "SELECT run_id, sample_id, step, pos, h AS h_score, greatest(0, least(1, h)) AS remask_prob, h > 0 AND NOT masked AS remask_candidate "
        "FROM (SELECT *, prob - CASE WHEN masked THEN 0 ELSE prob * prob END AS h FROM plain) AS t"),
    "h_score remask_prob",
)
def h_score(spark, sf_dir):
    cells = fx.plain_cells(spark, sf_dir, ("prob", "unmask_prob", "masked"))
    return cl.h_score(cells).select(*KEY, "step", "pos", "h_score", "remask_prob", "remask_candidate")


@query(
    "b22_finite_or_zero",
    fx.with_cells("SELECT run_id, sample_id, step, pos, CASE WHEN x0_id IN (1, 2, 3) THEN 0 ELSE entropy END AS entropy FROM plain"),
    "entropy",
)
def finite_or_zero(spark, sf_dir):
    """NaN, infinities (put in by token id) become 0."""
    broken = (
        F.when(F.col("x0_id") == 1, F.lit(float("nan"))).when(F.col("x0_id") == 2, F.lit(float("inf")))
        .when(F.col("x0_id") == 3, F.lit(float("-inf"))).otherwise(F.col("entropy"))
    )
    cells = fx.plain_cells(spark, sf_dir)
    return cells.select(*KEY, "step", "pos", trace.finite_or_zero(broken).alias("entropy"))


@query(
    "b23_crop_or_zero",
    fx.with_cells(
        "SELECT g.run_id, g.sample_id, s.step, list(CASE WHEN g.sample_id % 4 + 6 <= 8 THEN round(c.entropy, 6) ELSE 0 END ORDER BY p.pos) AS entropy "
        "FROM (SELECT DISTINCT run_id, sample_id FROM plain) AS g CROSS JOIN (SELECT unnest(range(8))::INT AS step) AS s "
        "CROSS JOIN (SELECT unnest(range(6))::INT AS pos) AS p LEFT JOIN plain AS c ON c.run_id = g.run_id "
        "AND c.sample_id = g.sample_id AND c.step = s.step AND c.pos = p.pos + g.sample_id % 4 GROUP BY ALL"),
)
def crop_or_zero(spark, sf_dir):
    rows = fx.trace_rows(spark, sf_dir, ("entropy",)).withColumns(
        {"start_idx": (F.col("sample_id") % 4).cast("int"), "max_new_tokens": F.lit(6)}
    )
    cut = trace.crop_or_zero(rows, "entropy")
    steps = cut.select(*KEY, F.posexplode("entropy").alias("step", "entropy"))
    return steps.withColumn("entropy", F.transform("entropy", lambda v: F.round(v, 6)))


@query("c4_listed_samples", fx.with_cells("SELECT run_id, sample_id, step, pos, entropy FROM plain WHERE sample_id IN (SELECT doc_id FROM labels WHERE quality = 1)"), "entropy")
def listed_samples(spark, sf_dir):
    wanted = fx.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("sample_id"))
    return fx.plain_cells(spark, sf_dir).select(*KEY, "step", "pos", "entropy").join(wanted, "sample_id", "left_semi")


@query("c5_padding_to_cells", fx.with_cells("SELECT run_id, sample_id, step, pos, padding FROM flags"))
def padding_to_cells(spark, sf_dir):
    return trace.with_history(fx.plain_cells(spark, sf_dir), pad_id=fx.PAD_ID).select(*KEY, "step", "pos", "padding")


@query(
    "e1_step_change",
    fx.with_cells("SELECT run_id, sample_id, step, pos, coalesce(x0_id <> lag(x0_id) OVER (PARTITION BY run_id, sample_id, pos ORDER BY step), false)::INT AS changed FROM plain"),
)
def step_change(spark, sf_dir):
    return cl.step_change(fx.plain_cells(spark, sf_dir)).select(*KEY, "step", "pos", "changed")


CHANGES = """
changes AS (SELECT *, coalesce(x0_id <> lag(x0_id) OVER w, false)::INT AS changed FROM plain
            WINDOW w AS (PARTITION BY run_id, sample_id, pos ORDER BY step))
"""


@query("e2_cumulative_changes", fx.with_cells("SELECT run_id, sample_id, step, pos, (sum(changed) OVER (PARTITION BY run_id, sample_id, pos ORDER BY step))::BIGINT AS n_changes FROM changes", CHANGES))
def cumulative_changes(spark, sf_dir):
    return cl.cumulative_changes(fx.plain_cells(spark, sf_dir)).select(*KEY, "step", "pos", "n_changes")


@query(
    "e3_entropic_cost",
    fx.with_cells("SELECT run_id, sample_id, step, pos, sum(changed * masked::INT * entropy) OVER (PARTITION BY run_id, sample_id, pos ORDER BY step) AS entropic_cost FROM changes", CHANGES),
    "entropic_cost",
)
def entropic_cost(spark, sf_dir):
    return cl.entropic_cost(fx.cells(spark, sf_dir)).select(*KEY, "step", "pos", "entropic_cost")


@query(
    "e4_step_levenshtein",
    fx.with_cells(
        "SELECT run_id, sample_id, step, pos, d AS distance FROM (SELECT run_id, sample_id, step, pos, "
        "levenshtein(coalesce(token, ''), lag(coalesce(token, '')) OVER (PARTITION BY run_id, sample_id, pos ORDER BY step))::INT AS d "
        "FROM plain LEFT JOIN vocab ON x0_id = token_id) AS t WHERE step > 0", VOCAB_SQL),
)
def step_levenshtein(spark, sf_dir):
    cells = fx.plain_cells(spark, sf_dir)
    return cl.step_levenshtein(cl.decode_tokens(cells, vocab(cells)))


UNMASK = """
unmask AS (SELECT run_id, sample_id, pos, coalesce(min(step) FILTER (WHERE was AND NOT masked), 8)::INT AS unmask_step,
                  bool_or(padding) AS padding FROM flags GROUP BY ALL),
ranked AS (SELECT run_id, sample_id, pos, unmask_step, (row_number() OVER (PARTITION BY run_id, sample_id ORDER BY unmask_step, pos) - 1)::INT AS rank,
                  count(*) OVER (PARTITION BY run_id, sample_id) AS n FROM unmask WHERE unmask_step < 8 AND NOT padding)
"""


@query("e5_unmask_step", fx.with_cells("SELECT run_id, sample_id, pos, unmask_step FROM unmask", UNMASK))
def unmask_step(spark, sf_dir):
    return cl.unmask_steps(fx.cells(spark, sf_dir, ("masked",))).select(*KEY, "pos", "unmask_step")


@query("e6_unmask_order", fx.with_cells("SELECT run_id, sample_id, pos, unmask_step, rank FROM ranked", UNMASK))
def unmask_order(spark, sf_dir):
    return cl.unmask_order(fx.cells(spark, sf_dir, ("x0_id", "masked"), pad_id=fx.PAD_ID))


@query(
    "f4_evenly_spaced",
    fx.with_cells(
        "SELECT run_id, sample_id, pos, unmask_step, rank FROM ranked WHERE n < 4 OR rank IN (floor(0 * (n - 1) / 3.0), floor((n - 1) / 3.0), floor(2 * (n - 1) / 3.0), n - 1)", UNMASK),
)
def evenly_spaced(spark, sf_dir):
    return cl.evenly_spaced(cl.unmask_order(fx.cells(spark, sf_dir, ("x0_id", "masked"), pad_id=fx.PAD_ID)), 4)


@query("e7_lag_entropy", fx.with_cells("SELECT run_id, sample_id, step, pos, lag(entropy) OVER (PARTITION BY run_id, sample_id, pos ORDER BY step) AS entropy_before FROM plain"), "entropy_before")
def lag_entropy(spark, sf_dir):
    return cl.lag_entropy(fx.plain_cells(spark, sf_dir)).select(*KEY, "step", "pos", "entropy_before")


@query(
    "e8_gradient",
    fx.with_cells(
        "SELECT run_id, sample_id, step, CASE WHEN b IS NULL THEN a - m WHEN a IS NULL THEN m - b ELSE (a - b) / 2 END AS slope FROM "
        "(SELECT *, lag(m) OVER w AS b, lead(m) OVER w AS a FROM (SELECT run_id, sample_id, step, avg(entropy) AS m FROM plain GROUP BY ALL) AS t "
        "WINDOW w AS (PARTITION BY run_id, sample_id ORDER BY step)) AS u"),
    "slope",
)
def gradient(spark, sf_dir):
    from pyspark.sql import Window

    from tracelab.operators.features import gradient as central

    curve = fx.cells(spark, sf_dir).groupBy(*KEY, "step").agg(F.avg("entropy").alias("m"))
    return curve.select(*KEY, "step", central("m", Window.partitionBy(*KEY).orderBy("step")).alias("slope"))


@query("f11_interleaved_shards", "SELECT doc_id, (doc_id % 7)::INT AS shard FROM documents")
def interleaved_shards(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id")
    return trace.interleave_shards(docs, 7, "doc_id")


@query(
    "a17_step_text",
    fx.with_cells("SELECT run_id, sample_id, step, string_agg(coalesce(token, ''), ' ' ORDER BY pos) AS text FROM plain LEFT JOIN vocab ON x0_id = token_id GROUP BY ALL", VOCAB_SQL),
)
def step_text(spark, sf_dir):
    cells = fx.plain_cells(spark, sf_dir)
    return cl.step_text(cl.decode_tokens(cells, vocab(cells)))


@query(
    "a17_write_step_text",
    fx.with_cells(
        "SELECT count(*) AS n_lines, count(*) FILTER (WHERE step IS NULL) AS n_finals FROM (SELECT run_id, sample_id, step FROM plain GROUP BY ALL "
        "UNION ALL SELECT DISTINCT run_id, sample_id, NULL FROM plain) AS t"),
)
def write_step_text(spark, sf_dir):
    cells = fx.plain_cells(spark, sf_dir)
    path = scratch(spark, "steps")
    cl.write_step_text(cl.decode_tokens(cells, vocab(cells)), path)
    lines = spark.read.text(path)
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("value").startswith("Final sentence: ")).alias("n_finals"))


@query(
    "h5_visible_token",
    fx.with_cells(
        "SELECT run_id, sample_id, step, pos, CASE WHEN token IS NULL THEN '[EMPTY]' WHEN token = ' ' THEN '[SPACE]' ELSE token END AS shown "
        "FROM plain LEFT JOIN vocab ON x0_id = token_id", VOCAB_SQL),
)
def visible_token(spark, sf_dir):
    cells = fx.plain_cells(spark, sf_dir)
    decoded = cl.decode_tokens(cells, vocab(cells))
    return decoded.select(*KEY, "step", "pos", tx.visible_token(F.col("token")).alias("shown"))


@query(
    "i26_trace_matrix",
    fx.with_cells(
        "SELECT run_id, sample_id, list(r ORDER BY step) AS matrix, list((step + 1)::DOUBLE ORDER BY step) AS times FROM "
        "(SELECT run_id, sample_id, step, list(round(entropy, 6) ORDER BY pos) AS r FROM plain GROUP BY ALL) AS t GROUP BY ALL"),
)
def trace_matrix(spark, sf_dir):
    cells = fx.plain_cells(spark, sf_dir).withColumn("entropy", F.round("entropy", 6))
    return trace.assemble_matrix(cells, "entropy")


# ---------------------------------------------------------------- token distributions

DIST = f"""
vals AS (SELECT vec_id AS sample_id, {fx.RUN_SQL.format(id='vec_id')} AS run_id, i::INT AS token, abs(embedding[i + 1]::DOUBLE) AS a
         FROM embeddings, (SELECT unnest(range(64)) AS i) AS g),
dist AS (SELECT run_id, sample_id, token, a / sum(a) OVER (PARTITION BY sample_id) AS p FROM vals)
"""


def dist(spark, sf_dir):
    """One next-token distribution over 64 tokens per vector."""
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x)
    rows = fx.table(spark, sf_dir, "embeddings").withColumn("a", F.transform("embedding", lambda v: F.abs(v.cast("double"))))
    return rows.select(
        fx.run_of("vec_id").alias("run_id"), F.col("vec_id").alias("sample_id"),
        F.posexplode(F.zip_with("a", F.array_repeat(total, F.size("a")), lambda x, t: x / t)).alias("token", "p"),
    )


def token_clusters(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "embeddings").where("vec_id < 60").select(F.col("vec_id").cast("int").alias("token"))
    return ids.withColumn("cluster", F.col("token") % 8)


def token_vectors(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings").where("vec_id < 64").select(
        F.col("vec_id").cast("int").alias("token"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return sem.normalise(vectors)


@query("c12_token_clusters", f"WITH {DIST} SELECT run_id, sample_id, token, token % 8 AS cluster, p FROM dist WHERE token < 60", "p")
def map_tokens(spark, sf_dir):
    return sem.map_tokens(dist(spark, sf_dir), token_clusters(spark, sf_dir)).select(*KEY, "token", "cluster", "p")


@query(
    "c13_token_vectors",
    f"WITH {DIST} SELECT run_id, sample_id, token, p, e.embedding[1]::DOUBLE / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS first "
    "FROM dist JOIN embeddings AS e ON e.vec_id = token",
    "p first",
)
def token_vector_lookup(spark, sf_dir):
    joined = dist(spark, sf_dir).join(token_vectors(spark, sf_dir), "token")
    return joined.select(*KEY, "token", "p", F.col("vector")[0].alias("first"))


@query("d54_token_entropy", f"WITH {DIST} SELECT run_id, sample_id, -sum(p * ln(p + 1e-8)) AS entropy FROM dist GROUP BY ALL", "entropy")
def token_entropy(spark, sf_dir):
    return sem.token_entropy(dist(spark, sf_dir))


@query(
    "d55_cluster_rollup",
    f"WITH {DIST}, mass AS (SELECT run_id, sample_id, token % 8 AS c, sum(p) + 1e-14 AS q FROM dist WHERE token < 60 GROUP BY ALL) "
    "SELECT run_id, sample_id, max(q) AS sem_prob, -sum(q * ln(q + 1e-10)) AS sem_entropy, arg_max(c, q) AS sem_label FROM mass GROUP BY ALL",
    "sem_prob sem_entropy",
)
def cluster_rollup(spark, sf_dir):
    return sem.cluster_rollup(dist(spark, sf_dir), token_clusters(spark, sf_dir))


@query(
    "d56_semantic_dispersion",
    f"WITH {DIST}, unit AS (SELECT vec_id AS token, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e "
    "FROM embeddings WHERE vec_id < 64), dims AS (SELECT run_id, sample_id, d, sum(p * e[d + 1]) AS s FROM dist JOIN unit USING (token), "
    "(SELECT unnest(range(64)) AS d) AS g GROUP BY ALL) SELECT run_id, sample_id, greatest(0, 1 - sum(s * s)) AS sem_dispersion FROM dims GROUP BY ALL",
    "sem_dispersion",
)
def semantic_dispersion(spark, sf_dir):
    return sem.semantic_dispersion(dist(spark, sf_dir), token_vectors(spark, sf_dir))


@query(
    "f1_top_tokens",
    fx.with_cells(
        "SELECT run_id, sample_id, pos, m AS mean_entropy, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id, sample_id ORDER BY m DESC, pos DESC) AS rank "
        "FROM (SELECT run_id, sample_id, pos, avg(entropy) AS m FROM plain GROUP BY ALL) AS t) AS u WHERE rank <= 3"),
    "mean_entropy",
)
def top_tokens(spark, sf_dir):
    from tracelab.operators.features import top_tokens as top

    return top(fx.cells(spark, sf_dir), 3)


@query(
    "h19_log_exp_clamp",
    fx.with_cells("SELECT run_id, sample_id, step, pos, ln(prob + 1e-10) AS log_prob, exp(-entropy) AS decay, greatest(0, 1 - 4 * entropy) AS clamped FROM plain"),
    "log_prob decay clamped",
)
def log_exp_clamp(spark, sf_dir):
    return fx.plain_cells(spark, sf_dir).select(
        *KEY, "step", "pos", F.ln(F.col("prob") + 1e-10).alias("log_prob"), F.exp(-F.col("entropy")).alias("decay"),
        F.greatest(F.lit(0.0), 1 - 4 * F.col("entropy")).alias("clamped"),
    )
