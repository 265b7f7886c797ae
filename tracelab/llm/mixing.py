"""Mixing sources to target weights by Pfair scheduling.

A source with p of D parts is cut into blocks of documents. Block i of it may run from slot
floor(i * D / p) on (release) and must have run before slot ceil((i + 1) * D / p) (deadline);
earliest deadline first among the released blocks fills slot after slot. As long as all sources have blocks, the number
of blocks of a source in the first t slots differs from t * p / D by less than one.

Windows of blocks repeat after D slots, so one period is scheduled and block b of a source gets slot
(b div p) * D + the slot of its block b mod p in the period. A short period is a fold over its slots; any
other is made from rows of blocks and slots (``schedule_rows``), with the same slots.
Documents find their block by their rank in a seeded shuffle of their source, which needs no
window over a whole source: ranks are counted in buckets of the hash, with the sizes of the buckets before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions.ordering import row_numbers
from tracelab.llm.store import Scratch

#: Slots of a period that ``schedule`` folds; ``schedule_rows`` takes any number.
MAX_PERIOD = 20_000
#: Slots of a period that ``mix`` still schedules by a fold, as one broadcast row for each source.
FOLDED = 1_000
#: Slots of a chunk of running sums, and elements of an exploded array.
CHUNK = 1 << 17
#: Documents of one slot of a period in one task of the join.
SLOT_DOCS = 100_000


def source_key(source: Column) -> Column:
    """A source as a key that is never null; the null source is a source of its own."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def shuffle_hash(seed: int, doc_id: Column) -> Column:
    """60 bits of the MD5 of seed and id, the same in any engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def tempered_parts(docs: DataFrame) -> DataFrame:
    """(source, parts): square-root weights, the smallest source with one part."""
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    least = sizes.agg(F.min("n")).first()[0] or 1
    return sizes.select("source", F.greatest(F.round(F.sqrt(F.col("n") / F.lit(least))), F.lit(1)).cast("bigint").alias("parts"))


def schedule(parts: DataFrame) -> DataFrame:
    """One period for (key, parts) rows: (key, parts, period, nth, slot), a row per slot.

    Ties between deadlines go to the smaller key.
    """
    everything = parts.groupBy().agg(F.sort_array(F.collect_list(F.struct("key", "parts"))).alias("sources"))
    period = F.aggregate("sources", F.lit(0).cast("bigint"), lambda n, s: n + s["parts"])
    bounded = F.when(period <= MAX_PERIOD, period).otherwise(F.raise_error(F.lit(f"a period has more than {MAX_PERIOD} slots; use smaller parts")))
    counted = everything.select("sources", bounded.cast("bigint").alias("period"))

    def slot(state: Column, t: Column) -> Column:
        def ready(i: Column) -> Column:
            done, p = F.get(state["done"], i), F.get(F.col("sources"), i)["parts"]
            deadline = F.floor(((done + 1) * F.col("period") + p - 1) / p)
            released = F.floor(done * F.col("period") / p) <= t
            return F.when(released & (done < p), F.struct(deadline.alias("deadline"), i.alias("i")))

        every = F.transform(F.sequence(F.lit(0), F.size("sources") - 1), ready)
        pick = F.array_min(F.filter(every, lambda x: x.isNotNull()))["i"]
        done = F.transform(state["done"], lambda d, i: F.when(i == pick, d + 1).otherwise(d))
        return F.struct(done.alias("done"), F.concat(state["picks"], F.array(pick)).alias("picks"))

    start = F.struct(F.transform("sources", lambda s: F.lit(0).cast("bigint")).alias("done"), F.array().cast("array<int>").alias("picks"))
    picks = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("period") - 1), start, slot, lambda s: s["picks"])
    planned = counted.where(F.col("period") > 0).select("sources", "period", F.posexplode(picks).alias("slot", "pick"))
    nth = Window.partitionBy("key").orderBy("slot")
    return planned.select(
        F.get("sources", F.col("pick")).getField("key").alias("key"), F.get("sources", F.col("pick")).getField("parts").alias("parts"), "period", F.col("slot").cast("bigint").alias("slot"),
    ).withColumn("nth", F.row_number().over(nth) - 1)


def _numbers(rows: DataFrame, count: Column, name: str) -> DataFrame:
    """Rows once for each number from 0 to ``count`` - 1; no array is longer than a chunk."""
    rows = rows.withColumn("_count", count).where("_count > 0")
    rows = rows.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_count") - 1, F.lit(CHUNK).cast("bigint"))))
    last = F.least(F.col("_first") + CHUNK, F.col("_count")) - 1
    return rows.withColumn(name, F.explode(F.sequence(F.col("_first"), last))).drop("_count", "_first")


def schedule_rows(parts: DataFrame, period: int, scratch: Scratch) -> DataFrame:
    """The rows of ``schedule`` at any number of sources and slots; ``period`` is the sum of the parts.

    The slots that the more urgent half of the blocks takes do not depend on the order inside it: a slot is idle
    where the blocks released so far are fewer than the slots so far, less those idle before. So each round halves
    groups of blocks by urgency (deadline, then key): the upper half keeps the slots it makes busy, the lower one the
    idle ones, and releases are counted in slots of the own group. After log2(period) rounds a group is one
    block and one slot. A period is full, so no slot stays idle in a whole group.
    """
    jobs = _numbers(parts.select("key", "parts"), F.col("parts"), "nth").withColumns({
        "release": F.expr(f"nth * {period}L div parts"), "deadline": F.expr(f"((nth + 1) * {period}L + parts - 1) div parts")})
    jobs = scratch.save(jobs, "blocks")
    jobs = row_numbers(jobs, [], "deadline", ["key"], name="urgency").withColumn("urgency", F.col("urgency") - 1)
    jobs = scratch.save(jobs.select("key", "parts", "nth", "urgency", "release"), "blocks0")
    slots = _numbers(parts.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("node")), F.lit(period).cast("bigint"), "at")
    slots = scratch.save(slots.withColumn("slot", F.col("at")), "slots0")
    scratch.drop("blocks")
    rounds = (period - 1).bit_length()
    for done, height in enumerate(range(rounds, 0, -1)):
        node, lower = F.shiftright("urgency", height), F.shiftright("urgency", height - 1).bitwiseAND(F.lit(1).cast("bigint"))
        placed = jobs.withColumns({"node": node, "lower": lower})
        released = placed.where("lower = 0").groupBy("node", F.col("release").alias("at")).agg(F.count(F.lit(1)).alias("n"))
        own = slots.join(released, ["node", "at"], "left").withColumn("chunk", F.expr(f"`at` div {CHUNK}"))
        inside = Window.partitionBy("node", "chunk").orderBy("at")
        n = F.coalesce("n", F.lit(0).cast("bigint"))
        own = own.withColumn("n", n).withColumn("level", F.sum("n").over(inside) - F.col("at") - 1)
        chunks = own.groupBy("node", "chunk").agg(F.sum("n").alias("sum"), F.min("level").alias("low"))
        earlier = Window.partitionBy("node").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        chunks = chunks.withColumn("sum_before", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
        chunks = chunks.withColumn("low_before", F.least(F.lit(0), F.min(F.col("sum_before") + F.col("low")).over(earlier)))
        own = own.join(chunks.select("node", "chunk", "sum_before", "low_before"), ["node", "chunk"])
        low = F.min("level").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("sum_before")
        low_before = F.min("level").over(inside.rowsBetween(Window.unboundedPreceding, -1)) + F.col("sum_before")
        # Idle slots up to this one, and before it.
        own = own.withColumns({"idle": -F.least("low_before", low), "idle_before": -F.least("low_before", low_before)})
        table = scratch.save(own.select("node", "at", "slot", "idle", "idle_before"), f"round{done + 1}")
        is_idle = (F.col("idle") > F.col("idle_before")).cast("bigint")
        group = lambda half: F.col("node") * 2 + half
        inner = lambda half, at: F.when(half == 1, F.col("idle_before")).otherwise(at - F.col("idle_before"))
        slots = table.select(group(is_idle).alias("node"), inner(is_idle, F.col("at")).alias("at"), "slot")
        moved = placed.join(table.select("node", F.col("at").alias("release"), "idle_before"), ["node", "release"])
        jobs = scratch.save(moved.select("key", "parts", "nth", "urgency", inner(F.col("lower"), F.col("release")).alias("release")), f"blocks{done + 1}")
        scratch.drop(f"blocks{done}", f"round{done}" if done else "slots0")
    found = jobs.join(slots.select(F.col("node").alias("urgency"), "slot"), "urgency")
    return found.select("key", "parts", F.lit(period).cast("bigint").alias("period"), "slot", "nth")


def mix(docs: DataFrame, parts: DataFrame | None = None, block: int = 16, seed: int = 7) -> DataFrame:
    """All columns of ``docs`` and ``_block``, ``_slot`` and ``_position`` (bigint), one row per input row.

    ``parts`` has (source, parts) with whole positive parts; a source without a row, or with less than one
    part, has one part, and by default parts are ``tempered_parts``. Every row is kept; when a source has run out, its later slots stay empty. A
    source is shuffled by a hash of ``seed`` and doc_id. Null sources form one source; null and repeated ids and
    repeated rows get places of their own; null and long texts are carried along; an empty table gives an empty result. ``_block``,
    ``_slot`` and ``_position`` of the input are replaced; names that start with ``_mix_`` are taken.
    """
    docs = docs.drop("_block", "_slot", "_position")
    parts = tempered_parts(docs) if parts is None else parts
    wanted = parts.groupBy(source_key(F.col("source").cast("string")).alias("key")).agg(F.max(F.col("parts").cast("bigint")).alias("parts"))
    keyed = docs.withColumns({"_mix_key": source_key(F.col("source").cast("string")), "_mix_hash": shuffle_hash(seed, F.col("doc_id"))})
    buckets = 8 * max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = keyed.withColumn("_mix_bucket", F.floor(F.col("_mix_hash") / F.lit(2.0**60) * F.lit(buckets)).cast("int"))
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.save(keyed.groupBy("_mix_key", "_mix_bucket").agg(F.count(F.lit(1)).alias("n")), "sizes")
    earlier = Window.partitionBy("_mix_key").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_mix_key", "_mix_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_mix_before"))
    present = sizes.groupBy(F.col("_mix_key").alias("key")).agg(F.sum("n").alias("n"))
    shares = present.join(wanted, "key", "left").select("key", "n", F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)).cast("bigint").alias("parts"))
    shares = scratch.save(shares, "shares")
    period = shares.agg(F.sum("parts")).first()[0] or 0

    inside = Window.partitionBy("_mix_key", "_mix_bucket").orderBy("_mix_hash", "doc_id", *[F.xxhash64(c) for c in docs.columns if c != "doc_id"])
    ranked = keyed.withColumn("_mix_rank", F.row_number().over(inside) - 1)
    rank = F.col("_mix_before") + F.col("_mix_rank")
    places = {"_block": F.floor(rank / block), "_mix_in_block": rank % block}
    if period <= FOLDED:
        plan = schedule(shares.select("key", "parts")).groupBy(F.col("key").alias("_mix_key"), F.col("parts").alias("_mix_parts"))
        small = plan.agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "slot"))), lambda s: s["slot"]).alias("_mix_slots"))
        placed = ranked.join(before, ["_mix_key", "_mix_bucket"]).withColumns(places).join(F.broadcast(small), "_mix_key")
        in_period = F.get("_mix_slots", (F.col("_block") % F.col("_mix_parts")).cast("int"))
    else:
        # The slot of a block comes by a join on (source, nth); where many documents share one, its row is repeated.
        salts = F.ceil(F.col("n") / (F.col("parts") * SLOT_DOCS)).cast("bigint")
        dealt = shares.select(F.col("key").alias("_mix_key"), F.col("parts").alias("_mix_parts"), salts.alias("_mix_salts"))
        plan = scratch.save(schedule_rows(shares.select("key", "parts"), period, scratch), "plan")
        plan = plan.select(F.col("key").alias("_mix_key"), F.col("nth").alias("_mix_nth"), F.col("slot").alias("_mix_in_period"))
        plan = _numbers(plan.join(dealt.select("_mix_key", "_mix_salts"), "_mix_key"), F.col("_mix_salts"), "_mix_salt").drop("_mix_salts")
        blocks = ranked.join(before.join(dealt, "_mix_key"), ["_mix_key", "_mix_bucket"]).withColumns(places)
        nth, turn = F.col("_block") % F.col("_mix_parts"), F.floor(F.col("_block") / F.col("_mix_parts"))
        placed = blocks.withColumns({"_mix_nth": nth, "_mix_salt": turn % F.col("_mix_salts")}).join(plan, ["_mix_key", "_mix_nth", "_mix_salt"])
        in_period = F.col("_mix_in_period")
    slot = F.floor(F.col("_block") / F.col("_mix_parts")) * F.lit(period).cast("bigint") + in_period
    return placed.withColumn("_slot", slot).withColumn("_position", F.col("_slot") * block + F.col("_mix_in_block")).select(
        *docs.columns, "_block", "_slot", "_position")


def mix_sql(block: int = 16, seed: int = 7) -> str:
    """DuckDB SQL for (doc_id, source, block, slot, position) of ``mix`` over ``documents``."""
    return f"""WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
parts AS (SELECT source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS key,
  greatest(round(sqrt(n / (SELECT min(n) FROM sizes))), 1)::BIGINT AS p FROM sizes),
period AS (SELECT sum(p)::BIGINT AS d FROM parts),
runs(t, key, p, d, done, picked) AS (
  SELECT 0::BIGINT, key, p, d, 0::BIGINT, false FROM parts, period
  UNION ALL
  SELECT t + 1, key, p, d, done + pick::BIGINT, pick FROM (
    SELECT *, done < p AND (done * d) // p <= t AND row_number() OVER (ORDER BY
      CASE WHEN done < p AND (done * d) // p <= t THEN ((done + 1) * d + p - 1) // p END NULLS LAST, key) = 1 AS pick
    FROM runs WHERE t < d)),
slots AS (SELECT key, p, d, done - 1 AS nth, t - 1 AS in_period FROM runs WHERE picked),
ranked AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS key,
  row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT, doc_id) - 1 AS rank FROM documents)
SELECT doc_id, source, rank // {block} AS block, ((rank // {block}) // p) * d + in_period AS slot,
  (((rank // {block}) // p) * d + in_period) * {block} + rank % {block} AS position
FROM ranked JOIN slots ON ranked.key = slots.key AND (rank // {block}) % p = nth"""
