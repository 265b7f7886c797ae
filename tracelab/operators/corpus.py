"""Token rows for training: tokenizing, packing, clipping, prompt masking, stop trimming.

Everything but packing and the batch cuts is an expression inside the row, so the same functions
work on streams (see ``tracelab.streaming.corpus``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.ordering import BUCKET, running_totals, seeded_hash
from tracelab.functions.text import word_tokens
from tracelab.session import spread, written

# The label id that a loss ignores and the columns that hold one entry per token.
IGNORED = -100
TOKEN_COLUMNS = ["input_ids", "labels", "attention_mask"]


def hashed_ids(text: Column, vocab_size: int = 50_000) -> Column:
    """Default tokenizer hook: each word's id is its CRC-32 modulo the vocabulary size."""
    return F.transform(word_tokens(text), lambda w: (F.crc32(w) % vocab_size).cast("int"))


def tokenized(docs: DataFrame, text: str = "text", tokenizer=hashed_ids) -> DataFrame:
    """``ids`` and ``n_tokens`` of each text, written once.

    Packing reads the counts and then the ids; written columns spare it tokenizing twice, and the
    counts can be read without the ids.
    """
    rest = [c for c in docs.columns if c != text]
    return written(spread(docs).select(*rest, tokenizer(F.col(text)).alias("ids")).withColumn("n_tokens", F.size("ids")))


def present(rows: DataFrame) -> list[str]:
    return [c for c in TOKEN_COLUMNS if c in rows.columns]


def clip_rows(rows: DataFrame, max_length: int, side: str = "right") -> DataFrame:
    """Keep the first (right) or last (left) ``max_length`` entries of each token column."""
    if side not in ("right", "left"):
        raise ValueError(f"unknown side {side!r}")
    return rows.withColumns({c: _clipped(c, max_length, side) for c in present(rows)})


def filter_long_rows(rows: DataFrame, max_length: int) -> DataFrame:
    return rows.where(F.size("input_ids") <= max_length)


def filter_long_prompts(rows: DataFrame, max_length: int) -> DataFrame:
    """Rows whose prompt fits; every row when there is no prompt length."""
    return rows.where(F.col("prompt_len") <= max_length) if "prompt_len" in rows.columns else rows


def clip_keep_prompt(rows: DataFrame, max_length: int, side: str = "right") -> DataFrame:
    """Keep the prompt whole and clip the response to the room left; rows without a prompt length
    are clipped as a whole. On the left side a response without any room stays whole."""
    if side not in ("right", "left"):
        raise ValueError(f"unknown side {side!r}")
    if "prompt_len" not in rows.columns:
        return clip_rows(rows, max_length, side)
    n = F.col("prompt_len")

    def cut(c: str) -> Column:
        size = F.size(c)
        kept = F.least(n, size)
        budget = F.greatest(F.lit(max_length) - kept, F.lit(0))
        response = F.slice(c, kept + 1, F.greatest(size - kept, F.lit(0)))
        if side == "right":
            response = F.slice(response, F.lit(1), budget)
        else:
            start = F.greatest(F.size(response) - budget + 1, F.lit(1))
            response = F.when(budget == 0, response).otherwise(F.slice(response, start, budget))
        return F.when(n >= 0, F.concat(F.slice(c, F.lit(1), kept), response)).otherwise(_clipped(c, max_length, side))

    return rows.withColumns({c: cut(c) for c in present(rows)})


def _clipped(c: str, max_length: int, side: str) -> Column:
    if side == "right":
        return F.slice(c, 1, max_length)
    return F.slice(c, F.greatest(F.size(c) - max_length + 1, F.lit(1)), F.lit(max_length))


def mask_suffix(rows: DataFrame, length: Column) -> DataFrame:
    """Attention 0 and label -100 from position ``length`` on; ids stay."""
    def fill(c: str, value: int) -> Column:
        kept = F.least(F.greatest(length, F.lit(0)).cast("int"), F.size(c))
        return F.concat(F.slice(c, F.lit(1), kept), F.array_repeat(F.lit(value), F.size(c) - kept))

    ones = F.transform("input_ids", lambda _: F.lit(1))
    base = rows if "attention_mask" in rows.columns else rows.withColumn("attention_mask", ones)
    out = base.withColumn("attention_mask", fill("attention_mask", 0))
    return out.withColumn("labels", fill("labels", IGNORED)) if "labels" in rows.columns else out


def random_mask_suffix(rows: DataFrame, batch: str, ratio: float = 0.01, seed: int = 42) -> DataFrame:
    """``mask_suffix`` on a seeded share of the batches, with one random length per batch."""
    width = F.max(F.size("input_ids")).alias("_width")
    picked = rows.groupBy(batch).agg(width).withColumn("_draw", F.pmod(seeded_hash(seed, batch), F.lit(1_000_000)) / 1e6)
    length = 1 + F.pmod(seeded_hash(seed + 1, batch), F.col("_width"))
    cut = picked.withColumn("_length", F.when(F.col("_draw") < ratio, length).otherwise(F.col("_width"))).select(batch, "_length")
    return mask_suffix(rows.join(cut, batch), F.col("_length")).drop("_length")


def prepend_bos(rows: DataFrame, bos_id: int) -> DataFrame:
    """BOS before the ids, -100 before the labels, 1 before the attention mask."""
    first = {"input_ids": bos_id, "labels": IGNORED, "attention_mask": 1}
    return rows.withColumns({c: F.concat(F.array(F.lit(first[c])), F.col(c)) for c in present(rows)})


def drop_attention_mask(rows: DataFrame) -> DataFrame:
    return rows.drop("attention_mask")


def brief_suffix(rows: DataFrame, suffix: str) -> DataFrame:
    """Append a text to the user messages only."""
    longer = lambda m: F.struct(m["role"].alias("role"), F.concat(m["content"], F.lit(suffix)).alias("content"))
    return rows.withColumn("messages", F.transform("messages", lambda m: F.when(m["role"] == "user", longer(m)).otherwise(m)))


# ---------------------------------------------------------------- stop trimming

# Lambdas below use only their own arguments: a column named inside a lambda may be replaced by the
# expression that made it, and would then be computed anew for every element.

def _first_place(ids: Column, wanted) -> Column:
    """0-based place of the first id that passes ``wanted``; NULL if there is none."""
    return F.array_min(F.transform(ids, lambda x, i: F.when(wanted(x), i)))


def _before_stop(ids: Column, stops: list[int]) -> Column:
    """Number of ids before the first stop id."""
    return F.coalesce(_first_place(ids, lambda x: x.isin(stops)), F.size(ids))


def _skip_left(ids: Column, pad_id: int) -> Column:
    """Without the pad ids at its start."""
    first = F.coalesce(_first_place(ids, lambda x: x != pad_id), F.size(ids))
    return F.slice(ids, first + 1, F.size(ids))


def trim_generation(
    rows: DataFrame, pad_id: int | None, end_of_sequence: int | None, end_of_turn: int | None = None
) -> DataFrame:
    """``generated``: ids of ``full`` after ``prompt``, up to the first stop id.

    The end-of-turn id is the stop where there is one, else the end-of-sequence id. Left padding is
    skipped when the pad id is neither; otherwise the prompt is searched inside ``full``.
    """
    full, prompt = F.col("full"), F.col("prompt")
    if pad_id is not None and pad_id not in (end_of_sequence, end_of_turn):
        rows = rows.withColumns({"full": _skip_left(full, pad_id), "prompt": _skip_left(prompt, pad_id)})
        start = F.size(prompt)
    else:
        n = F.size(prompt)
        offsets = F.sequence(F.lit(0), F.greatest(F.size(full) - n, F.lit(0)))
        found = F.array_min(F.filter(offsets, lambda i: F.slice(full, i + 1, n) == prompt))
        start = F.when(F.size(full) > n, F.coalesce(found + n, n)).otherwise(n)
    rows = rows.withColumn("_start", start)
    rest = F.slice(full, F.col("_start") + 1, F.size(full))
    stop = end_of_turn if end_of_turn is not None else end_of_sequence
    end = F.size(rest) if stop is None else _before_stop(rest, [stop])
    return rows.withColumn("generated", F.slice(rest, F.lit(1), end)).drop("_start")


def trim_infill(
    rows: DataFrame, mask_id: int, pad_id: int | None, end_of_sequence: int | None, end_of_turn: int | None = None
) -> DataFrame:
    """``generated``: ids of ``full`` where ``prompt`` held the mask id, up to the first stop id."""
    if pad_id is not None and pad_id not in (end_of_sequence, end_of_turn):
        rows = rows.withColumns({"full": _skip_left(F.col("full"), pad_id), "prompt": _skip_left(F.col("prompt"), pad_id)})
    pairs = F.zip_with("full", "prompt", lambda x, p: F.struct(x.alias("x"), p.alias("p")))
    hidden = F.filter(pairs, lambda e: e["x"].isNotNull() & (F.coalesce(e["p"], F.lit(-1)) == mask_id))
    rows = rows.withColumn("_filled", F.transform(hidden, lambda e: e["x"]))
    stop = end_of_turn if end_of_turn is not None else end_of_sequence
    end = F.size("_filled") if stop is None else _before_stop(F.col("_filled"), [stop])
    return rows.withColumn("generated", F.slice("_filled", F.lit(1), end)).drop("_filled")


def trim_at_stop(ids: Column, stops: list[int]) -> Column:
    """Cut after the first of several stop ids, which is kept."""
    return F.slice(ids, F.lit(1), F.least(_before_stop(ids, stops) + 1, F.size(ids)))


def remove_header(text: Column, header: str) -> Column:
    return F.when(text.startswith(header), F.substring(text, len(header) + 1, 2**31 - 1)).otherwise(text)


# ---------------------------------------------------------------- prompt and response

def response_rows(rows: DataFrame, role_ids: dict[str, int], mask_prompt: bool = True) -> DataFrame:
    """``input_ids``, ``labels`` and ``prompt_len`` from a ``messages`` array.

    The chat template is a role id before each message's token ids. The prompt is every message but
    the last, with the assistant id after it; its labels are -100.
    """
    roles = F.create_map(*[F.lit(x) for pair in role_ids.items() for x in pair])
    encoded = F.transform("messages", lambda m: F.concat(F.array(roles[m["role"]]), hashed_ids(m["content"])))
    rows = rows.withColumn("_encoded", encoded)
    before = F.slice("_encoded", F.lit(1), F.greatest(F.size("_encoded") - 1, F.lit(0)))
    out = rows.withColumns({"input_ids": F.flatten("_encoded"), "prompt_len": F.size(F.flatten(before)) + 1})
    if not mask_prompt:
        return out.withColumn("labels", F.col("input_ids")).drop("_encoded", "prompt_len")
    return out.withColumn("labels", ignore_prompt("input_ids", F.col("prompt_len"))).drop("_encoded")


def ignore_prompt(ids: str, prompt_len: Column) -> Column:
    """The ids with -100 over the first ``prompt_len`` places."""
    return F.concat(F.array_repeat(F.lit(IGNORED), F.least(prompt_len, F.size(ids))), F.slice(ids, prompt_len + 1, F.size(ids)))


def response_segments(turns: DataFrame, key: str, turn: str, role_ids: dict[str, int]) -> DataFrame:
    """The same rows kept in pieces, one per turn, for conversations of any length.

    ``offset`` is where the piece starts in its conversation and ``prompt_len`` the length of the
    prompt; concatenated by offset, the pieces give the row of ``response_rows``. No conversation is
    gathered into one row or one task.
    """
    roles = F.create_map(*[F.lit(x) for pair in role_ids.items() for x in pair])
    pieces = turns.select(
        key, turn, F.concat(F.array(roles[F.col("role")]), hashed_ids(F.col("text"))).alias("input_ids")
    ).withColumn("n", F.size("input_ids").cast("bigint"))
    stats = {
        "_total": (F.sum("n"), F.sum),
        "_n_last": (F.max_by("n", turn), lambda c: F.max_by(c, BUCKET)),
    }
    placed = running_totals(pieces, [key], turn, {"n": "stop"}, stats=stats)
    placed = placed.withColumns(
        {"offset": F.col("stop") - F.col("n"), "prompt_len": F.col("_total") - F.col("_n_last") + 1}
    )
    inside = F.greatest(F.col("prompt_len") - F.col("offset"), F.lit(0)).cast("int")
    return placed.select(key, turn, "input_ids", "offset", "prompt_len", ignore_prompt("input_ids", inside).alias("labels"))


# ---------------------------------------------------------------- packing and batch cuts

def pack_tokens(
    docs: DataFrame, length: int, group: str, ordinal: str, drop_tail: bool = True, end_id: int | None = None
) -> DataFrame:
    """Concatenate ``ids`` by ordinal inside each group and cut into chunks of ``length``.

    Each text gets its token offset from a running total that is spread over many tasks, is cut at
    the chunk borders it crosses, and only these pieces are grouped: a chunk holds at most
    ``length`` tokens, however large its group is. ``labels`` equal the ids.
    """
    ids = F.col("ids")
    n = F.col("n_tokens") if "n_tokens" in docs.columns else F.size(ids)
    if end_id is not None:
        ended = F.coalesce(F.get(ids, F.size(ids) - 1) == end_id, F.lit(False))
        ids = F.when(ended, ids).otherwise(F.concat(ids, F.array(F.lit(end_id))))
        n = F.size(ids)
    sized = docs.select(group, ordinal, ids.alias("ids"), n.cast("bigint").alias("n")).where("n > 0")
    # Totals run over keys and lengths; the ids join them once, and a row is cut into its pieces before it is exploded.
    totals = running_totals(sized.select(group, ordinal, "n"), [group], ordinal, {"n": "stop"}).select(group, ordinal, "stop")
    placed = sized.join(totals, [group, ordinal]).withColumn("start", F.col("stop") - F.col("n"))
    chunks = F.sequence(F.floor(F.col("start") / length), F.floor((F.col("stop") - 1) / length))

    def cut(chunk: Column) -> Column:
        skip = F.greatest(chunk * length - F.col("start"), F.lit(0))
        upto = F.least((chunk + 1) * length - F.col("start"), F.col("n"))
        return F.struct(chunk.alias("chunk"), F.slice("ids", (skip + 1).cast("int"), (upto - skip).cast("int")).alias("piece"))

    pieces = placed.select(group, "start", F.inline(F.transform(chunks, cut)))
    packed = F.array_sort(F.collect_list(F.struct("start", "piece")))
    out = pieces.groupBy(group, "chunk").agg(F.flatten(packed["piece"]).alias("input_ids"))
    if drop_tail:
        out = out.where(F.size("input_ids") == length)
    return out.withColumn("labels", F.col("input_ids"))


def cut_responses(rows: DataFrame, batch: str, ids: str, seed: int = 42) -> DataFrame:
    """Every response of a batch cut to the response length of one row, drawn by seeded hash."""
    size = F.size("input_ids")
    lengths = rows.groupBy(batch).agg(F.min_by(size - F.col("prompt_len"), seeded_hash(seed, batch, ids)).alias("_kept"))
    keep = F.least(size, F.col("prompt_len") + F.col("_kept"))
    joined = rows.join(lengths, batch).withColumn("_keep", keep)
    return joined.withColumns({c: F.slice(c, F.lit(1), F.col("_keep")) for c in present(rows)}).drop("_kept", "_keep")


def cut_padded_tail(rows: DataFrame, batch: str, pad_id: int, seed: int = 42) -> DataFrame:
    """Rows of a batch padded to its longest, then cut by one random length below its shortest response.

    Batches whose shortest response has one token or none are only padded.
    """
    size = F.size("input_ids")
    stats = rows.groupBy(batch).agg(F.max(size).alias("_long"), F.min(size - F.col("prompt_len")).alias("_short"))
    drawn = 1 + F.pmod(seeded_hash(seed, batch), F.greatest(F.col("_short") - 1, F.lit(1)))
    cut = F.when(F.col("_short") > 1, drawn).otherwise(F.lit(0))
    joined = rows.join(stats.withColumn("_new", (F.col("_long") - cut).cast("int")), batch)
    fill = {"input_ids": pad_id, "labels": IGNORED, "attention_mask": 0}
    padded = lambda c: F.concat(F.col(c), F.array_repeat(F.lit(fill[c]), F.col("_long") - F.size(c)))
    return joined.withColumns({c: F.slice(padded(c), F.lit(1), F.col("_new")) for c in present(rows)}).drop("_long", "_short", "_new")
