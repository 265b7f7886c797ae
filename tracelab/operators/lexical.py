"""ROUGE-L agreement between the main answer of a sample and its alternatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.functions.text import lcs_length, rouge_l, word_tokens
from tracelab.session import KEY

FEATURES = ["MaxRougeLF1", "MeanRougeLF1", "MaxRougeLPrec", "MaxRougeLRec", "RougeLVar"]
BLOCK = 256


def variant_pairs(variants: DataFrame) -> DataFrame:
    """The main answer (variant 0) beside each alternative of the same sample.

    The join key carries a block of 256 variants, and the main answer is repeated once per block it
    needs: ordinary samples have one block, and a sample with very many variants spreads over many
    tasks.
    """
    mains = variants.groupBy(*KEY).agg(
        F.max("variant_no").alias("last"),
        F.max(F.when(F.col("variant_no") == 0, F.col("text"))).alias("main"),
    )
    blocks = F.sequence(F.lit(0), F.floor(F.col("last") / BLOCK).cast("int"))
    mains = mains.where("last > 0").select(*KEY, "main", F.explode(blocks).alias("block"))
    others = variants.where("variant_no > 0").withColumn("block", F.floor(F.col("variant_no") / BLOCK).cast("int"))
    return others.join(mains, [*KEY, "block"]).select(*KEY, "variant_no", "main", F.col("text").alias("other"))


def pair_scores(pairs: DataFrame) -> DataFrame:
    """LCS length, precision, recall and F1 of each pair; the main answer is the candidate."""
    tokens = pairs.withColumns({"a": word_tokens(F.col("main")), "b": word_tokens(F.col("other"))})
    scored = tokens.withColumn("lcs", lcs_length(F.col("a"), F.col("b")))
    return scored.withColumns(rouge_l(F.col("lcs"), F.size("a"), F.size("b"))).drop("a", "b", "main", "other")


def lexical_features(variants: DataFrame) -> DataFrame:
    """Five ROUGE-L features per sample; zeros for samples with fewer than two variants.

    Precision and recall are those of the first alternative with the best F1.
    """
    scores = pair_scores(variant_pairs(variants))
    best = F.max(F.struct("f1", (-F.col("variant_no")).alias("first"), "precision", "recall"))
    found = scores.groupBy(*KEY).agg(
        best.alias("best"), F.avg("f1").alias("mean_f1"), F.var_pop("f1").alias("var_f1")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return variants.select(*KEY).distinct().join(found, KEY, "left").select(
        *KEY,
        zero(F.col("best.f1")).alias("MaxRougeLF1"),
        zero(F.col("mean_f1")).alias("MeanRougeLF1"),
        zero(F.col("best.precision")).alias("MaxRougeLPrec"),
        zero(F.col("best.recall")).alias("MaxRougeLRec"),
        zero(F.col("var_f1")).alias("RougeLVar"),
    )


def variant_lists(variants: DataFrame) -> DataFrame:
    """Ordered variant texts of each sample, for display; one row per sample, whose sampler bounds the list.

    Keyed by sample, never by question text.
    """
    packed = F.array_sort(F.collect_list(F.struct("variant_no", "text")))
    return variants.groupBy(*KEY).agg(packed["text"].alias("variants"))
