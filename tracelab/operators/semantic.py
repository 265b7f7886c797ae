"""Token distributions, token clusters, semantic dispersion and answer-variant clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.functions.skew import hot_keys, lookup_join, skew_join
from tracelab.functions.text import strip, word_tokens
from tracelab.session import KEY, materialize, written

# Floors of the token entropy, the cluster mass, the cluster entropy and the variant entropy.
TOKEN_FLOOR = 1e-8
MASS_FLOOR = 1e-14
CLUSTER_FLOOR = 1e-10
VARIANT_FLOOR = 1e-12


def token_entropy(dist: DataFrame, keys: list[str] = KEY) -> DataFrame:
    p = F.col("p")
    return dist.groupBy(*keys).agg((-F.sum(p * F.ln(p + TOKEN_FLOOR))).alias("entropy"))


def map_tokens(dist: DataFrame, clusters: DataFrame) -> DataFrame:
    """Token to cluster; tokens without a cluster are dropped."""
    spread = [c for c in dist.columns if c != "token"]
    return lookup_join(dist, clusters.select("token", "cluster"), ["token"], spread)


def cluster_rollup(dist: DataFrame, clusters: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Cluster entropy, best cluster (lowest id on ties) and its probability.

    Cluster ids run from 0 to the highest id; those without mass count with the floor.
    """
    n_clusters = clusters.agg(F.max("cluster") + 1).scalar()
    mass = map_tokens(dist, clusters).groupBy(*keys, "cluster").agg((F.sum("p") + MASS_FLOOR).alias("q"))
    seen = mass.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seen"),
        (-F.sum(F.col("q") * F.ln(F.col("q") + CLUSTER_FLOOR))).alias("part"),
        F.max(F.struct("q", (-F.col("cluster")).alias("neg"))).alias("best"),
    )
    empty = F.lit(-MASS_FLOOR) * F.ln(F.lit(MASS_FLOOR + CLUSTER_FLOOR))
    return seen.select(
        *keys,
        F.col("best.q").alias("sem_prob"),
        (F.col("part") + (n_clusters - F.col("n_seen")) * empty).alias("sem_entropy"),
        (-F.col("best.neg")).alias("sem_label"),
    )


def normalise(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """L2-normalised token vectors."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    norms = F.array_repeat(norm, F.size(vector))  # not inside the lambda, which would compute it per element
    return vectors.withColumn(vector, F.zip_with(vector, norms, lambda x, n: x / n))


def semantic_dispersion(dist: DataFrame, vectors: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """1 - |sum p e|^2 over normalised token vectors e, at least 0.

    The weighted vector sum is a partial aggregate, so dimensions are never exploded into rows.
    """
    packed = vectors.select("token", array_to_vector("vector").alias("vec"))
    joined = skew_join(dist, packed, ["token"], keys)
    total = vector_to_array(Summarizer.sum(F.col("vec"), F.col("p")))
    return joined.groupBy(*keys).agg(total.alias("total")).select(
        *keys,
        F.greatest(
            F.lit(0.0), 1.0 - F.aggregate("total", F.lit(0.0), lambda s, x: s + x * x)
        ).alias("sem_dispersion"),
    )


def token_set_key(text: str = "text"):
    """Default equivalence of two answers: the same set of words."""
    return F.array_join(F.array_sort(F.array_distinct(word_tokens(F.col(text)))), " ")


def cluster_variants(variants: DataFrame) -> DataFrame:
    """(sample, variant_no, cluster) under the default equivalence; the id is the first variant number.

    Equal word sets are an equivalence relation, so the greedy order does not matter and a group-by
    on the set replaces all pair comparisons. Blank texts stay alone. The sets are written once, since
    three passes read them.
    """
    blank = strip(F.col("text")) == ""
    own = F.concat(F.lit("#"), F.col("variant_no").cast("string"))
    keyed = written(variants.select(*KEY, "variant_no", F.when(blank, own).otherwise(token_set_key()).alias("_key")))
    firsts = keyed.groupBy(*KEY, "_key").agg(F.min("variant_no").alias("cluster"))
    return skew_join(keyed, firsts, [*KEY, "_key"], ["variant_no"]).drop("_key")


PairScorer = Callable[[DataFrame], DataFrame]


def greedy_clusters(variants: DataFrame, scorer: PairScorer) -> DataFrame:
    """Greedy clusters under any pair test, in variant order.

    ``scorer`` gets rows with ``premise`` and ``hypothesis`` and adds a boolean ``entails``. Round by
    round, the first text left in each sample represents a cluster and is compared, both ways, with
    the other texts left there; the ones that match join it. This gives the same clusters as trying
    the representatives in order for each text, with one representative per sample and round
    instead of all pairs. Repeats of a text follow its first occurrence; blank texts stay alone.
    """
    blank = strip(F.col("text")) == ""
    alone = variants.where(blank).select(*KEY, "variant_no", F.col("variant_no").alias("cluster"))
    spoken = variants.where(~blank).withColumn("_t", strip(F.col("text")))
    left = materialize(spoken.groupBy(*KEY, "_t").agg(F.min("variant_no").alias("no")))
    hot = hot_keys(left, KEY)
    done = []
    while not left.isEmpty():
        reps = left.groupBy(*KEY).agg(F.min("no").alias("cluster"), F.min_by("_t", "no").alias("rep"))
        pairs = skew_join(left, reps, KEY, ["_t"], hot=hot)
        same = F.col("no") == F.col("cluster")
        both = pairs.where(~same).select(
            *KEY, "_t", "no", "cluster",
            F.explode(
                F.array(
                    F.struct(F.col("_t").alias("premise"), F.col("rep").alias("hypothesis")),
                    F.struct(F.col("rep").alias("premise"), F.col("_t").alias("hypothesis")),
                )
            ).alias("pair"),
        ).select(*KEY, "_t", "no", "cluster", "pair.premise", "pair.hypothesis")
        verdict = scorer(both).groupBy(*KEY, "_t", "no", "cluster").agg(F.bool_and("entails").alias("joins"))
        firsts = pairs.where(same).select(*KEY, "_t", "no", "cluster", F.lit(True).alias("joins"))
        judged = materialize(firsts.unionByName(verdict))
        done.append(judged.where("joins").select(*KEY, "_t", "cluster"))
        left = judged.where("NOT joins").select(*KEY, "_t", "no")
    if not done:
        return alone
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    placed = skew_join(spoken, found, [*KEY, "_t"], ["variant_no"])
    return placed.select(*KEY, "variant_no", "cluster").unionByName(alone)


def token_set_scorer(pairs: DataFrame) -> DataFrame:
    """The default pair test in the form of a scorer."""
    return pairs.withColumn("entails", token_set_key("premise") == token_set_key("hypothesis"))


def python_scorer(score: Callable, schema: str = "double") -> PairScorer:
    """Wrap a model call over two pandas series (premise, hypothesis -> score) as a scorer.

    The call runs on Arrow batches inside the tasks; score > 0.5 means entailment.
    """

    def apply(pairs: DataFrame) -> DataFrame:
        columns = pairs.columns

        def batches(frames):
            for frame in frames:
                frame["entails"] = [bool(s > 0.5) for s in score(frame["premise"], frame["hypothesis"])]
                yield frame[[*columns, "entails"]]

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
        return pairs.mapInPandas(batches, f"{fields}, entails boolean")

    return apply


def semantic_entropy(clustered: DataFrame) -> DataFrame:
    """-sum p ln(p + 1e-12) over the cluster shares of each sample."""
    sizes = clustered.groupBy(*KEY, "cluster").agg(F.count(F.lit(1)).alias("n"))
    sizes = skew_join(sizes, sizes.groupBy(*KEY).agg(F.sum("n").alias("total")), KEY, ["cluster"])
    share = F.col("n") / F.col("total")
    return sizes.groupBy(*KEY).agg((-F.sum(share * F.ln(share + VARIANT_FLOOR))).alias("semantic_entropy"))


def results_with_default(questions: DataFrame, detail: DataFrame) -> DataFrame:
    """Every question with its variants, clusters and entropy; empty lists and 0.0 where missing."""
    none = F.array().cast("array<string>")
    return questions.join(detail, KEY, "left").select(
        *questions.columns,
        F.coalesce("variants", none).alias("variants"),
        F.coalesce("semantic_entropy", F.lit(0.0)).alias("semantic_entropy"),
    )
