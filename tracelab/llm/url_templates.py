"""URL filter by path templates, as DataFrame joins and aggregates.

Rules come first: a rule ``host/path`` fits its host and all subdomains when the path of the url
starts with the rule's path, and the longest rule that fits decides. Pages that no rule decides are judged by a
template tree, grown level by level for each host:

* *generalise*: a segment seen on fewer than ``support`` pages below its node is variable and becomes
  the wildcard ``*`` (with its file extension);
* *merge*: frequent segments whose labelled block rate does not differ from that of their siblings
  (two-proportion z-test) are one branch ``+``; the others, and those without labels, of which
  nothing is known to be similar, stay branches of their own;
* *grow on*: below ``depth`` levels only nodes of ``support`` pages or more with segments left go to the next
  level. In smaller ones every segment is variable, so the rest of a path is its wildcards at once; where the
  rest of all pages of a node is the same, nothing splits any more and ``/**`` stands for it;
* *reject*: a template is blocked if its labelled block rate, smoothed towards one half, reaches ``purity``. Without labels
  the rate is one half, so nothing is blocked on no evidence, whatever the rules say elsewhere.

Labels are the decisions of the rules, or a column of the caller. A host may hold most pages: nodes
are aggregated map-side, and pages join the few frequent branches by salted keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.llm.store import Scratch


@dataclass(frozen=True)
class TemplateTree:
    """Production parameters: levels that every page goes through, pages a literal branch needs, z score that keeps a
    branch apart, weight of one half in labelled pages, smoothed block rate that rejects, salts of a join."""

    depth: int = 4
    support: int = 8
    z: float = 1.96
    prior_weight: float = 4.0
    purity: float = 0.75
    salts: int = 32


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest of (verdict, rule host, rule path) that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])


def _salted_join(pages: DataFrame, small: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """Left join of pages with one row per key; a key's pages are dealt to ``salts`` tasks."""
    left = pages.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def _wildcard(segment: Column) -> Column:
    return F.concat(F.lit("*"), F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1))


def grow(pages: DataFrame, tree: TemplateTree, scratch: Scratch) -> DataFrame:
    """Add ``template`` to pages (page_id, host, path, n, labelled, blocked, ...), one level after another."""
    segments = F.filter(F.split("path", "/", -1), lambda s: s != "")
    rows = scratch.save(pages.withColumns({"template": F.lit(""), "segments": segments}), "level0")
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    ended: list[DataFrame] = []
    for level in range(deepest):
        if level >= tree.depth:
            rows, done = _settle(rows, level, tree, scratch)
            ended.append(done)
            if rows.isEmpty():
                scratch.drop(f"level{level}")
                break
        here = rows.withColumn("segment", F.get("segments", F.lit(level)))
        children = _sums(here.where(F.col("segment").isNotNull()), "host", "template", "segment")
        nodes = _sums(children, "host", "template")
        frequent = children.where(F.col("n") >= tree.support).alias("c").join(nodes.alias("p"), ["host", "template"]).select(
            "host", "template", "segment", _branch(tree).alias("branch"))
        joined = _salted_join(here, frequent, ["host", "template", "segment"], tree.salts)
        step = F.concat(F.lit("/"), F.coalesce("branch", _wildcard(F.col("segment"))))
        rows = scratch.save(
            joined.withColumn("template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", step))).drop("segment", "branch"),
            f"level{level + 1}",
        )
        scratch.drop(f"level{level}")
    for done in ended:
        rows = rows.unionByName(done)
    return rows.drop("segments")


def _settle(rows: DataFrame, level: int, tree: TemplateTree, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pages of nodes that grow on, pages with their whole template) below ``level`` levels."""
    left = F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0)))
    rest = F.concat_ws("", F.transform(left, lambda s: F.concat(F.lit("/"), _wildcard(s))))
    waiting = F.size("segments") > level
    path = F.concat_ws("/", left)
    nodes = rows.where(waiting).groupBy("host", "template").agg(
        F.sum("n").alias("_n"), (F.min(path) == F.max(path)).alias("_one"), (F.min(rest) == F.max(rest)).alias("_same"))
    # One and the same path all the way down splits nowhere either, however many pages have it.
    state = F.when(F.col("_one") | ((F.col("_n") < tree.support) & F.col("_same")), F.lit("whole")).when(F.col("_n") < tree.support, F.lit("rest")).otherwise(F.lit("grow"))
    joined = _salted_join(rows, nodes.select("host", "template", state.alias("_state")), ["host", "template"], tree.salts)
    joined = joined.withColumn("_state", F.when(waiting, F.col("_state")).otherwise(F.lit("end")))
    kept = scratch.save(joined, f"settled{level}")
    more = F.when(F.col("_state") == "whole", F.lit("/**")).when(F.col("_state") == "rest", rest).otherwise(F.lit(""))
    done = kept.where(F.col("_state") != "grow").withColumn("template", F.concat("template", more)).drop("_state")
    return kept.where(F.col("_state") == "grow").drop("_state"), done


def _branch(tree: TemplateTree) -> Column:
    """The segment itself if its block rate differs from that of its siblings, else the merged branch."""
    n1, k1 = F.col("c.labelled"), F.col("c.blocked")
    n2, k2 = F.col("p.labelled") - n1, F.col("p.blocked") - k1
    pooled = F.try_divide(F.col("p.blocked"), F.col("p.labelled"))
    variance = pooled * (1 - pooled) * (F.try_divide(F.lit(1), n1) + F.try_divide(F.lit(1), n2))
    gap = F.try_divide(k1, n1) - F.try_divide(k2, n2)  # null without labels on either side
    apart = (gap != 0) & (gap * gap >= F.lit(tree.z**2) * variance)
    return F.when((n1 == 0) | F.coalesce(apart, F.lit(False)), F.col("segment")).otherwise(F.lit("+"))


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], tree: TemplateTree = TemplateTree(), label: str | None = None
) -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict, template, purity).

    ``rules`` are (verdict, host, path) with verdict ``allow`` or ``block``. ``label`` names a column
    of 0/1 block labels; by default a page is labelled by the rule that decides it. A null url and
    one without ``://`` have an empty host and path and are judged together like one host. Rows with null or
    repeated ids are judged like any other; an empty table gives an empty result; further columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "url-templates")
    url = F.col("url").cast("string")
    base = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"),
        (F.col(label).cast("int") if label else F.lit(None).cast("int")).alias("_given"),
    ).withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    known = F.col("_given") if label else (F.col("_rule.verdict") == "block").cast("int")
    base = base.withColumns({
        "n": F.lit(1).cast("bigint"),
        "labelled": known.isNotNull().cast("bigint"),
        "blocked": F.coalesce(known, F.lit(0)).cast("bigint"),
    })
    grown = grow(base.drop("_given"), tree, scratch)
    templates = _sums(grown, "host", "template")
    rate = (F.col("blocked") + F.lit(tree.prior_weight / 2)) / (F.col("labelled") + F.lit(tree.prior_weight))
    rated = templates.select("host", "template", rate.alias("purity"))
    judged = _salted_join(grown.drop("n", "labelled", "blocked"), rated, ["host", "template"], tree.salts)
    by_method = F.when(F.col("purity") >= tree.purity, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", by_method).alias("verdict"), "template", "purity",
    )


def judge_sql(rules: Sequence[tuple[str, str, str]], tree: TemplateTree = TemplateTree()) -> str:
    """DuckDB SQL for the first five columns of ``judge`` over the table ``pages``."""
    cases = "".join(
        f" WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN struct_pack(rule := '{h}{p}', verdict := '{v}')"
        for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    )
    branch = f"""CASE WHEN n < {tree.support} THEN '*' || regexp_extract(segment, '(\\.[A-Za-z]{{1,5}})$', 1) WHEN l = 0 THEN segment
      WHEN pl > l AND b * (pl - l) <> (pb - b) * l
        AND pow(b / l - (pb - b) / (pl - l), 2) >= {tree.z**2!r} * ((pb / pl) * (1 - pb / pl) * (1 / l + 1 / (pl - l))) THEN segment ELSE '+' END"""
    return f"""WITH RECURSIVE parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, CASE{cases} END AS r FROM parsed),
grown(page_id, host, path, r, labelled, blocked, segments, d, template) AS (
  SELECT page_id, host, path, r, (r IS NOT NULL)::BIGINT, coalesce(r.verdict = 'block', false)::BIGINT, list_filter(string_split(path, '/'), lambda s: s <> ''), 0, '' FROM ruled
  UNION ALL
  SELECT page_id, host, path, r, labelled, blocked, segments, d + 1, template || '/' || {branch} FROM (
    SELECT *, segments[d + 1] AS segment, count(*) OVER child AS n, sum(labelled) OVER child AS l, sum(blocked) OVER child AS b,
      sum(labelled) OVER node AS pl, sum(blocked) OVER node AS pb
    FROM grown WHERE len(segments) > d WINDOW child AS (PARTITION BY host, template, segments[d + 1]), node AS (PARTITION BY host, template))),
whole AS (SELECT * FROM grown WHERE d = len(segments)),
rated AS (SELECT host, template, (sum(blocked) + {tree.prior_weight / 2!r}) / (sum(labelled) + {tree.prior_weight!r}) AS purity FROM whole GROUP BY ALL)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN purity >= {tree.purity!r} THEN 'block' ELSE 'allow' END) AS verdict
FROM whole JOIN rated USING (host, template)"""
