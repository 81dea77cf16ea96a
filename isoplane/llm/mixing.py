"""Mixing sources to target weights by hierarchical budgeting.

Sources form a tree: domain, language, source.  A token budget flows from the root to the leaves.  At each node it is
split among the children by weight; a child that cannot use its share (its tokens times ``max_epochs``) is filled up and
its shortage goes to its siblings by their weights, and only what the whole node cannot use goes back to the node's own
siblings.  That is one water level per node, found in closed form with a window over the children sorted by
capacity/weight.  A leaf's budget becomes whole epochs and a token prefix of one more: each epoch has its own seeded
order of the documents, and the longest prefix that fits the rest of the budget is taken.

No task sees a whole leaf: the order is a hash, its leading digits cut a leaf into buckets of a few thousand documents,
bucket sums place the end of the prefix, and only the bucket in which it ends is sorted.  The leaf table is as large as
the tree, not the corpus, and is broadcast only when counted to be at most ``BROADCAST_LEAVES`` rows.  Documents are
never shuffled except those of the end buckets.

Edge cases: null languages and sources are a leaf ``(none)`` of their own; a document without words has nothing to train
on and is never selected; unlisted names take the default weight and a weight of zero excludes a node; a null ``doc_id``
orders as an empty id; repeated rows are documents of their own; a budget above what the tree can give takes every
document ``max_epochs`` times; columns that clash with the result's are kept under their own names, the result's are
numbered.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoplane.checkpoints import cut

from .common import own_name, quoted

#: Aimed-at documents in a bucket of the seeded order.
BUCKET = 4096
BROADCAST_LEAVES = 50_000
NONE = "(none)"


@dataclass(frozen=True)
class MixPlan:
    """Integer weights by name on each level of the tree, the budget as a share of all tokens, and the seed."""

    domains: dict[str, int] = field(default_factory=lambda: {"web": 50, "books": 30, "code": 20})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 40, "de": 25, "fr": 20, "es": 15})
    sources: dict[str, int] = field(default_factory=dict)
    default_weight: int = 10
    share: float = 0.75
    max_epochs: int = 3
    seed: int = 20


def domain_of(source: Column) -> Column:
    """The default domain of a source: by the last digit of its name."""
    digit = F.regexp_extract(source, "([0-9])$", 1)
    return F.when(digit.isin("0", "1", "2", "3"), "web").when(digit.isin("4", "5", "6"), "books").when(digit != "", "code").otherwise("other")


def _weight(name: Column, weights: dict[str, int], default: int) -> Column:
    found = F.lit(default)
    for key, value in weights.items():
        found = F.when(name == key, value).otherwise(found)
    return found.cast("double")


def fill(nodes: DataFrame, parent: list[str], name: str, budget: str, out: str) -> DataFrame:
    """Split each parent's ``budget`` among its nodes (``cap``, ``w``); adds the column ``out``."""
    ratio = F.col("cap") / F.col("w")
    order = Window.partitionBy(*parent).orderBy("ratio", name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.max(F.when(F.col("lam") < F.col("ratio"), F.col("lam"))).over(Window.partitionBy(*parent))
    return (
        nodes.withColumn("ratio", ratio)
        .withColumn("lam", (F.col(budget) - before) / rest)
        .withColumn("level", level)
        .withColumn(out, F.when(F.col("lam") >= F.col("ratio"), F.col("cap")).otherwise(F.col("level") * F.col("w")))
        .drop("ratio", "lam", "level")
    )


def budgets(leaves: DataFrame, plan: MixPlan) -> DataFrame:
    """``(d, l, s, tokens, rows, budget)`` from leaf sums ``(d, l, s, tokens, rows)``."""
    leaves = (
        leaves.withColumn("wd", _weight(F.col("d"), plan.domains, plan.default_weight))
        .withColumn("wl", _weight(F.col("l"), plan.languages, plan.default_weight))
        .withColumn("ws", _weight(F.col("s"), plan.sources, plan.default_weight))
        .withColumn("all", F.floor(F.sum("tokens").over(Window.partitionBy()) * F.lit(plan.share)).cast("double"))
        .where("wd > 0 and wl > 0 and ws > 0")
        .withColumn("cap", (F.col("tokens") * plan.max_epochs).cast("double"))
    )
    top = leaves.groupBy("d").agg(F.sum("cap").alias("cap"), F.max("wd").alias("w"), F.max("all").alias("all"))
    top = fill(top, [], "d", "all", "bd").select("d", "bd")
    middle = leaves.groupBy("d", "l").agg(F.sum("cap").alias("cap"), F.max("wl").alias("w")).join(top, "d")
    middle = fill(middle, ["d"], "l", "bd", "bl").select("d", "l", "bl")
    bottom = leaves.withColumn("w", F.col("ws")).join(middle, ["d", "l"])
    return fill(bottom, ["d", "l"], "s", "bl", "bs").select("d", "l", "s", "tokens", "rows", F.floor(F.col("bs") + F.lit(1e-6)).cast("long").alias("budget"))



def select(docs: DataFrame, plan: MixPlan = MixPlan(), domain: Column | None = None) -> DataFrame:
    """The mixture: the columns of ``docs`` with ``domain``, ``tokens`` and ``epoch``, one row for each use of a document."""
    domain = domain_of(F.col("source")) if domain is None else domain
    leaf = [domain.alias("d"), F.coalesce("lang", F.lit(NONE)).alias("l"), F.coalesce("source", F.lit(NONE)).alias("s")]
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), 0))

    # what the budgets need of each document, without its text
    narrow = cut(docs.select(*leaf, words.alias("tokens"), "doc_id", F.md5(F.col("text").cast("binary")).alias("m"))).where("tokens > 0")
    leaves = narrow.groupBy("d", "l", "s").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    ready = cut(
        budgets(leaves, plan)
        .withColumn("full", F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(plan.max_epochs)).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
        .withColumn("digits", F.greatest(F.lit(1), F.ceil(F.log(F.col("rows") / BUCKET) / math.log(16))).cast("int"))
    )
    few = ready.count() <= BROADCAST_LEAVES

    def with_leaf(df: DataFrame, table: DataFrame) -> DataFrame:
        return df.join(F.broadcast(table) if few else table, ["d", "l", "s"])

    def key(m: str) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(plan.seed)), (F.col("full") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(m)).cast("binary"))

    bucket = F.expr("substring(key, 1, digits)")
    sums = (
        with_leaf(narrow, ready.where("rest > 0").select("d", "l", "s", "full", "digits"))
        .withColumn("key", key("m"))
        .groupBy("d", "l", "s", bucket.alias("bucket"))
        .agg(F.sum("tokens").alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("d", "l", "s").orderBy("bucket"))
    ends = (
        with_leaf(sums.withColumn("upto", upto), ready.select("d", "l", "s", "rest"))
        .where("upto > rest")
        .groupBy("d", "l", "s")
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("end"))
    )
    table = cut(ready.join(ends, ["d", "l", "s"], "left").select("d", "l", "s", "full", "rest", "digits", "end"))

    taken = docs.columns
    names = {n: own_name(n, taken) for n in ("domain", "tokens", "epoch")}
    placed = docs.select(F.struct(*quoted(docs.columns)).alias("row"), *leaf, words.alias("tokens"), "doc_id", F.md5(F.col("text").cast("binary")).alias("m"))
    placed = with_leaf(placed, table).withColumn("key", key("m")).withColumn("bucket", bucket)
    extra = F.when((F.col("rest") > 0) & (F.col("bucket") < F.col("end.bucket")), 1).otherwise(0)
    at_end = F.coalesce(F.col("bucket") == F.col("end.bucket"), F.lit(False)) & (F.col("rest") > 0)
    cumulative = F.sum("tokens").over(Window.partitionBy("d", "l", "s").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    plain = placed.where(~at_end).withColumn("uses", F.col("full") + extra)
    last = placed.where(at_end).withColumn("upto", cumulative + F.col("end.before"))
    last = last.withColumn("uses", F.col("full") + (F.col("upto") <= F.col("rest")).cast("int")).drop("upto")
    # unused documents have no epoch; a filter on the counts would be pushed down to the scan and count every text twice
    epochs = F.when((F.col("uses") > 0) & (F.col("tokens") > 0), F.sequence(F.lit(1), F.greatest("uses", F.lit(1))))
    return plain.unionByName(last).withColumn("epoch", F.explode(epochs)).select(
        *[F.col("row")[c].alias(c) for c in docs.columns], F.col("d").alias(names["domain"]), F.col("tokens").alias(names["tokens"]), F.col("epoch").alias(names["epoch"])
    )


def oracle(plan: MixPlan = MixPlan(), columns: str = "doc_id, d AS domain, lang, source, tokens, epoch", docs: str = "documents") -> str:
    """DuckDB SQL for the same mixture, with plain running sums over each leaf."""

    def weight(name: str, weights: dict[str, int]) -> str:
        return "CASE" + "".join(f" WHEN {name} = '{k}' THEN {v}.0" for k, v in weights.items()) + f" ELSE {plan.default_weight}.0 END" if weights else f"{plan.default_weight}.0"

    def filled(source: str, parent: str, name: str, budget: str, out: str) -> str:
        part = f"PARTITION BY {parent}" if parent else ""
        return (
            f"SELECT *, CASE WHEN lam >= ratio THEN cap ELSE max(CASE WHEN lam < ratio THEN lam END) OVER ({part}) * w END AS {out} FROM ("
            f"SELECT *, cap / w AS ratio, ({budget} - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))"
            f" / sum(w) OVER ({part} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM {source})"
        )

    def double(x: str) -> str:
        return f"CAST({x} AS DOUBLE)"

    return f"""
WITH base AS (
  SELECT *, CASE WHEN regexp_matches(source, '[0-3]$') THEN 'web' WHEN regexp_matches(source, '[4-6]$') THEN 'books'
      WHEN regexp_matches(source, '[7-9]$') THEN 'code' ELSE 'other' END AS d,
    coalesce(lang, '{NONE}') AS l, coalesce(source, '{NONE}') AS s,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS INTEGER) AS tokens
  FROM {docs}),
used AS (SELECT * FROM base WHERE tokens > 0),
leaf0 AS (SELECT d, l, s, CAST(sum(tokens) AS BIGINT) AS t FROM used GROUP BY ALL),
leaf AS (
  SELECT *, {double(weight('d', plan.domains))} AS wd, {double(weight('l', plan.languages))} AS wl, {double(weight('s', plan.sources))} AS ws,
    {double(f'floor((SELECT sum(t) FROM leaf0) * {plan.share!r})')} AS total, {double(f't * {plan.max_epochs}')} AS cap FROM leaf0),
dom AS (SELECT d, sum(cap) AS cap, max(wd) AS w, max(total) AS total FROM leaf GROUP BY d),
domf AS ({filled('dom', '', 'd', 'total', 'bd')}),
lan AS (SELECT x.*, bd FROM (SELECT d, l, sum(cap) AS cap, max(wl) AS w FROM leaf GROUP BY d, l) x JOIN domf USING (d)),
lanf AS ({filled('lan', 'd', 'l', 'bd', 'bl')}),
src AS (SELECT leaf.d, leaf.l, s, t, leaf.cap, ws AS w, bl FROM leaf JOIN lanf ON leaf.d = lanf.d AND leaf.l = lanf.l),
srcf AS ({filled('src', 'd, l', 's', 'bl', 'bs')}),
plan AS (SELECT d, l, s, t, b, least(CAST(floor(b / t) AS BIGINT), {plan.max_epochs}) AS fulls
  FROM (SELECT *, CAST(floor(bs + 1e-6) AS BIGINT) AS b FROM srcf)),
ranked AS (
  SELECT u.*, fulls, b - fulls * t AS rest, sum(tokens) OVER (PARTITION BY u.d, u.l, u.s ORDER BY
    md5(concat_ws('|', '{plan.seed}', CAST(fulls + 1 AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''), md5(text))) ROWS UNBOUNDED PRECEDING) AS upto
  FROM used u JOIN plan p ON u.d = p.d AND u.l = p.l AND u.s = p.s)
SELECT {columns} FROM (
  SELECT *, CAST(unnest(range(1, fulls + 1 + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS INTEGER) AS epoch FROM ranked)
"""
