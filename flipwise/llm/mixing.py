"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The levels (domain, language, source) form a tree; each node has an integer
weight relative to its siblings and a capacity, the tokens below it times the
epochs allowed.  Going down, a node's budget is shared among its children in
proportion to their weights; a child that cannot use its share is filled up
and its shortage goes to its siblings, so ancestors share a shortage only
when the whole subtree is full.

A leaf takes whole epochs of its documents, then a prefix of one more: the
documents in the order of a hash seeded per epoch, as long as their running
token sum stays within the budget.  The end of the prefix is found by radix:
token sums per first hash byte, then per second byte inside one of those,
then the single rows of one 65,536th of the leaf, so a leaf that holds a
third of all rows never goes through one task.

All token arithmetic is on integers, hence exact and the same at every
partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, row_of, stored, whole_text

NONE = "(none)"


def text_tokens(text_col: str = "text") -> Column:
    """Token estimate of a whole text: one for every four bytes begun; empty and null texts have none."""
    return F.shiftright(F.octet_length(whole_text(text_col)) + 3, 2).cast("long")


def _weight(path: Column, weights: Mapping[str, int], default: int) -> Column:
    if not weights:
        return F.lit(default).cast("long")
    table = F.create_map(*(F.lit(x) for pair in sorted(weights.items()) for x in pair))
    return F.coalesce(F.element_at(table, path), F.lit(default)).cast("long")


def _share(children: DataFrame, parent: list[str], node: str) -> DataFrame:
    """Adds ``budget`` to children with ``parent_budget``, ``capacity``, ``weight``: proportional, filled-up ones first.

    In order of capacity per weight the filled children come first: a child is
    full if its capacity is at most its share of what the ones before leave.
    Children are dealt out by sampled ranges of (parent, ratio, node); running
    sums over the ranges of a parent, then inside one range, give what the ones
    before use, so no task holds all children of a node that has millions.
    """
    children = children.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(1e308)))
    dealt = stored(children.repartitionByRange(*parent, "ratio", node).withColumn("range", F.spark_partition_id()), "mixing-children")
    sums = dealt.groupBy(*parent, "range").agg(F.sum("capacity").alias("c"), F.sum("weight").alias("w"))
    earlier = Window.partitionBy(*parent).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.select(*parent, "range", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c_before"),
                         (F.sum("w").over(Window.partitionBy(*parent)) - F.coalesce(F.sum("w").over(earlier), F.lit(0))).alias("w_from"))
    before = Window.partitionBy(*parent, "range").orderBy("ratio", node).rowsBetween(Window.unboundedPreceding, -1)
    step = dealt.join(ranges, [*parent, "range"]).withColumns({
        "used": F.col("c_before") + F.coalesce(F.sum("capacity").over(before), F.lit(0)),
        "rest_weight": F.col("w_from") - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    step = step.withColumn("full", (F.col("weight") > 0) &
                           (F.col("capacity") * F.col("rest_weight") <= (F.col("parent_budget") - F.col("used")) * F.col("weight")))
    step = stored(step.drop("range", "c_before", "w_from", "ratio", "used", "rest_weight"), "mixing-full")
    totals = (step.groupBy(*parent) if parent else step.groupBy()).agg(
        F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))), F.lit(0)).alias("full_tokens"),
        F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0)).alias("open_weight"))
    step = step.join(totals, parent) if parent else step.crossJoin(F.broadcast(totals))  # one row
    share = F.expr("CASE WHEN full THEN capacity WHEN weight = 0 OR open_weight = 0 THEN 0 "
                   "ELSE ((parent_budget - full_tokens) * weight) div open_weight END")
    return step.withColumn("budget", share.cast("long")).drop("full", "full_tokens", "open_weight")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: Mapping[str, int], target: int | None, fraction: float | None,
                 max_epochs: int, default_weight: int = 1) -> DataFrame:
    """Per leaf: its levels, available, budget, epochs (whole ones), rest (tokens of one more).

    ``weights`` maps node paths ("web", "web/en", "web/en/src0") to integers.
    The table has one row per leaf.
    """
    first = leaves.agg((F.sum("available") * max_epochs).alias("all"), F.sum("available").alias("once"))
    goal = F.lit(target).cast("long") if target is not None else F.floor(F.col("once") * F.lit(fraction)).cast("long")
    root = first.select(F.least(goal, F.col("all")).alias("parent_budget"))
    node = None
    for depth in range(1, len(levels) + 1):
        at = levels[:depth]
        here = leaves.groupBy(*at).agg((F.sum("available") * max_epochs).alias("capacity"))
        here = here.withColumn("weight", _weight(F.concat_ws("/", *at), weights, default_weight))
        above = root if node is None else node.select(*levels[:depth - 1], F.col("budget").alias("parent_budget"))
        joined = here.crossJoin(F.broadcast(above)) if node is None else here.join(above, levels[:depth - 1])  # one row
        node = _share(joined, levels[:depth - 1], levels[depth - 1])
    out = node.join(leaves, levels)
    whole = F.expr("CASE WHEN available = 0 THEN 0 ELSE budget div available END")
    return out.select(*levels, "available", "budget", whole.cast("int").alias("epochs"),
                      (F.col("budget") - whole * F.col("available")).alias("rest"))


def _cut(sums: DataFrame, bucket: str, levels: list[str], rest: str) -> DataFrame:
    """The bucket in which each leaf's prefix ends, and the tokens left for it; buckets before it are taken whole."""
    order = Window.partitionBy(*levels).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    inside = (F.col("before") <= F.col(rest)) & (F.col(rest) < F.col("before") + F.col("tokens"))
    return ends.where(inside).select(*levels, bucket, (F.col(rest) - F.col("before")).alias("left"))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, int], *, target: int | None = None,
        fraction: float | None = None, max_epochs: int = 1, seed: int = 0, tokens: Column | None = None,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the budgets take, all their columns, and ``__n_tokens`` and ``__epochs``, how often each is taken.

    Where ``docs`` has a column of one of these two names, in any case, the
    added one gets underscores behind its name (``common.free_name``); the
    columns of ``docs`` keep their names and values whatever they are called.

    ``target`` gives the budget in tokens, else ``fraction`` of those in the
    table.  A null level counts as the value "(none)".  Rows that repeat both
    id and text share their place in the order: they are taken together or
    not at all.  Texts without tokens cost nothing.  An empty table gives no rows.
    """
    if (target is None) == (fraction is None):
        raise ValueError("give either target or fraction")
    names = [f"__level_{i}" for i in range(len(levels))]
    tokens = tokens if tokens is not None else text_tokens(text_col)
    identity = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(whole_text(text_col)))
    rows = docs.select(row_of(docs).alias("__row"), *(F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in zip(names, levels.values())),
                       F.coalesce(tokens, F.lit(0)).cast("long").alias("__tokens"), identity.alias("__identity"))
    leaves = stored(rows.groupBy(*names).agg(F.sum("__tokens").alias("available")), "mixing-leaves")
    budgets = stored(leaf_budgets(leaves, names, weights, target, fraction, max_epochs), "mixing-budgets")
    with_budget = rows.join(budgets.select(*names, F.col("epochs").alias("__whole"), F.col("rest").alias("__rest")), names)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__whole").cast("string"), F.col("__identity")))
    keyed = stored(with_budget.where("__rest > 0").select(*names, F.col("__rest").alias("rest"), order.alias("key"), F.col("__tokens").alias("tokens")), "mixing-keys")
    first = keyed.withColumn("b1", F.substring("key", 1, 2)).groupBy(*names, "rest", "b1").agg(F.sum("tokens").alias("tokens"))
    cut1 = _cut(first, "b1", names, "rest")
    in1 = keyed.drop("rest").withColumn("b1", F.substring("key", 1, 2)).join(cut1, [*names, "b1"])
    second = in1.withColumn("b2", F.substring("key", 3, 2)).groupBy(*names, "b1", "left", "b2").agg(F.sum("tokens").alias("tokens"))
    cut2 = _cut(second.withColumnRenamed("left", "room"), "b2", [*names, "b1"], "room")
    in2 = keyed.drop("rest").withColumns({"b1": F.substring("key", 1, 2), "b2": F.substring("key", 3, 2)}).join(cut2, [*names, "b1", "b2"])
    upto = Window.partitionBy(*names).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    over = in2.withColumn("sum", F.sum("tokens").over(upto)).where(F.col("sum") > F.col("left"))
    # the first key that no longer fits; a leaf without one is taken whole (its rest is 0 then, by its number of epochs)
    ends = stored(over.groupBy(*names).agg(F.min("key").alias("__end")), "mixing-ends")
    taken = F.col("__whole") + F.when((F.col("__rest") > 0) & (F.col("__end").isNull() | (order < F.col("__end"))), 1).otherwise(0)
    return with_budget.join(ends, names, "left").withColumn("__epochs", taken).where("__epochs > 0") \
        .select("__row.*", F.col("__tokens").alias(free_name(docs, "__n_tokens")), F.col("__epochs").cast("int").alias(free_name(docs, "__epochs")))


# The tree of the registered query and of the pipeline: a domain is given by the last character of the source.
DOMAINS = ("web", "books", "news", "forums")
WEIGHTS = {"web": 4, "books": 3, "news": 2, "forums": 1,
           "web/en": 5, "web/de": 2, "web/fr": 2, "web/es": 1, "books/en": 4, "news/en": 4, "forums/en": 4,
           "web/en/src0": 3}
FRACTION, EPOCHS, SEED = 0.6, 2, 17


def document_levels() -> dict[str, Column]:
    domain = F.element_at(F.array(*(F.lit(d) for d in DOMAINS)), F.pmod(F.ascii(F.right("source", F.lit(1))), F.lit(4)) + 1)
    return {"domain": F.when(F.col("source").isNotNull(), domain), "lang": F.col("lang"), "source": F.col("source")}


def mixing_sql() -> str:
    """The registered query in DuckDB SQL: same tree, same integer arithmetic, one window where the query goes by radix."""
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(WEIGHTS.items()))
    domain = "CASE ascii(right(source, 1)) % 4 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DOMAINS)) + " END"

    def share(name: str, source: str, parent: str, node: str) -> str:
        return f"""{name}_a AS (SELECT *, CASE WHEN weight > 0 THEN capacity / weight ELSE 1e308 END AS ratio FROM {source}),
{name}_b AS (SELECT *, coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY ratio, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  sum(weight) OVER (PARTITION BY {parent} ORDER BY ratio, {node} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight FROM {name}_a),
{name}_c AS (SELECT *, weight > 0 AND capacity * rest_weight <= (parent_budget - used) * weight AS filled FROM {name}_b),
{name}_d AS (SELECT *, coalesce(sum(CASE WHEN filled THEN capacity END) OVER (PARTITION BY {parent}), 0) AS full_tokens,
  coalesce(sum(CASE WHEN NOT filled THEN weight END) OVER (PARTITION BY {parent}), 0) AS open_weight FROM {name}_c),
{name} AS (SELECT *, CASE WHEN filled THEN capacity WHEN weight = 0 OR open_weight = 0 THEN 0
  ELSE ((parent_budget - full_tokens) * weight) // open_weight END AS budget FROM {name}_d)"""

    weight = lambda path: f"CASE {path} {cases} ELSE 1 END"
    return f"""WITH d AS (SELECT doc_id, coalesce({domain}, '{NONE}') AS domain, coalesce(lang, '{NONE}') AS lang,
  coalesce(source, '{NONE}') AS source, (strlen(coalesce(text, '')) + 3) // 4 AS tokens,
  concat(coalesce(doc_id::VARCHAR, 'null'), ':', md5(coalesce(text, ''))) AS identity FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS available FROM d GROUP BY ALL),
goal AS (SELECT least(floor(sum(available)::DOUBLE * {FRACTION})::HUGEINT, sum(available) * {EPOCHS}) AS parent_budget FROM leaves),
n1 AS (SELECT domain, sum(available) * {EPOCHS} AS capacity, {weight('domain')} AS weight, any_value(parent_budget) AS parent_budget
  FROM leaves, goal GROUP BY domain),
{share('s1', 'n1', '1', 'domain')},
n2 AS (SELECT l.domain, l.lang, sum(available) * {EPOCHS} AS capacity, {weight("l.domain || '/' || l.lang")} AS weight, any_value(s1.budget) AS parent_budget
  FROM leaves l JOIN s1 USING (domain) GROUP BY l.domain, l.lang),
{share('s2', 'n2', 'domain', 'lang')},
n3 AS (SELECT l.domain, l.lang, l.source, available * {EPOCHS} AS capacity, available, {weight("l.domain || '/' || l.lang || '/' || l.source")} AS weight, s2.budget AS parent_budget
  FROM leaves l JOIN s2 USING (domain, lang)),
{share('s3', 'n3', 'domain, lang', 'source')},
b AS (SELECT domain, lang, source, budget, CASE WHEN available = 0 THEN 0 ELSE budget // available END AS epochs,
  budget - CASE WHEN available = 0 THEN 0 ELSE budget // available END * available AS rest FROM s3),
k AS (SELECT d.*, epochs, rest, md5(concat('{SEED}:', epochs::VARCHAR, ':', identity)) AS key FROM d JOIN b USING (domain, lang, source)),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k),
t AS (SELECT *, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS taken FROM c)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS n_tokens, taken::INTEGER AS n_epochs FROM t WHERE taken > 0"""
