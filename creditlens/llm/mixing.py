"""Mixing sources to target weights by hierarchical budgets, with DataFrame functions only.

A token budget is passed down a tree, domain then language then source. Each node can
give at most ``max_epochs`` times its tokens. A parent's budget is dealt to its children
in proportion to their weights; children that cannot take their part are filled up and
what they leave goes to their siblings, so only what a whole subtree cannot take ever
reaches its parent's siblings. Sorted by capacity per weight, the filled children are a
prefix, so each level is one pair of running sums over the (small) table of nodes.

A leaf's budget buys whole epochs of the leaf and a prefix of one more. Epoch e is the
leaf in the order of md5(seed:e:doc_id), and the prefix takes documents as long as their
summed tokens fit. The order is cut by the digest's first three hex digits: sums per
(leaf, digit group) find the group in which the prefix ends, and only that group's rows
are ranked in a window, so a leaf with a third of all rows is no hot task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Words between ASCII white space count as tokens.
TOKEN = r"[^\x20\x09-\x0D]+"
LEVELS = ["domain", "lang", "source"]
_BIG = "decimal(38,0)"


def _weight(name: str, weights: Mapping[str, int] | None) -> Column:
    """Weight of a node by its name; 1 where none is given."""
    out = F.lit(1)
    for k, w in (weights or {}).items():
        out = F.when(F.col(name) == k, w).otherwise(out)
    return out


def _dealt(nodes: DataFrame, parent: list[str], name: str, weights: Mapping[str, int] | None) -> DataFrame:
    """``budget`` of each child, from its parent's ``budget`` and the children's ``capacity``."""
    nodes = nodes.withColumn("w", _weight(name, weights)).withColumn("fill", F.col("capacity") / F.col("w"))
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))  # rows are nodes of the tree
    order = w.orderBy("fill", name)
    nodes = nodes.withColumn("filled", F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nodes = nodes.withColumn("open_w", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    big = lambda c: F.col(c).cast(_BIG)
    full = big("capacity") * F.col("open_w") <= (big("budget") - big("filled")) * F.col("w")
    nodes = nodes.withColumn("full", full)
    nodes = nodes.withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(w), F.lit(0)))
    nodes = nodes.withColumn("rest_w", F.sum(F.when(~F.col("full"), F.col("w"))).over(w))
    exact = F.expr(f"cast(cast(rest as {_BIG}) * w as {_BIG}) div greatest(rest_w, 1)")
    return nodes.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(exact).cast("long")).drop("w", "fill", "filled", "open_w", "full", "rest", "rest_w")


def budgets(leaves: DataFrame, percent: int, max_epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """domain, lang, source, tokens and budget of each leaf; the whole budget is ``percent`` of all tokens."""
    total = Window.partitionBy(F.lit(0))
    nodes = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    nodes = nodes.withColumn("budget", F.least(F.expr(f"sum(tokens) over () * {int(percent)} div 100"), F.sum("capacity").over(total)))
    for depth, name in enumerate(LEVELS):
        parent, here = LEVELS[:depth], LEVELS[: depth + 1]
        level = nodes.groupBy(*here).agg(F.sum("capacity").alias("capacity"), F.first("budget").alias("budget"))
        dealt = _dealt(level, parent, name, weights.get(name)).select(*here, "budget")
        nodes = nodes.drop("budget").join(dealt, here)
    return nodes.select(*LEVELS, "tokens", "budget")


def mix(docs: DataFrame, percent: int, max_epochs: int, weights: Mapping[str, Mapping[str, int]], domain: str, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carried: list[str] | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch: a row for each time that a document is taken.

    ``domain`` is the SQL text of a document's domain. With ``carried``, ``row`` holds those columns of the input. A null text has no tokens;
    a leaf without tokens gives nothing, and elsewhere a document without tokens is taken
    where its place is in the prefix. A null domain, language or source is a node named ``?``
    and a null id is ordered under the text ``null``; documents with equal places are
    ordered by their tokens. An empty table gives no rows.
    """
    col = lambda c: F.col(f"`{c}`")
    name = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    row = [F.struct(*[col(c) for c in carried]).alias("row")] if carried else []
    lean = docs.select(col(id_col).alias("doc_id"), name(F.expr(domain)).alias("domain"), name(col(lang_col)).alias("lang"), name(col(source_col)).alias("source"),
                       F.coalesce(F.regexp_count(col(text_col), F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_tokens"), *row)
    lean = staged(lean, "counted")
    leaves = lean.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(staged(leaves, "leaves"), percent, max_epochs, weights).where("tokens > 0 and budget > 0")
    plan = plan.select(*LEVELS, F.expr("budget div tokens").alias("epochs"), F.expr("budget % tokens").alias("prefix"))
    rows = lean.join(staged(plan, "plan"), LEVELS)
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = rows.withColumn("place", place).withColumn("head", F.substring("place", 1, 3))

    heads = staged(rows.where("prefix > 0").groupBy(*LEVELS, "head", "prefix").agg(F.sum("n_tokens").alias("t")), "heads")
    upto = heads.withColumn("upto", F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("head")))  # at most 4096 rows a leaf
    # The first group that goes beyond the prefix; all groups before it are taken whole.
    cut = upto.where("upto > prefix").groupBy(*LEVELS).agg(F.min(F.struct("head", (F.col("upto") - F.col("t")).alias("taken"))).alias("cut"))
    cut = cut.select(*LEVELS, F.col("cut.head").alias("cut_head"), F.col("cut.taken").alias("taken"))
    rows = rows.join(staged(cut, "cut"), LEVELS, "left")
    out = ["doc_id", *LEVELS, "n_tokens", "epoch", *(["row"] if carried else [])]
    full = rows.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    last = rows.where("prefix > 0").withColumn("epoch", F.col("epochs"))
    edge = last.where("head = cut_head")
    running = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("place", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = edge.withColumn("running", running).where("taken + running <= prefix")
    return full.select(*out).unionByName(last.where("head < cut_head").select(*out)).unionByName(edge.select(*out))


def oracle(table: str, percent: int, max_epochs: int, weights: Mapping[str, Mapping[str, int]], domain: str, seed: int = 7) -> str:
    """The same rows in DuckDB's SQL over ``table``: plain running sums, no groups of digits."""
    def weight(level):
        cases = " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in weights.get(level, {}).items())
        return f"CAST({f'CASE {cases} ELSE 1 END' if cases else '1'} AS HUGEINT)"

    text = f"""WITH lean AS (SELECT doc_id, COALESCE({domain}, '?') AS domain, COALESCE(lang, '?') AS lang, COALESCE(source, '?') AS source,
 COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM {table}),
leaves AS (SELECT domain, lang, source, SUM(n_tokens)::HUGEINT AS tokens, {max_epochs} * SUM(n_tokens)::HUGEINT AS capacity FROM lean GROUP BY ALL),
b0 AS (SELECT LEAST(SUM(tokens)::HUGEINT * {percent} // 100, SUM(capacity)::HUGEINT) AS budget FROM leaves)"""
    for depth, name in enumerate(LEVELS):
        here, parent = LEVELS[: depth + 1], LEVELS[:depth]
        by = f"PARTITION BY {', '.join(parent)}" if parent else ""
        source = f"leaves JOIN b{depth} USING ({', '.join(parent)})" if parent else "leaves, b0"
        text += f""",
n{depth} AS (SELECT {', '.join(here)}, SUM(capacity)::HUGEINT AS capacity, ANY_VALUE(budget) AS budget, {weight(name)} AS w FROM {source} GROUP BY {', '.join(here)}),
r{depth} AS (SELECT *, COALESCE(SUM(capacity) OVER ({by} ORDER BY capacity::DOUBLE / w::DOUBLE, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS filled,
 SUM(w) OVER ({by} ORDER BY capacity::DOUBLE / w::DOUBLE, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS open_w FROM n{depth}),
f{depth} AS (SELECT *, capacity * open_w <= (budget - filled) * w AS is_full FROM r{depth}),
b{depth + 1} AS (SELECT {', '.join(here)}, CASE WHEN is_full THEN capacity ELSE
 (budget - COALESCE(SUM(capacity) FILTER (is_full) OVER ({by}), 0)::HUGEINT) * w // COALESCE(SUM(w) FILTER (NOT is_full) OVER ({by}), 1)::HUGEINT END AS budget FROM f{depth})"""
    return text + f""",
plan AS (SELECT domain, lang, source, (budget // tokens)::BIGINT AS epochs, (budget % tokens)::BIGINT AS prefix FROM leaves JOIN b3 USING (domain, lang, source) WHERE tokens > 0 AND budget > 0),
rows_ AS (SELECT *, md5('{seed}:' || epochs || ':' || COALESCE(doc_id::VARCHAR, 'null')) AS place FROM lean JOIN plan USING (domain, lang, source)),
last_ AS (SELECT *, SUM(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM rows_)
SELECT doc_id, domain, lang, source, n_tokens, UNNEST(range(epochs)) AS epoch FROM rows_ WHERE epochs > 0
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, epochs AS epoch FROM last_ WHERE prefix > 0 AND upto <= prefix"""
