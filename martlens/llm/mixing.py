"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

A token budget goes down a tree (domain, language, source). At each node the children's budgets follow their weights,
but none gets more than its subtree can give in the allowed epochs; what one child cannot take goes to its siblings,
and only what a whole subtree cannot take has gone to that subtree's siblings one level up. A leaf's budget is then a
prefix of its token sequence: whole epochs, and of the next epoch, in seeded order, documents until the budget is used
up, the last of them cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: A word: what lies between ASCII white space.
WORD = "[^ \\t\\n\\x0B\\f\\r]+"
#: Leaf tables of up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_LEAVES = 50_000


@dataclass(frozen=True)
class Mix:
    """levels: the tree's columns from the root down. weights: by level, the integer weight of a child (at most 100,000 over
    all children of a node, 0: never taken); children not named get default_weight. The budget is budget_tokens, or that
    share (numerator, denominator) of all tokens. A document is taken at most epochs times."""

    levels: Sequence[str] = ("domain", "lang", "source")
    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    default_weight: int = 1
    budget_tokens: int | None = None
    budget_share: tuple[int, int] = (3, 5)
    epochs: int = 2
    seed: int = 17
    buckets_hex: int = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def domain_of(source: str, domains: Mapping[str, Sequence[str]], other: str = "other") -> Column:
    """The domain that lists the source."""
    found = F.lit(other)
    for name, sources in domains.items():
        found = F.when(F.col(source).isin(*sources), F.lit(name)).otherwise(found)
    return found


def _weight(level: str, mix: Mix) -> Column:
    found = F.lit(mix.default_weight)
    for name, w in mix.weights.get(level, {}).items():
        found = F.when(F.col(level) == name, F.lit(w)).otherwise(found)
    return found.cast("long")


def leaf_quotas(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(levels..., tokens, quota) from (levels..., tokens): the budget of every leaf, by water-filling from the root down."""
    levels = list(mix.levels)
    leaves = leaves.withColumn("cap", F.col("tokens") * mix.epochs)
    whole = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"))
    share = F.expr(f"`all` * {mix.budget_share[0]} div {mix.budget_share[1]}")
    parent = whole.select((share if mix.budget_tokens is None else F.lit(mix.budget_tokens)).cast("long").alias("b"))
    for depth, level in enumerate(levels):
        path, up = levels[: depth + 1], levels[:depth]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, mix))
        if up:
            same = parent.select(*[F.col(c).alias(f"_{c}") for c in up], "b")
            on = F.lit(True)
            for c in up:
                on = on & nodes[c].eqNullSafe(same[f"_{c}"])
            nodes = nodes.join(same, on).select(*path, "cap", "w", "b")
        else:
            nodes = nodes.join(F.broadcast(parent))  # one row
        order = Window.partitionBy(*up) if up else Window.partitionBy(F.lit(0))
        order = order.orderBy((F.col("cap") / F.col("w")).asc(), F.col(level).asc_nulls_first())
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        zero = F.lit(0).cast("long")
        fed = nodes.where("w > 0").withColumn("before_cap", F.coalesce(F.sum("cap").over(before), zero)).withColumn("rest_w", F.sum("w").over(after))
        fed = fed.withColumn("full", F.col("cap") * F.col("rest_w") <= F.col("w") * (F.col("b") - F.col("before_cap")))
        free = F.when(~F.col("full"), F.col("w")).otherwise(zero)
        fed = (
            fed.withColumn("taken", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(zero)).over(group))
            .withColumn("free_w", F.sum(free).over(group))
            .withColumn("cum_w", F.sum(free).over(upto))
        )
        fed = fed.withColumn("left", F.col("b") - F.col("taken"))
        parent = fed.select(*path, F.expr("CASE WHEN full THEN cap ELSE `left` * cum_w div free_w - `left` * (cum_w - w) div free_w END").alias("b"))
    quotas = parent.select(*[F.col(c).alias(f"_{c}") for c in levels], F.col("b").alias("quota"))
    on = F.lit(True)
    for c in levels:
        on = on & leaves[c].eqNullSafe(quotas[f"_{c}"])
    return leaves.join(quotas, on, "left").select(*levels, "tokens", F.coalesce("quota", F.lit(0)).cast("long").alias("quota"))


def _beside(rows: DataFrame, small: DataFrame, levels: Sequence[str], bounded: bool) -> DataFrame:
    """Rows with the columns of their leaf."""
    other = small.select(*[F.col(c).alias(f"_leaf_{c}") for c in levels], *[c for c in small.columns if c not in levels])
    on = F.lit(True)
    for c in levels:
        on = on & rows[c].eqNullSafe(other[f"_leaf_{c}"])
    return rows.join(F.broadcast(other) if bounded else other, on).drop(*[f"_leaf_{c}" for c in levels])


def plan_mix(rows: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame, bool]:
    """Decisions for the leaves of rows (doc_id, levels..., _tokens), and whether they are few enough to be broadcast:

    (levels..., _full, _rest): whole epochs and the words of the next one; (levels..., _edge, _room): the bucket of the
    seeded order in which that epoch's budget ends, and the words that it has left there.
    """
    levels = list(mix.levels)
    leaves = rows.where("_tokens > 0").groupBy(*levels).agg(F.sum("_tokens").alias("tokens"))
    plan = cut(leaf_quotas(leaves, mix).where("quota > 0").select(*levels, F.expr("quota div tokens").alias("_full"), F.expr("quota % tokens").alias("_rest")))
    bounded = plan.count() <= BROADCAST_LEAVES
    sums = _ordered(rows, plan, mix, bounded).where("_rest > 0").groupBy(*levels, "_bucket", "_rest").agg(F.sum("_tokens").alias("_sum"))
    over = Window.partitionBy(*levels).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(over), F.lit(0).cast("long"))).where("_before < _rest and _rest <= _before + _sum")
    return plan, cut(edge.select(*levels, F.col("_bucket").alias("_edge"), (F.col("_rest") - F.col("_before")).alias("_room"))), bounded


def _ordered(rows: DataFrame, plan: DataFrame, mix: Mix, bounded: bool) -> DataFrame:
    """Rows of the leaves that are taken, with their place in the seeded order of the last epoch."""
    mine = _beside(rows.where("_tokens > 0"), plan, mix.levels, bounded)
    key = F.concat_ws(":", F.lit(str(mix.seed)), F.col("_full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return mine.withColumn("_key", F.md5(key.cast("binary"))).withColumn("_bucket", F.substring("_key", 1, mix.buckets_hex))


def take_mix(rows: DataFrame, plan: DataFrame, edge: DataFrame, bounded: bool, mix: Mix) -> DataFrame:
    """The rows that the decisions take, with _epoch and _take."""
    levels = list(mix.levels)
    mine = _ordered(rows, plan, mix, bounded)
    ends = edge.select(*levels, "_edge", "_room")
    other = ends.select(*[F.col(c).alias(f"_leaf_{c}") for c in levels], "_edge", "_room")
    on = F.lit(True)
    for c in levels:
        on = on & mine[c].eqNullSafe(other[f"_leaf_{c}"])
    mine = mine.join(F.broadcast(other) if bounded else other, on, "left")
    columns = [*rows.columns, "_epoch", "_take"]
    epochs = F.sequence(F.lit(0).cast("long"), F.col("_full") - F.when(F.col("_bucket") < F.col("_edge"), 0).otherwise(1))
    whole = mine.where("_full > 0 or _bucket < _edge").withColumn("_epoch", F.explode(epochs)).withColumn("_take", F.col("_tokens"))
    within = Window.partitionBy(*levels).orderBy("_key", "doc_id", "_tokens").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_room") - F.coalesce(F.sum("_tokens").over(within), F.lit(0).cast("long"))
    last = mine.where("_bucket = _edge").withColumn("_epoch", F.col("_full")).withColumn("_take", F.least(F.col("_tokens"), room)).where("_take > 0")
    return whole.select(columns).unionByName(last.select(columns))


def mix_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """Rows of docs taken into the mix, with their columns and _tokens (words of the text), _epoch and _take.

    docs has doc_id, text and the level columns; its columns of the names that are added are replaced, all others come
    back as they are, whatever their names. _take is how many leading words count: all, but for the one document of
    a leaf at which its budget ends. A document may be taken in several epochs, in each as a row of its own. Texts
    without words (null, empty, blank) are never taken. A null level value is a child like any other. Rows that repeat
    are documents of their own; their order among each other is not defined. An empty table gives an empty mix.
    """
    kept = [c for c in docs.columns if c not in ("_tokens", "_epoch", "_take")]
    # the table's own columns go through as one struct, so that none meets a name used in between
    rows = docs.select("doc_id", *mix.levels, word_count(F.col("text")).alias("_tokens"), F.struct(*kept).alias("_row"))
    plan, edge, bounded = plan_mix(cut(rows.select("doc_id", *mix.levels, "_tokens")), mix)
    return take_mix(rows, plan, edge, bounded, mix).select(*[F.col("_row").getField(c).alias(c) for c in kept], "_tokens", "_epoch", "_take")


def mix_table(docs: DataFrame, mix: Mix) -> DataFrame:
    """The same rows as (doc_id, levels..., _tokens, _epoch, _take), from one scan of the texts."""
    rows = cut(docs.select("doc_id", *mix.levels, word_count(F.col("text")).alias("_tokens")))
    plan, edge, bounded = plan_mix(rows, mix)
    return take_mix(rows, plan, edge, bounded, mix)


def cut_to_words(text: Column, words: Column) -> Column:
    """The text up to the end of its word of that number."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[ \\t\\n\\x0B\\f\\r]*{WORD}"), F.lit(0)), F.lit(1), words.cast("int")), "")


def mix_sql(documents: str, mix: Mix, domains: Mapping[str, Sequence[str]]) -> str:
    """DuckDB SQL for mix_documents over a table with doc_id, text, lang and source, as (doc_id, domain, lang, source, epoch, n_tokens, take_tokens)."""
    listed = " ".join(f"WHEN source IN ({', '.join(repr(s) for s in sources)}) THEN '{name}'" for name, sources in domains.items())
    weight = lambda c: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {w}" for k, w in mix.weights.get(c, {}).items()) + f" ELSE {mix.default_weight} END" if mix.weights.get(c) else str(mix.default_weight)
    ctes, parent = [], "root"
    for depth, level in enumerate(mix.levels):
        path, up = list(mix.levels[: depth + 1]), list(mix.levels[:depth])
        part = f"PARTITION BY {', '.join(up)} " if up else ""
        on = " AND ".join(f"n.{c} IS NOT DISTINCT FROM p.{c}" for c in up) or "TRUE"
        order = f"{part}ORDER BY CAST(cap AS DOUBLE) / w, {level} NULLS FIRST"
        frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND"
        ctes.append(f"""
n{depth} AS (SELECT n.*, p.b FROM (SELECT {', '.join(path)}, CAST(sum(cap) AS BIGINT) AS cap, CAST({weight(level)} AS BIGINT) AS w FROM leaves GROUP BY {', '.join(path)}) n JOIN {parent} p ON {on} WHERE w > 0),
f{depth} AS (SELECT *, CAST(coalesce(sum(cap) OVER ({order} {frame} 1 PRECEDING), 0) AS BIGINT) AS before_cap, CAST(sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest_w FROM n{depth}),
g{depth} AS (SELECT *, cap * rest_w <= w * (b - before_cap) AS is_full FROM f{depth}),
h{depth} AS (SELECT *, b - CAST(sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part}) AS BIGINT) AS rest, CAST(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) AS BIGINT) AS free_w, CAST(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({order} {frame} CURRENT ROW) AS BIGINT) AS cum_w FROM g{depth}),
q{depth} AS (SELECT {', '.join(path)}, CASE WHEN is_full THEN cap ELSE rest * cum_w // free_w - rest * (cum_w - w) // free_w END AS b FROM h{depth})""")
        parent = f"q{depth}"
    levels = ", ".join(mix.levels)
    same = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in mix.levels)
    budget = f"CAST(sum(tokens) AS BIGINT) * {mix.budget_share[0]} // {mix.budget_share[1]} AS b FROM leaves" if mix.budget_tokens is None else f"{mix.budget_tokens} AS b"
    return f"""
WITH docs AS (SELECT doc_id, lang, source, CASE {listed} ELSE 'other' END AS domain, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+')) AS BIGINT) AS n FROM {documents}),
leaves AS (SELECT {levels}, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) AS BIGINT) * {mix.epochs} AS cap FROM docs WHERE n > 0 GROUP BY {levels}),
root AS (SELECT {budget}),{','.join(ctes)},
plan AS (SELECT l.*, q.b // l.tokens AS whole, q.b % l.tokens AS rest FROM leaves l JOIN {parent} q ON {same('l', 'q')} WHERE q.b > 0),
mine AS (SELECT d.*, p.whole, p.rest, md5('{mix.seed}:' || p.whole || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS k FROM docs d JOIN plan p ON {same('d', 'p')} WHERE d.n > 0),
cum AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY {levels} ORDER BY k, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM mine),
epochs AS (SELECT *, unnest(range(whole)) AS epoch FROM mine)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, n AS n_tokens, n AS take_tokens FROM epochs
UNION ALL SELECT doc_id, domain, lang, source, CAST(whole AS BIGINT), n, least(n, rest - before) FROM cum WHERE before < rest
"""
