"""Mixing sources to target weights by hierarchical budgeting.

Documents are the leaves' content in a tree domain - language - source. Weights propagate from the
root: a node's token budget is shared among its children in proportion to their weights. A child
cannot take more than its capacity (available tokens times ``max_epochs``); what it leaves goes to
its siblings by their weights. Because the capacity of an inner node is that of its whole subtree, a
shortage reaches the ancestor's siblings only when every sibling below is full. A leaf with budget b
and a available tokens passes over its documents b div a times; of the next epoch it takes the
longest prefix, in that epoch's seeded order, that fits the remaining b mod a tokens.

Budgets are whole tokens and exact integer arithmetic. Sharing is done by windows over the nodes of
one level; prefixes by sums of sums: the seeded order is cut into 16 ** HEX_DIGITS ranges per leaf,
ranges are summed, and only rows of one range are ordered together, so that no task sees a whole
leaf, however large. Ranges are summed in the same way, by their first digit.

Defined results for odd input
* A null language or source is the node '' of its level. A null text has no tokens.
* Rows that repeat an id and a text are one document of the leaf that sorts first.
* Nodes without a stated weight have weight ``default_weight``; weight 0 takes nothing.
* A document without tokens is taken where its place in the order is. A leaf without tokens gives
  nothing. An empty table gives an empty result. Ties in the order go to id, tokens, text hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.common import broadcast_if_small, materialize, single_rows, split_words

WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Ranges of the seeded order per leaf: 16 ** HEX_DIGITS.
HEX_DIGITS = 3
LEVELS = ["domain", "lang", "source"]


def count_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(split_words(F.coalesce(text, F.lit("")), WHITE_SPACE)).cast("long")


def weight_of(name: Column, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for key, w in weights.items():
        out = F.when(name == key, w).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Add ``grant`` to nodes with name columns, ``cap``, ``w`` and their parent's ``budget``.

    Children are looked at by rising capacity per weight: one is full if its weighted share of what
    the fuller ones left covers its capacity. The rest share what remains by weight.
    """
    key = [F.col(p) for p in parent] or [F.lit(0)]
    name = LEVELS[len(parent)]
    order = Window.partitionBy(*key).orderBy(F.col("cap") / F.col("w"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*key)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    stepped = nodes.withColumn("full", F.col("cap") * F.sum("w").over(onward) <= F.col("w") * left)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))
    rest_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(whole)
    stepped = stepped.withColumn("rest", rest).withColumn("rest_w", rest_w)
    part = F.expr("(w * rest) div rest_w")
    return stepped.withColumn("grant", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("full", "rest", "rest_w")


def leaf_budgets(
    leaves: DataFrame,
    weights: dict[str, dict[str, int]],
    token_budget: int | None = None,
    max_epochs: int = 4,
    default_weight: int = 1,
) -> DataFrame:
    """domain, lang, source, avail -> the same with ``budget``. ``token_budget`` None: all available tokens."""
    nodes = leaves
    for level in LEVELS:
        nodes = nodes.withColumn(f"w_{level}", weight_of(F.col(level), weights.get(level, {}), default_weight))
    nodes = nodes.filter("avail > 0 AND w_domain > 0 AND w_lang > 0 AND w_source > 0")
    nodes = nodes.withColumn("leaf_cap", F.col("avail") * max_epochs)
    if token_budget is None:
        total = leaves.agg(F.coalesce(F.sum("avail"), F.lit(0)).cast("long")).scalar()
    else:
        total = F.lit(token_budget).cast("long")
    granted = None
    for depth, level in enumerate(LEVELS):
        parent, path = LEVELS[:depth], LEVELS[: depth + 1]
        caps = nodes.groupBy(*path).agg(F.sum("leaf_cap").alias("cap"), F.first(f"w_{level}").alias("w"))
        caps = caps.join(granted, parent) if parent else caps.withColumn("budget", total)
        granted = _share(caps, parent).select(*path, F.col("grant").alias("budget"))
    return leaves.join(granted, LEVELS).select(*LEVELS, "avail", "budget")


def mix(
    docs: DataFrame,
    domain: Column,
    weights: dict[str, dict[str, int]],
    token_budget: int | None = None,
    max_epochs: int = 4,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """id, text_hash, domain, lang, source, tokens, full_epochs, partial of every document of a leaf with a budget.

    The document is drawn ``full_epochs`` times, and once more if ``partial``.
    """
    named = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.coalesce(domain, F.lit("")).alias("domain"),
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        count_tokens(F.col(text_col)).alias("tokens"),
    )
    rows = materialize(
        named.groupBy("id", "text_hash").agg(F.min(F.struct(*LEVELS, "tokens")).alias("x"), F.count("*").alias("rows")).select(
            "id", "text_hash", "x.*", "rows"),
        "mix-rows")
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("avail")), "mix-leaf-sizes")
    budgets = materialize(leaf_budgets(leaves, weights, token_budget, max_epochs), "mix-leaves")
    plan = budgets.filter("budget > 0").select(
        *LEVELS, F.expr("budget div avail").alias("full_epochs"), (F.col("budget") % F.col("avail")).alias("rest"))
    order = F.md5(F.concat_ws("|", F.lit(seed), "full_epochs", "id").cast("binary"))
    drawn = rows.join(broadcast_if_small(plan), LEVELS).withColumn("order_key", order)
    drawn = drawn.withColumn("bucket", F.substring("order_key", 1, HEX_DIGITS))

    ranges = drawn.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("t")).withColumn("coarse", F.substring("bucket", 1, 1))
    ranges = materialize(ranges, "mix-ranges")

    def sum_before(by: list[str], order: str) -> Column:
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("t").over(before), F.lit(0))

    coarse = ranges.groupBy(*LEVELS, "coarse").agg(F.sum("t").alias("t")).withColumn("coarse_start", sum_before(LEVELS, "coarse")).drop("t")
    starts = ranges.withColumn("start", sum_before([*LEVELS, "coarse"], "bucket")).join(coarse, [*LEVELS, "coarse"])
    starts = starts.select(*LEVELS, "bucket", (F.col("coarse_start") + F.col("start")).alias("start"))
    inside = Window.partitionBy(*LEVELS, "bucket").orderBy("order_key", "id", "tokens", "text_hash")
    summed = drawn.withColumn("upto", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = summed.join(starts, [*LEVELS, "bucket"])
    partial = (F.col("rest") > 0) & (F.col("start") + F.col("upto") <= F.col("rest"))
    return placed.select(
        "id", "text_hash", *LEVELS, "tokens", "full_epochs", partial.alias("partial"), "rows")


def draws(mixed: DataFrame) -> DataFrame:
    """One row per document and epoch: id, epoch, domain, lang, source, tokens."""
    n = F.col("full_epochs") + F.col("partial").cast("long")
    return mixed.filter(n > 0).select(
        "id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("epoch"), *LEVELS, "tokens")


def mix_documents(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], **options) -> DataFrame:
    """``docs`` in the target mixture: each document as often as it is drawn."""
    mixed = materialize(mix(docs, domain, weights, **options), "mixed")
    id_, text = F.col(options.get("id_col", "doc_id")), F.col(options.get("text_col", "text"))
    text_hash = F.xxhash64(F.coalesce(text, F.lit("")))
    n = F.col("full_epochs") + F.col("partial").cast("long")
    repeated = mixed.filter("rows > 1").select(F.col("id").alias("__r0"), F.col("text_hash").alias("__r1"))
    once = single_rows(docs, [id_, text_hash], materialize(repeated, "mix-repeated"))
    counts = mixed.filter(n > 0).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), n.cast("int").alias("__n"))
    counts = broadcast_if_small(materialize(counts, "mix-counts"))
    drawn = once.join(counts, id_.eqNullSafe(F.col("__id")) & (text_hash == F.col("__hash")))
    return drawn.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("__n"))).alias("__copy")).drop("__copy")
