"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens goes down a tree domain - language - source. Each node shares it among its children by weight, but
gives none more than its leaves hold (times the epochs allowed); what a child can't take goes to its siblings by weight, and
only what all of them can't take reaches the siblings of their parent, as every node's room is the sum of its children's.
A leaf spends its budget on whole epochs and then on a prefix of the tokens of one more epoch, in an order seeded by
leaf epoch. The prefix ends by a histogram of that order: only the bin in which it ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringeframe.operators.settle import settled

WORD = r"[^\x20\x09-\x0D]+"
# The order is a number of 52 bits; the histogram has its first 12.
ORDER_BITS, BIN_BITS = 52, 12
LEVELS = ("domain", "lang", "source")
# Tables of one short row per leaf are broadcast up to so many leaves; beyond, they are joined by shuffle.
BROADCAST_LEAVES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def seeded_order(key: Column, seed: int, epoch: Column) -> Column:
    """A number of ORDER_BITS bits from the MD5 of seed, epoch and key; a null key counts as the text `null`."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, ORDER_BITS // 4), 16, 10).cast("bigint")


def _leaf_table(df: DataFrame) -> DataFrame:
    """A table of one row per leaf, computed once; the hint is given only where its size is checked."""
    own = settled(df)
    return F.broadcast(own) if own.count() <= BROADCAST_LEAVES else own


def _shared(nodes: DataFrame, parents: list[str], budget: Column, weight: Column, room: Column, name: str) -> DataFrame:
    """Add `name`: the node's share of its parent's budget, min(weight * level, room) with one level per parent, rounded down.

    Siblings are ordered by room per weight; the first that its even share of what is left does not fill sets the level.
    """
    w = F.greatest(F.coalesce(weight.cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
    ready = nodes.withColumn("_w", w).withColumn("_room", F.when(F.col("_w") > 0, room).otherwise(0).cast("bigint"))
    ready = ready.withColumn("_fill", F.when(F.col("_w") > 0, F.col("_room") / F.col("_w")).otherwise(0.0))
    siblings = Window.partitionBy(*parents)
    order = siblings.orderBy("_fill", *LEVELS[: len(parents) + 1])
    before = F.coalesce(F.sum("_room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = ready.withColumn("_level", F.when(F.col("_w") > 0, (budget - before) / after))
    open_ = F.when(F.col("_fill") > F.col("_level"), F.col("_level"))
    top = F.max(open_).over(siblings)
    share = F.when(top.isNull(), F.col("_room")).otherwise(F.least(F.col("_room"), F.floor(F.col("_w") * F.greatest(top, F.lit(0.0)))))
    return level.withColumn(name, share.cast("bigint")).drop("_w", "_room", "_fill", "_level")


def allocate(leaves: DataFrame, budget: Column, weights: dict[str, Column], epochs: int = 1) -> DataFrame:
    """`leaves` (domain, lang, source, tokens) with `quota`: the tokens of the budget that each leaf gets.

    `weights` has, for each of domain, lang and source, an integer expression of the levels down to it; null and negative
    weights are 0, and such nodes get nothing. A leaf's room is `epochs` times its tokens.
    """
    room = leaves.withColumn("room", F.col("tokens") * epochs)
    out = room
    for depth in range(1, 4):
        own, parents = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        # A node with room only below nodes of weight 0 has none.
        usable = out
        for below in LEVELS[depth:]:
            usable = usable.filter(F.coalesce(weights[below], F.lit(0)) > 0)
        nodes = usable.groupBy(*own).agg(F.sum("room").alias("_room_of"), *([F.first("_budget").alias("_budget")] if parents else []))
        total = F.col("_budget") if parents else budget
        nodes = _shared(nodes, parents, total, weights[own[-1]], F.col("_room_of"), "_share").select(*own, F.col("_share").alias("_budget"))
        out = out.drop("_budget").join(nodes, own, "left").withColumn("_budget", F.coalesce("_budget", F.lit(0).cast("bigint")))
    return out.select(*LEVELS, "tokens", F.col("_budget").alias("quota"))


def mix(
    docs: DataFrame,
    domain: Column,
    weights: dict[str, Column],
    share: float = 0.5,
    epochs: int = 2,
    seed: int = 0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The selected rows of `docs` with domain, n_tokens and copies (how many epochs take the row, at least 1) added.

    The budget is `share` of all tokens (words); `domain`, and `lang` and `source` of `docs`, name the leaf; null names are empty ones.
    Rows are taken whole in the order of their seeded number, then key, while the leaf's quota lasts; the first that does not fit ends
    the prefix. Rows of one key in a leaf go together, null keys count as one. Null and empty texts have no tokens and go
    with the prefix they stand in. Leaves without a quota give no rows. Columns of the added names are replaced.
    """
    names = [c for c in docs.columns if c not in ("domain", "n_tokens", "copies")]
    leaf = [F.coalesce(domain, F.lit("")).alias("_domain"), F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source")]
    marked = docs.select(*names, *leaf)
    tree = [F.col(f"_{x}").alias(x) for x in LEVELS]
    counted = settled(marked.select(F.col(key).alias("key"), *tree, word_count(F.col(text)).alias("tokens")))
    leaves = counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    budget = F.floor(leaves.agg(F.sum("tokens")).scalar() * F.lit(float(share)))
    quotas = allocate(leaves, budget, weights, epochs).filter("quota > 0")
    quotas = _leaf_table(
        quotas.withColumn("full", F.floor(F.col("quota") / F.col("tokens")).cast("bigint"))
        .withColumn("rest", F.col("quota") - F.col("full") * F.col("tokens"))
        .select(*LEVELS, "full", "rest")
    )
    placed = counted.join(quotas, [*LEVELS]).withColumn("at", seeded_order(F.col("key"), seed, F.col("full") + 1))
    width = 1 << (ORDER_BITS - BIN_BITS)
    binned = placed.withColumn("bin", F.floor(F.col("at") / width).cast("bigint"))
    bins = binned.groupBy(*LEVELS, "rest", "bin").agg(F.sum("tokens").alias("tokens"))
    running = Window.partitionBy(*LEVELS).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("tokens").over(running))
    # The first bin that does not fit whole; a leaf without one takes all of the epoch.
    ends = bins.filter("upto > rest").groupBy(*LEVELS, "rest").agg(F.min(F.struct("bin", (F.col("upto") - F.col("tokens")).alias("before"))).alias("e"))
    ends = ends.select(*LEVELS, "rest", "e.bin", "e.before")
    units = binned.join(ends, [*LEVELS, "rest", "bin"]).groupBy(*LEVELS, "rest", "bin", "before", "at", "key").agg(F.sum("tokens").alias("tokens"))
    inside = Window.partitionBy(*LEVELS).orderBy("at", "key").rowsBetween(Window.unboundedPreceding, 0)
    taken = units.withColumn("upto", F.col("before") + F.sum("tokens").over(inside)).filter("upto <= rest")
    last = taken.groupBy(*LEVELS).agg(F.max(F.struct("at", F.coalesce("key", F.lit(-(2**63))).alias("key"))).alias("last"))
    cuts = quotas.join(ends.select(*LEVELS, "bin"), [*LEVELS], "left").join(last, [*LEVELS], "left")
    cuts = _leaf_table(cuts.select(*[F.col(x).alias(f"_{x}") for x in LEVELS], "full", "bin", "last"))
    # `last` is null where the bin takes none of its rows: then the prefix ends before the bin.
    chosen = marked.join(cuts, [f"_{x}" for x in LEVELS])
    at = seeded_order(F.col(key), seed, F.col("full") + 1)
    here = F.struct(at.alias("at"), F.coalesce(F.col(key), F.lit(-(2**63))).alias("key"))
    fits = F.when(F.col("bin").isNull(), True).when(F.col("last").isNull(), at < F.col("bin") * width).otherwise(here <= F.col("last"))
    copies = F.col("full") + fits.cast("bigint")
    return (
        chosen.withColumn("copies", copies)
        .filter("copies > 0")
        .select(*names, F.col("_domain").alias("domain"), word_count(F.col(text)).alias("n_tokens"), "copies")
    )
