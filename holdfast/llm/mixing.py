"""Mixing sources to target weights by hierarchical budgeting.

The levels (domain, language, source) form a tree whose leaves hold documents. A
token budget goes down from the root: each node's share is split among its
children by weight. A child that can't use its share (a leaf offers its tokens
``epochs`` times at most, an inner node what its leaves offer) takes what it has,
and what it leaves goes to its siblings by weight; only what all of them can't
use is the parent's own shortage, which the parent's siblings take in turn.

A leaf reads its documents in a seeded order, another one for each epoch, and
takes the longest prefix of these epochs that fits its share. Where the prefix
ends is found in two steps that no leaf makes hot: token sums of 4,096 slots of
the order (combined map-side), then a running total inside the one slot where
the share runs out.

Tokens are whole numbers and all shares are whole, so a parent's last few tokens
(fewer than its children) may stay unspent.

Rows: the result has the rows taken at least once, with all their columns, and
``copies``: how many epochs take them. A NULL level counts as the empty name, a
NULL key as the empty key, a NULL or empty text as no tokens; rows that repeat a
key in one leaf are taken or left together. Input columns ``n_tokens`` and
``copies`` are replaced; one named like a level stays as it is. A node of weight
0 gets nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.llm.common import quoted, sized, staged, without

SLOT_DIGITS = 3  # hexadecimal: 4,096 slots
MOST_SENT = 200_000  # rows of a table of leaves or edge slots that is sent to every task
WORD = r"[^\x20\x09-\x0D]+"
BIG = "decimal(18,0)"  # a product with a bigint then fits 38 digits


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def place(seed: int, epoch: Column, key: Column) -> Column:
    """A document's place in an epoch's order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def shares(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]],
           budget: int) -> DataFrame:
    """Leaves (``levels``, ``capacity``) with their ``share`` of the budget.

    One window pass for each level, over nodes of the tree, not over documents.
    """
    nodes = None
    for depth in range(1, len(levels) + 1):
        up, here = list(levels[:depth - 1]), list(levels[:depth])
        table = weights.get(levels[depth - 1], {})
        weight = F.lit(table.get("*", 1))
        for name, value in sorted(table.items()):
            weight = F.when(F.col(levels[depth - 1]) == name, F.lit(value)).otherwise(weight) if name != "*" else weight
        children = leaves.groupBy(*here).agg(F.sum("capacity").cast("bigint").alias("capacity")).withColumn(
            "weight", weight.cast("bigint")
        )
        if up:
            parents = nodes.select(*[F.col(c).alias(f"up_{c}") for c in up], F.col("share").alias("given"))
            children = children.join(parents, [F.col(c) == F.col(f"up_{c}") for c in up]).drop(*[f"up_{c}" for c in up])
        else:
            # The first level's nodes are few by its meaning.
            offered = F.sum("capacity").over(Window.partitionBy(F.lit(0)))
            children = children.withColumn("given", F.least(F.lit(budget).cast("bigint"), offered))
        children = _filled(children, up, here)
        nodes = children.select(*here, "share")
    return nodes


def _filled(children: DataFrame, up: list[str], here: list[str]) -> DataFrame:
    """Capped shares among siblings, by weight.

    Siblings come in the order in which rising shares would fill them; one is
    full if its part of what the earlier ones leave reaches its capacity. The
    others split the rest by weight.
    """
    group = Window.partitionBy(*(up or [F.lit(0)]))
    order = group.orderBy(
        F.when(F.col("weight") > 0, F.col("capacity").cast("double") / F.col("weight")).otherwise(F.lit(float("inf"))),
        *here,
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    on = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    step = children.withColumns({
        "left": F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0)),
        "weights": F.sum("weight").over(on),
    })
    full = F.expr(f"weight > 0 and cast(capacity as {BIG}) * weights <= cast(left as {BIG}) * weight")
    step = step.withColumn("full", full)
    step = step.withColumns({
        "rest": F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(group), F.lit(0)),
        "among": F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(group), F.lit(0)),
    })
    part = F.expr(f"case when weight > 0 then (cast(rest as {BIG}) * weight) div among end")
    share = F.when(F.col("full"), F.col("capacity")).otherwise(F.coalesce(part, F.lit(0)))
    return step.select(*here, share.cast("bigint").alias("share"))


def mix(docs: DataFrame, key: str, text: str, levels: Sequence[tuple[str, Column]],
        weights: Mapping[str, Mapping[str, int]], budget_permille: int, epochs: int = 2,
        seed: int = 42) -> DataFrame:
    """Documents taken for a budget of so many thousandths of all tokens.

    ``levels``: names and expressions, from the root down. ``weights``: for each
    level's name, whole numbers by node name; ``*`` stands for the others.
    """
    names = [n for n, _ in levels]
    kept = without(docs, ["n_tokens", "copies"])
    own = {c.lower() for c in kept}
    # Inside, the input's columns go by number, so that no name is in the way.
    rows = docs.select(
        *[quoted(c).alias(f"c{i}") for i, c in enumerate(kept)],
        *[F.coalesce(e.cast("string"), F.lit("")).alias(f"__l{i}") for i, (_, e) in enumerate(levels)],
        word_count(quoted(text).cast("string")).alias("__n"),
        F.coalesce(quoted(key).cast("string"), F.lit("")).alias("__key"),
    )
    at = [f"__l{i}" for i in range(len(levels))]
    # Counting words takes the only full read of the texts besides the last one.
    slim = staged(rows.select(*at, "__n", "__key"), "mixing")
    leaves = slim.groupBy(*[F.col(a).alias(n) for a, n in zip(at, names)]).agg(
        F.sum("__n").cast("bigint").alias("tokens")
    ).withColumn("capacity", F.col("tokens") * epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()[0]  # one number
    given = shares(leaves, names, weights, int(total) * budget_permille // 1000)
    quota = given.join(leaves, names).select(
        *[F.col(n).alias(f"q{i}") for i, n in enumerate(names)],
        F.when(F.col("tokens") > 0, F.least(F.lit(epochs).cast("bigint"), F.floor(F.col("share") / F.col("tokens"))))
        .otherwise(0).cast("bigint").alias("whole"),
        F.col("share"), F.col("tokens"),
    ).withColumn("rest", F.col("share") - F.col("whole") * F.col("tokens"))

    def in_leaf(left: Sequence[str], right: Sequence[str]) -> list[Column]:
        return [F.col(a) == F.col(b) for a, b in zip(left, right)]

    q = [f"q{i}" for i in range(len(names))]
    quota = sized(quota, "quota", MOST_SENT)
    ordered = slim.join(quota, in_leaf(at, q)).withColumn(
        "place", place(seed, F.col("whole") + 1, F.col("__key"))
    ).withColumn("slot", F.substring("place", 1, SLOT_DIGITS))
    sums = ordered.groupBy(*q, "slot").agg(F.sum("__n").alias("n"), F.max("rest").alias("rest"))
    running = Window.partitionBy(*q).orderBy("slot")  # at most 4,096 rows for each leaf
    edges = sums.withColumn("to", F.sum("n").over(running)).where("to > rest").groupBy(*q).agg(
        F.min(F.struct("slot", (F.col("rest") - F.col("to") + F.col("n")).alias("left"))).alias("edge")
    ).select(*[F.col(c).alias(f"e_{c}") for c in q], F.col("edge.slot").alias("edge"), F.col("edge.left").alias("left"))
    plan = sized(quota.join(edges, in_leaf(q, [f"e_{c}" for c in q]), "left").select(
        *q, "whole", "rest", "edge", "left"
    ), "plan", MOST_SENT)
    last = (
        slim.join(plan.where("rest > 0 and edge is not null"), in_leaf(at, q))
        .withColumn("place", place(seed, F.col("whole") + 1, F.col("__key")))
        .where(F.substring("place", 1, SLOT_DIGITS) == F.col("edge"))
        .groupBy(*q, "place", F.col("__key").alias("k")).agg(F.sum("__n").alias("n"), F.max("left").alias("left"))
    )
    inside = Window.partitionBy(*q).orderBy("place", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = sized(last.withColumn("to", F.sum("n").over(inside)).where("to <= left").select(
        *[F.col(c).alias(f"t_{c}") for c in q], "k", F.lit(True).alias("taken")
    ), "taken", MOST_SENT)
    slot = F.substring(place(seed, F.col("whole") + 1, F.col("__key")), 1, SLOT_DIGITS)
    # Texts stay where they are while the leaves and the edge slots are few enough to be sent.
    partial = (F.col("rest") > 0) & (
        F.col("edge").isNull() | (slot < F.col("edge")) | ((slot == F.col("edge")) & F.coalesce("taken", F.lit(False)))
    )
    return (
        rows.join(plan, in_leaf(at, q))
        .join(taken, [*in_leaf(at, [f"t_{c}" for c in q]), F.col("__key") == F.col("k")], "left")
        .withColumn("copies", (F.col("whole") + F.when(partial, 1).otherwise(0)).cast("bigint"))
        .where("copies > 0")
        .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)],
                *[F.col(a).alias(n) for a, n in zip(at, names) if n.lower() not in own],
                F.col("__n").alias("n_tokens"), "copies")
    )
