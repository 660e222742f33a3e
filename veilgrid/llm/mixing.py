"""Mixing sources to target weights: token budgets flow down a tree of sources, documents are taken in seeded order."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.llm.frames import fresh, sent_if_small, without
from veilgrid.llm.ranks import running
from veilgrid.session import cut_lineage


def word_tokens(text: Column) -> Column:
    """Runs without white space, as a token count that any SQL engine gives alike; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[ \t-\r]+", -1), "")).cast("long")


def leaf_budgets(leaves: DataFrame, weights: DataFrame, levels: list[str], budget: int, max_epochs: int) -> DataFrame:
    """``levels``, ``tokens`` and ``budget`` of every leaf; ``leaves`` holds ``levels`` and ``tokens``.

    ``weights``: ``level`` (name), ``name`` (value, null is one) and ``weight`` (whole, 0 or more); a value that is
    not listed weighs 1. A leaf gives ``max_epochs`` times its tokens at most. From the root down, siblings share
    their parent's budget by weight. One that cannot use its share keeps what it can and the rest goes to its
    siblings by weight; only what all of them cannot use stays with their ancestor's siblings, as a node never gets
    more than its leaves can give. Shares are cut to whole tokens.
    """
    weighed = leaves.select(*levels, "tokens")
    for level in levels:
        of = weights.where(F.col("level") == level).groupBy(F.col("name").alias("w_name")).agg(F.max("weight").cast("long").alias(f"{level}_weight"))
        weighed = weighed.join(of, weighed[level].cast("string").eqNullSafe(F.col("w_name")), "left").drop("w_name")
    weighed = weighed.fillna(1, [f"{level}_weight" for level in levels])
    usable = F.least(*[F.col(f"{level}_weight") for level in levels], F.lit(1)) if len(levels) > 1 else F.least(F.col(f"{levels[0]}_weight"), F.lit(1))
    weighed = weighed.withColumn("cap", F.col("tokens") * max_epochs * usable)
    given = weighed.groupBy().agg(F.least(F.coalesce(F.sum("cap"), F.lit(0)), F.lit(budget)).cast("long").alias("budget"))
    for depth in range(1, len(levels) + 1):
        above, here = levels[: depth - 1], levels[:depth]
        nodes = weighed.groupBy(*here).agg(F.sum("cap").alias("cap"), F.max(f"{levels[depth - 1]}_weight").alias("weight"))
        parents = given.toDF(*[f"{c}_up" for c in above], "budget")
        on = F.lit(True)
        for c in above:
            on = on & nodes[c].eqNullSafe(parents[f"{c}_up"])
        given = _shared(nodes.join(parents, on).drop(*[f"{c}_up" for c in above]), above, levels[depth - 1]).select(*here, "budget")
    same = F.lit(True)
    back = given.toDF(*[f"{c}_up" for c in levels], "budget")
    for c in levels:
        same = same & weighed[c].eqNullSafe(back[f"{c}_up"])
    return weighed.join(back, same).select(*levels, "tokens", "budget")


def _shared(nodes: DataFrame, above: list[str], name: str) -> DataFrame:
    """Each parent's ``budget`` shared among its children by ``weight``, none over its ``cap``.

    In order of cap / weight the children that keep their whole cap come first: as long as a cap is at most the share
    of what is left for it and those behind.
    """
    siblings = Window.partitionBy(*above)
    order = siblings.orderBy(F.expr("try_divide(cap, weight)"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    some = nodes.withColumn("weight", F.when(F.col("cap") > 0, F.col("weight")).otherwise(0))
    live = some.withColumns({
        "weight_left": F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "budget_left": F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)),
    })
    full = live.withColumn("full", F.expr("weight = 0 OR cap * weight_left <= weight * budget_left"))
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(siblings)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(siblings)
    shared = full.withColumns({"rest": rest, "open_weight": open_weight})
    return shared.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("weight * rest DIV open_weight")).cast("long"))


def seeded_order(seed: int, epoch: Column, key: Column) -> Column:
    """60 bits of a hash of seed, epoch and key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def mixed(
    docs: DataFrame, weights: DataFrame, levels: list[str], *, share: tuple[int, int] = (3, 5), max_epochs: int = 4, seed: int = 7,
    doc_id: str = "doc_id", tokens: str = "n_tokens", budget: int | None = None,
) -> DataFrame:
    """``docs`` with ``leaf_tokens``, ``leaf_budget`` and ``epochs``, the times that a document is taken (0: not at all).

    ``levels`` names the tree's columns from the top, ``tokens`` the token counts. The whole budget is ``budget`` or
    ``share`` of all tokens. Of its budget a leaf takes whole epochs of all its documents, and of one more epoch the
    documents, in that epoch's seeded order, whose running total stays within the rest. Documents of no tokens are
    taken in every whole epoch and in the prefix. Null levels are values. Rows of one doc_id are taken together; a null
    token count is 0. The prefix of a leaf is given by its last place, which every row is compared with. Existing columns of the three names are replaced. No rows: no rows.
    """
    docs = without(docs, "leaf_tokens", "leaf_budget", "epochs")
    leaf = [f"{c}_leaf" for c in levels]
    amounts, turn, before = "amounts", "turn", "before"
    # a table of ids and counts decides; texts do not move
    narrow = cut_lineage(docs.select(
        *[F.col(c).alias(k) for c, k in zip(levels, leaf, strict=True)], F.col(doc_id).alias("id"),
        F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias(amounts)), "mixture-rows")
    leaves = narrow.groupBy(*leaf).agg(F.sum(amounts).alias("tokens"))
    if budget is None:
        budget = (leaves.agg(F.sum("tokens")).first()[0] or 0) * share[0] // share[1]
    given = leaf_budgets(leaves.toDF(*levels, "tokens"), weights, levels, budget, max_epochs).toDF(*leaf, "leaf_tokens", "leaf_budget")
    given = sent_if_small(given.withColumn("whole", F.when(F.col("leaf_tokens") > 0, F.expr("leaf_budget DIV leaf_tokens")).otherwise(F.lit(0))), "leaf-budgets")
    same = lambda x, y, left: reduce(and_, [x[a].eqNullSafe(y[b]) for a, b in zip(left, leaf, strict=True)])
    keys = narrow.join(given, same(narrow, given, leaf)).select(
        *[narrow[k] for k in leaf], "id", amounts, seeded_order(seed, F.col("whole"), F.col("id")).alias(turn),
        (F.col("leaf_budget") - F.col("whole") * F.col("leaf_tokens")).alias("rest")).where("rest > 0")
    keys = keys.groupBy(*leaf, turn, "id", "rest").agg(F.sum(amounts).alias(amounts))
    taken = running(keys, leaf, [turn, "id"], F.col(amounts), before=before).where(F.col(before) + F.col(amounts) <= F.col("rest"))
    cuts = taken.groupBy(*leaf).agg(F.max(F.struct(turn, "id")).alias("cut"))
    plan = given.join(cuts.toDF(*[f"{k}_cut" for k in leaf], "cut"), reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_cut")) for k in leaf]), "left")
    place, whole, last = fresh(docs, "place", "whole", "cut")
    # a row for each leaf: texts stay where they are, and a hot leaf is spread as the documents lie
    plan = sent_if_small(plan.select(*leaf, "leaf_tokens", "leaf_budget", F.col("whole").alias(whole), F.col("cut").alias(last)), "mixture-plan")
    rows = docs.join(plan, same(docs, plan, levels)).withColumn(
        place, F.struct(seeded_order(seed, F.col(whole), F.col(doc_id)).alias("turn"), F.col(doc_id).alias("id")))
    prefix = F.when(F.col(last).isNotNull() & (F.col(place) <= F.col(last)), 1).otherwise(0)
    return rows.select(*[docs[c] for c in docs.columns], "leaf_tokens", "leaf_budget", (F.col(whole) + prefix).cast("long").alias("epochs"))


def epoch_rows(rows: DataFrame, *, seed: int = 7, doc_id: str = "doc_id", epochs: str = "epochs") -> DataFrame:
    """A row for each time that a document of ``mixed`` is taken, with ``epoch`` and its seeded place ``turn``."""
    out = rows.where(F.col(epochs) > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(epochs) - 1)).alias("epoch"))
    return out.withColumn("turn", seeded_order(seed, F.col("epoch"), F.col(doc_id)))
