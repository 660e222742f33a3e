"""Running totals in a given order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.llm.frames import fresh
from veilgrid.session import cut_lineage


def running(df: DataFrame, keys: list[str], order: list[str], value: Column | None = None, *, before: str = "before", total: str | None = None) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` (default: 1, so a rank from 0) over earlier rows of the same ``keys``.

    Rows are range-partitioned by keys and order and written with the number of their partition. A partition's sums
    per key are added up over partitions, and rows over a partition's rows of one key. A key may hold any share of
    the rows as long as ``order`` tells them apart; rows that are equal in both follow each other in any order.
    ``total`` adds the key's whole sum under that name.
    """
    value = F.lit(1).cast("long") if value is None else value
    part, amount, offset, whole = fresh(df, "part", "amount", "offset", "whole")
    dealt = cut_lineage(
        df.withColumn(amount, value).repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), "ranked",
    )
    sums = dealt.groupBy(*keys, part).agg(F.sum(amount).alias(offset))
    group = Window.partitionBy(*keys)
    upto = F.sum(offset).over(group.orderBy(part)) - F.col(offset)
    sums = sums.select(*keys, part, upto.alias(offset), F.sum(offset).over(group).alias(whole))
    names = fresh(dealt, *[f"{k}_of" for k in keys], f"{part}_of")
    sums = sums.select(*[F.col(k).alias(n) for k, n in zip([*keys, part], names, strict=True)], offset, whole)
    same = [dealt[k].eqNullSafe(sums[n]) for k, n in zip([*keys, part], names, strict=True)]
    own = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = dealt.join(sums, same).withColumn(before, F.col(offset) + F.sum(amount).over(own) - F.col(amount))
    return joined.select(*df.columns, before, *([F.col(whole).alias(total)] if total else []))
