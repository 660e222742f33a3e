"""Ordered per-key computations that never need a whole key in one task.

A key (a session, a client) may hold a third of all rows. Every operator here therefore
cuts a key into buckets of its order (a time slice, a block of arrival numbers): the row
work runs per (key, bucket), and one small summary per bucket carries state from one bucket
to the next. State machines do that as a parallel scan: summaries are composed up a tree over
ranges of buckets, and states go down the same tree, ``FAN`` summaries of a key in a task at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veilgrid.session import cut_lineage

#: Summaries of one key that a task composes.
FAN = 256


def widest_bucket(
    df: DataFrame, key: list[str], widths: dict[str, Column], max_rows: int = 5_000_000
) -> str | None:
    """Name of the first bucket column whose largest (key, bucket) group stays under ``max_rows``.

    One aggregated row per candidate reaches the driver. ``widths`` runs from wide to
    narrow; None means that no candidate is narrow enough.
    """
    for name, bucket in widths.items():
        sizes = df.groupBy(*key, bucket.alias("_b")).count()
        if (sizes.agg(F.max("count")).first()[0] or 0) <= max_rows:
            return name
    return None


def lag_by_bucket(
    df: DataFrame, key: list[str], bucket: str, order: list[str], columns: list[str], name: str
) -> DataFrame:
    """Add struct ``name`` with ``columns`` of the previous row of the key, or null at its start."""
    row = F.struct(*columns)
    inside = F.lag(row).over(Window.partitionBy(*key, bucket).orderBy(*order))
    tails = df.groupBy(*key, bucket).agg(F.max_by(row, F.struct(*order)).alias("_tail"))
    carry = tails.select(
        *key, bucket, F.lag("_tail").over(Window.partitionBy(*key).orderBy(bucket)).alias("_carry")
    ).where("_carry is not null")
    return (
        df.withColumn("_inside", inside).join(carry, [*key, bucket], "left")
        .withColumn(name, F.coalesce("_inside", "_carry")).drop("_inside", "_carry")
    )


def running_sum_by_bucket(
    df: DataFrame, key: list[str], bucket: str, order: list[str], amount: str, name: str
) -> DataFrame:
    """Add the sum of ``amount`` up to and with each row of the key."""
    inside = F.sum(amount).over(
        Window.partitionBy(*key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    totals = df.groupBy(*key, bucket).agg(F.sum(amount).alias("_total"))
    before = F.sum("_total").over(
        Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(*key, bucket, before.alias("_before"))
    return (
        df.withColumn("_inside", inside).join(carry, [*key, bucket], "left")
        .withColumn(name, F.col("_inside") + F.coalesce("_before", F.lit(0))).drop("_inside", "_before")
    )


def running_sum(df: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """Add the sum of ``amount`` over all rows up to and with each row, which ``order`` should tell apart.

    Rows are range-partitioned by their order and written with the number of their partition; only one sum per
    partition is ordered in a single task. So an instant that holds all rows is spread like any other.
    """
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "sweep")
    before = F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = dealt.groupBy("_part").agg(F.sum(amount).alias("_total")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(amount).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_inside", inside).join(sums, "_part").withColumn(name, F.col("_inside") + F.col("_before")).drop("_part", "_inside", "_before")


class Fold(Protocol):
    """A state machine over the ordered rows of a key, with a summary per bucket. Types are those of Spark's DDL."""

    SUMMARY: str
    STATE: str

    def summary(self, rows: list[tuple]) -> Any:
        """What a bucket does to any state that may enter it."""

    def compose(self, first: Any, second: Any) -> Any:
        """The summary of two buckets, one after the other."""

    def advance(self, state: Any, summary: Any) -> Any:
        """State after a bucket."""

    def step(self, state: Any, row: tuple) -> tuple[Any, tuple]:
        """State after one row, and the output columns of that row."""


ARROW_TYPES = {
    "boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(),
}


def _rows(batch: pa.RecordBatch, columns: list[str]) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in columns)))


def _groups(
    batches: Iterable[pa.RecordBatch], key: list[str], columns: list[str]
) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal key; a group may span batches."""
    current, rows = None, []
    for batch in batches:
        for k, row in zip(_rows(batch, key), _rows(batch, columns)):
            if k != current:
                if current is not None:
                    yield current, rows
                current, rows = k, []
            rows.append(row)
    if current is not None:
        yield current, rows


def _to_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _to_batch(held, schema)
            held = []
    if held:
        yield _to_batch(held, schema)


def _to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(zip(*rows), schema)], schema=schema
    )


def _typed(df: DataFrame, columns: list[str], **added: str) -> tuple[T.StructType, pa.Schema]:
    fields = [*(df.schema[c] for c in columns), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in added.items())]
    return T.StructType(fields), to_arrow_schema(T.StructType(fields))


def _summaries(
    df: DataFrame, key: list[str], bucket: str, order: list[str], columns: list[str], fold: Fold
) -> DataFrame:
    group = [*key, bucket]
    out, arrow = _typed(df, group, summary=fold.SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _groups(batches, group, columns)
        yield from _to_batches(((*k, fold.summary(rows)) for k, rows in groups), arrow)

    picked = df.select(*dict.fromkeys([*group, *order, *columns]))
    return picked.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, out)


def _composed(summaries: DataFrame, key: list[str], fold: Fold) -> DataFrame:
    """Summaries (key, slot) of ranges of ``FAN`` slots."""
    rows = summaries.withColumn("parent", F.expr(f"slot div {FAN}"))
    out, arrow = _typed(summaries, [*key, "slot"], summary=fold.SUMMARY)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, whole = None, None
        for batch in batches:
            for *k, summary in _rows(batch, [*key, "parent", "summary"]):
                if k == current:
                    whole = fold.compose(whole, summary)
                    continue
                if current is not None:
                    yield (*current, whole)
                current, whole = k, summary
        if current is not None:
            yield (*current, whole)

    dealt = rows.repartition(*key, "parent").sortWithinPartitions(*key, "parent", "slot")
    return dealt.mapInArrow(lambda batches: _to_batches(walk(batches), arrow), out)


def _descended(states: DataFrame, summaries: DataFrame, key: list[str], fold: Fold, last: bool = False) -> DataFrame:
    """State before each slot of ``summaries``, from the ``states`` before their ranges; with ``last`` that after a key's range."""
    out, arrow = _typed(summaries, [*key, "slot"], state=fold.STATE)
    none = {"summary": F.lit(None).cast(fold.SUMMARY), "state": F.lit(None).cast(fold.STATE)}
    heads = states.select(*key, F.col("slot").alias("parent"), F.lit(-1).cast("long").alias("slot"), none["summary"].alias("summary"), "state")
    rows = summaries.select(*key, F.expr(f"slot div {FAN}").alias("parent"), F.col("slot").cast("long").alias("slot"), "summary", none["state"].alias("state"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, state = None, None
        for batch in batches:
            for *k, slot, summary, entering in _rows(batch, [*key, "parent", "slot", "summary", "state"]):
                if slot < 0:
                    if last and current is not None:
                        yield (*current[:-1], 0, state)
                    current, state = k, entering
                    continue
                if not last:
                    yield (*k[:-1], slot, state)
                state = fold.advance(state, summary)
        if last and current is not None:
            yield (*current[:-1], 0, state)

    dealt = heads.unionByName(rows).repartition(*key, "parent").sortWithinPartitions(*key, "parent", "slot")
    return dealt.mapInArrow(lambda batches: _to_batches(walk(batches), arrow), out)


def _scan(summaries: DataFrame, key: list[str], bucket: str, fold: Fold, initial: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """State before each bucket, and of every key after its last one."""
    low, high = summaries.agg(F.min(bucket), F.max(bucket)).first()
    low = low or 0
    levels = [summaries.select(*key, (F.col(bucket) - low).cast("long").alias("slot"), "summary")]
    width = (high or 0) - low + 1
    while width > 1 or len(levels) == 1:
        levels.append(cut_lineage(_composed(levels[-1], key, fold), "summaries"))
        width = -(-width // FAN)
    start = levels[-1].select(*key, F.lit(0).cast("long").alias("slot"), F.lit(None).cast(fold.STATE).alias("state"))
    if initial is not None:  # keys without rows keep their state
        known = initial.select(*key, F.lit(0).cast("long").alias("slot"), "state")
        new = start.join(initial.select(*[F.col(k).alias(f"{k}_of") for k in key]),
                         [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in key], "left_anti")
        start = known.unionByName(new)
    ends = _descended(start, levels[-1], key, fold, last=True).select(*key, "state")
    states = start
    for level in reversed(levels[:-1]):
        states = _descended(states, level, key, fold)
    return states.select(*key, (F.col("slot") + low).alias(bucket), "state"), ends


def fold_by_bucket(
    df: DataFrame, key: list[str], bucket: str, order: list[str], columns: list[str], fold: Fold,
    output: str, initial: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run ``fold`` over every key in order; ``bucket`` is a whole number that grows with the order.

    Returns the rows with the ``output`` columns (``name type, ...``), and the state of
    every key after its last row (``key..., state``). ``initial`` holds states of that form.
    The state before a bucket travels as one more row of that bucket, so the rows are
    shuffled once and never joined.
    """
    group = [*key, bucket]
    summaries = cut_lineage(_summaries(df, key, bucket, order, columns, fold), "summaries")
    carries, ends = _scan(summaries, key, bucket, fold, initial)
    names = df.columns
    states = carries.select(*key, F.col(bucket).cast(df.schema[bucket].dataType).alias(bucket), "state", F.lit(0).alias("_row"))
    rows = df.withColumns({"state": F.lit(None).cast(fold.STATE), "_row": F.lit(1)}).unionByName(
        states, allowMissingColumns=True
    )
    added = [tuple(part.split()) for part in output.split(",")]
    out = df.schema
    for name, kind in added:
        out = T.StructType([*out.fields, T.StructField(name, T._parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            results = []
            for is_row, held, row in zip(
                batch.column("_row").to_pylist(), batch.column("state").to_pylist(), _rows(batch, columns)
            ):
                if is_row:
                    state, result = fold.step(state, row)
                    results.append(result)
                else:
                    state = held
            if results:
                kept = batch.filter(pc.equal(batch.column("_row"), 1)).select(names)
                values = [pa.array(v, type=ARROW_TYPES[kind]) for v, (_, kind) in zip(zip(*results), added)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *values], names=[*names, *(n for n, _ in added)])

    result = rows.repartition(*group).sortWithinPartitions(*group, "_row", *order).mapInArrow(run, out)
    return result, ends
