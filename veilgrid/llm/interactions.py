"""Interaction audit of filters: what each filter removes at each step of every order in which they can be applied.

Documents shrink to counts per part and failure mask (32 cells for five filters) in one partial aggregation. A walk over
the subsets of filters in Gray-code order toggles one filter at a time; only the cells that fail it change their counter
of active failures, and those whose counter leaves or reaches zero leave or join the running survivors. The 32 states of
a part are stored, and every step of every order is the difference of two of them.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgrid.session import cut_lineage

FILTERS = "ABCDE"
#: What is counted of each cell: rows, rows labelled good, rows labelled toxic.
COUNTS = ("rows", "good", "toxic")

_MATRIX = T.ArrayType(T.LongType())
STATES = T.StructType([T.StructField("part", T.StringType()), *[T.StructField(f"{k}_{c}", _MATRIX) for c in COUNTS for k in ("cells", "left")]])


def text_failures(text: Column) -> list[Column]:
    """The failure conditions A to D of one text; null is empty.

    A: under 50 words. B: 100 * distinct words < 65 * words (never without words). C: 100 * capitals A-Z > 5 * code
    points. D: holds one of ``#$%&*|``. Words are runs without white space, told apart by case.
    """
    whole = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(whole, F.lit(" \t\n\x0b\x0c\r"))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    n_words = F.when(trimmed == "", 0).otherwise(F.size(words))
    capitals = F.regexp_count(whole, F.lit("[A-Z]"))
    return [
        n_words < 50,
        F.size(F.array_distinct(words)) * 100 < n_words * 65,
        capitals * 100 > F.length(whole) * 5,
        whole.rlike(r"[#$%&*|]"),
    ]


def failure_masks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``doc_id``, ``part`` and ``mask`` (bit k: fails filter k of ``FILTERS``) of every row.

    Filter E fails where any smaller ``doc_id`` has the identical text: one row per different text holds its smallest
    id (combined before the shuffle), and rows look themselves up by id and text, so a text of any number of copies
    is spread over all tasks. Texts are compared by SHA-256 and length. A null id is neither smaller nor larger than
    another, so its row passes E. Null parts are ''.
    """
    measured = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        sum(F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_failures(F.col(text)))).alias("mask"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("sha"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("size"),
    )
    measured = cut_lineage(measured, "filter-masks")
    first = measured.groupBy("sha", "size").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL")
    first = first.select("doc_id", "sha", "size", F.lit(0).alias("repeats"))
    found = measured.join(first, ["doc_id", "sha", "size"], "left")
    repeats = F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("repeats", F.lit(1 << 4)))
    return found.select("doc_id", "part", (F.col("mask") + repeats).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of ``masks`` per ``part`` and ``mask``: rows, rows labelled quality = 1, rows labelled toxic = 1.

    A document with several labels is good (toxic) if one of them says so; without a label, or with null, neither.
    """
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.expr("CAST(quality = 1 AS INT)")).alias("good"), F.max(F.expr("CAST(toxic = 1 AS INT)")).alias("toxic"))
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c)
    return masks.join(said, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("rows"), count("good"), count("toxic"))


def gray_states(counts: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters: ``counts`` and the result are (part, mask or subset, kind of count).

    Subset s keeps what fails none of the filters whose bits s has.
    """
    n = counts.shape[1]
    masks = np.arange(n)
    active = np.zeros(n, dtype=np.int64)  # failures of each cell among the filters that are on
    alive = counts.sum(axis=1)
    states = np.zeros_like(counts)
    states[:, 0] = alive
    subset = 0
    for step in range(1, n):
        bit = (step & -step).bit_length() - 1  # the Gray code of step differs from the last in this bit
        subset ^= 1 << bit
        touched = masks[(masks >> bit) & 1 == 1]
        if subset >> bit & 1:
            left = touched[active[touched] == 0]
            active[touched] += 1
            alive = alive - counts[:, left].sum(axis=1)
        else:
            active[touched] -= 1
            back = touched[active[touched] == 0]
            alive = alive + counts[:, back].sum(axis=1)
        states[:, subset] = alive
    return states


def walked(counted: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """One row per part: for each kind of count its cells by mask and what every subset of filters leaves."""
    n = 1 << n_filters
    packed = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # at most n per part

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((batch.num_rows, n, len(COUNTS)), dtype=np.int64)
            for i, row in enumerate(batch.column(1).to_pylist()):
                for cell in row:
                    counts[i, cell["mask"]] = [cell[c] for c in COUNTS]
            states = gray_states(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(x[:, :, k]), pa.list_(pa.int64())) for k in range(len(COUNTS)) for x in (counts, states)]],
                names=STATES.names)

    return packed.select("part", "cells").mapInArrow(walk, STATES)


def order_steps(states: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order of ``filters`` and step, from the stored states of each part.

    ``kept`` after the step, ``removed`` in it, ``redundant`` (fails the step's filter, removed before), ``unique_fails``
    (fails no other), ``good_lost`` and ``toxic_lost`` (removed here with such a label) and ``shapley``: what the step's
    filter removes, added up over all orders.
    """
    n = len(filters)
    orders = list(itertools.permutations(range(n)))
    at = lambda name, k: F.get(F.col(name), F.col(k) if isinstance(k, str) else F.lit(k))
    steps = [("".join(filters[k] for k in o), i + 1, o[i], sum(1 << k for k in o[:i])) for o in orders for i in range(n)]
    plan = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "bit", "before"), s, strict=True)) for s in steps])),
                       "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    # what a filter removes over all orders: each set of filters before it, as often as orders begin with that set
    shapley = [
        sum((F.get("left_rows", F.lit(s)) - F.get("left_rows", F.lit(s | 1 << k))) * sum(1 for _, _, b, before in steps if b == k and before == s)
            for s in range(1 << n) if not s >> k & 1)
        for k in range(n)
    ]
    fails = [sum(F.get("cells_rows", F.lit(m)) for m in range(1 << n) if m >> k & 1) for k in range(n)]
    parts = states.select("*", F.array(*shapley).alias("all_orders"), F.array(*fails).alias("all_fails"))
    rows = parts.select("*", F.inline(plan)).withColumn("after", F.expr("before | shiftleft(1, bit)"))  # n! * n rows a part
    gone = lambda c: at(f"left_{c}", "before") - at(f"left_{c}", "after")
    return rows.select(
        "part", "filter_order", "step", at("left_rows", "after").alias("kept"), gone("rows").alias("removed"),
        (at("all_fails", "bit") - gone("rows")).alias("redundant"), F.get("cells_rows", F.expr("shiftleft(1, bit)")).alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), at("all_orders", "bit").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The steps of all orders of the five filters, zeros included, for every part of ``docs``; ``labels`` has doc_id, quality, toxic.

    Null texts are empty, null parts ''. Rows that share an id count each. Columns of other names do not matter, and
    no rows give no parts. A part of any share of the rows is counted by partial aggregation.
    """
    return order_steps(walked(cells(failure_masks(docs, doc_id=doc_id, text=text, part=part), labels)))
