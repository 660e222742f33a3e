"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.session import cut_lineage

#: Bytes, as text, of a table that joins may send to all tasks.
SENT_BYTES = 16 << 20


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, in any case, made from ``names`` by leading underscores."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def hash_128(*values: Column) -> Column:
    """Two 64-bit hashes of the same values, as one struct; a null is a value of its own."""
    marked = [x for v in values for x in (F.coalesce(v.cast("string"), F.lit("")), v.isNull())]
    return F.struct(F.xxhash64(F.lit(1), *marked).alias("a"), F.xxhash64(F.lit(2), *marked).alias("b"))


def sent_if_small(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder, and marked for broadcast if its rows as text are at most ``SENT_BYTES``.

    A larger one is joined by shuffling both sides, with the same rows.
    """
    df = cut_lineage(df, name)
    size = df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= SENT_BYTES else df
