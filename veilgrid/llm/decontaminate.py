"""Benchmark decontamination: training texts lose the passages that test items contain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgrid.llm.frames import fresh
from veilgrid.llm.words import ALPHANUMERIC, Words, column_bytes, pieces
from veilgrid.session import cut_lineage

#: Windows that one broadcast may hold (some 100 bytes each); a larger benchmark goes round in several slices.
BROADCAST_WINDOWS = 400_000
_BITS = 24

WINDOWS = T.StructType([
    T.StructField("hash", T.LongType()), T.StructField("length", T.IntegerType()),
    T.StructField("words", T.BinaryType()), T.StructField("item", T.StringType()),
])
FOUND = (
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
)


def item_windows(benchmark: DataFrame, window: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """Every window of every item: its hash, number of words, words and item. A shorter item is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in pieces(batch.column(1)):
                part = batch.slice(start, end - start)
                words = Words(part.column(1), ALPHANUMERIC)
                at, found = words.windows(window)
                sizes = np.diff(words.first)
                short = np.flatnonzero((sizes > 0) & (sizes < window))
                alone = [int(words.windows_of_row(row)) for row in short]
                row = np.concatenate((np.searchsorted(words.first, at, side="right") - 1, short))
                first = np.concatenate((at, words.first[short]))
                length = np.concatenate((np.full(len(at), window), sizes[short]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((found.view(np.int64), np.array(alone, dtype=np.int64)))), pa.array(length, pa.int32()),
                     pa.array([words.text(i, n) for i, n in zip(first.tolist(), length.tolist(), strict=True)], pa.binary()),
                     part.column(0).take(pa.array(row))],
                    names=WINDOWS.names,
                )

    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    return items.mapInArrow(cut, WINDOWS).distinct()


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text: str = "text", item: str = "item_id",
    item_text: str = "text", slice_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` and ``spans``: what of each text stands in a benchmark item.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A window is ``window``
    consecutive words of an item; an item of fewer words, but not none, is one window. A word of a text inside
    any occurrence of a window is hit; ``spans`` are the byte ranges (UTF-8) of runs of hit words, ``items`` the
    ids of items with occurring windows, as strings, each once, unordered. Existing columns of these names are
    replaced.

    The windows are a broadcast hash set. Every token window of the texts is looked up by its rolling hash, and
    a hit counts only if its words are the item's words. A set of more than ``slice_windows`` windows is cut by
    hash into slices of that size, which go over the texts one after the other; no slice depends on the texts.

    Null, empty: no words, nothing hit. Repeated rows and doc_ids: each row by itself. A null item id is ''.
    No benchmark: nothing hit. Any size of text: work goes by blocks of bytes.
    """
    spark = docs.sparkSession
    windows = item_windows(benchmark, window, item, item_text)
    kinds = windows.groupBy("length").count().collect()  # at most ``window`` rows
    total = sum(r["count"] for r in kinds)
    slices = 1 if total <= slice_windows else -(-2 * total // slice_windows)  # half full on average: cut by hash
    plain = docs.drop(*[c for c in docs.columns if c.lower() in {f.name for f in FOUND}])
    out = plain.select(
        "*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
    )
    schema = T.StructType([*plain.schema.fields, *FOUND])
    for k in range(slices):
        part = windows.where(F.pmod("hash", F.lit(slices)) == k) if slices > 1 else windows
        table: dict[int, list] = {}
        for r in part.groupBy("hash", "length", "words").agg(F.sort_array(F.collect_set("item")).alias("items")).toLocalIterator():
            table.setdefault(r["hash"], []).append((r["length"], bytes(r["words"]), tuple(r["items"])))
        known = spark.sparkContext.broadcast(table)
        out = out.mapInArrow(_scan(known, plain.columns.index(_named(plain, text)), sorted(r["length"] for r in kinds)), schema)
        if k + 1 < slices:
            out = cut_lineage(out, "decontaminate")
    return out


def _named(df: DataFrame, name: str) -> str:
    return next(c for c in df.columns if c.lower() == name.lower())


def _scan(known, text_at: int, lengths: list[int]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        hashes = np.sort(np.fromiter(table, dtype=np.int64, count=len(table)).view(np.uint64))
        seen = np.zeros(1 << _BITS, dtype=bool)
        seen[hashes >> np.uint64(64 - _BITS)] = True
        for batch in batches:
            for start, end in pieces(batch.column(text_at)):
                yield _scanned(batch.slice(start, end - start), text_at, lengths, table, hashes, seen)

    return scan


def _scanned(batch: pa.RecordBatch, text_at: int, lengths: list[int], table: dict, hashes: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    words = Words(batch.column(text_at).cast(pa.string()), ALPHANUMERIC)
    rows, n = batch.num_rows, len(words.hash)
    edges = np.zeros(n + 1, dtype=np.int64)  # +1 where an occurrence starts, -1 behind it
    items = [set(x or ()) for x in batch.column(batch.num_columns - 2).to_pylist()]
    base = column_bytes(batch.column(text_at).cast(pa.string()))[1]
    for row, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):  # of earlier slices
        for span in spans or ():
            edges[np.searchsorted(words.start, base[row] + span["start"])] += 1
            edges[np.searchsorted(words.end, base[row] + span["end"], side="right")] -= 1
    for length in lengths:
        at, found = words.windows(length)
        near = np.flatnonzero(seen[found >> np.uint64(64 - _BITS)])
        if len(near):
            near = near[hashes[np.minimum(np.searchsorted(hashes, found[near]), len(hashes) - 1)] == found[near]]
        for i, key in zip(at[near].tolist(), found[near].view(np.int64).tolist(), strict=True):
            for size, passage, names in table[key]:
                if size == length and passage == words.text(i, length):
                    edges[i] += 1
                    edges[i + length] -= 1
                    items[int(np.searchsorted(words.first, i, side="right")) - 1].update(names)
    hit = np.cumsum(edges[:n]) > 0
    before = np.concatenate(([0], np.cumsum(hit)))
    spans: list[list[dict]] = []
    for row in range(rows):
        first, last = words.first[row], words.first[row + 1]
        own = np.diff(np.concatenate(([0], hit[first:last], [0])).astype(np.int8)) if before[last] > before[first] else np.zeros(0, np.int8)
        begins, ends = np.flatnonzero(own == 1) + first, np.flatnonzero(own == -1) + first - 1
        spans.append([
            {"start": int(words.start[a] - base[row]), "end": int(words.end[b] - base[row])} for a, b in zip(begins, ends, strict=True)
        ])
    added = [
        pa.array(np.diff(words.first), pa.int64()), pa.array(np.diff(before[words.first]), pa.int64()),
        pa.array([list(x) for x in items], pa.list_(pa.string())),
        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
    return pa.RecordBatch.from_arrays([*batch.columns[: batch.num_columns - 4], *added], names=batch.schema.names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "spans", text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """``docs``, same columns, without benchmark passages.

    ``remove="documents"``: documents with a hit go. ``remove="spans"``: the bytes of hit runs go from the text,
    ``n_chars`` (where the table has it) follows the new text, and a document of which no word is left goes.
    Documents without a hit stay as they are, also those without words.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    names = fresh(docs, "n_words", "n_hit", "items", "spans")
    if names != ["n_words", "n_hit", "items", "spans"]:  # keep columns of the table that have these names
        clash = {c: f"kept_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in ("n_words", "n_hit", "items", "spans")}
        back = {v: k for k, v in clash.items()}
        out = decontaminate(docs.withColumnsRenamed(clash), benchmark, remove=remove, text=text, n_chars=n_chars, **options)
        return out.withColumnsRenamed(back)
    found = benchmark_hits(docs, benchmark, text=text, **options)
    if remove == "documents":
        return found.where("n_hit = 0").select(*docs.columns)

    data = F.col(text).cast("binary")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end"))
    ends = F.concat(F.col("spans.start"), F.array(F.octet_length(text).cast("long")))
    kept = F.transform(
        F.arrays_zip(starts.alias("s"), ends.alias("e")),
        lambda p: F.hex(F.substring(data, (p["s"] + 1).cast("int"), (p["e"] - p["s"]).cast("int"))),
    )
    cut = F.decode(F.unhex(F.array_join(kept, "")), "UTF-8")
    out = found.where("n_hit < n_words or n_hit = 0").withColumn(text, F.when(F.col("n_hit") > 0, cut).otherwise(F.col(text)))
    number = next((c for c in docs.columns if c.lower() == n_chars.lower()), None)
    if number:
        kind = docs.schema[number].dataType
        out = out.withColumn(number, F.when(F.col("n_hit") > 0, F.length(text).cast(kind)).otherwise(F.col(number)))
    return out.select(*docs.columns)
