"""Line deduplication over a whole corpus: keep bitmaps instead of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.llm.frames import fresh, hash_128
from veilgrid.session import cut_lineage

_SPACE = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key with more than one in so many of all occurrences is hot; there are fewer hot keys than this number.
HOT_SHARE = 1000


def lines_of(text: Column) -> Column:
    """The lines between ``\\n``; a null or empty text is one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def line_bitmaps(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``doc_id``, ``text_key`` and ``runs`` of the documents that lose lines.

    A key of ``least_chars`` characters or more that stands in ``least_docs`` documents or more loses all its lines
    except in the largest doc_id that holds it. ``runs`` is the keep bitmap, run-length coded: the lengths of runs
    of kept and dropped lines in turn, kept first (maybe 0), up to the last dropped line; what follows is kept.

    Line hashes (128 bits) are range-partitioned with the document behind the hash, so that a common line is spread
    over partitions, and sorted by hash, document and position. First occurrences stream by in that order, without an
    exchange of their own, and are written with the sorted ranges; a key's documents are counted from them, combined
    within each range before the shuffle. Keys with a large share of all occurrences are few, by their definition, and
    are broadcast; all others are joined.

    Documents are told apart by doc_id (null is one of them); rows of one doc_id and text share a bitmap, rows of
    one doc_id with different texts have one each and count as one document.
    """
    rows = docs.select(F.col(doc_id).alias("doc"), hash_128(F.col(text)).alias("text_key"), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    keyed = rows.select("doc", "text_key", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    # written first: the ranges' sample would split all texts a second time
    keyed = cut_lineage(keyed.select(hash_128(F.col("key")).alias("h"), "doc", "text_key", "pos"), "line-hashes")
    spread = keyed.repartitionByRange("h", "doc").sortWithinPartitions("h", "doc", "pos")
    # the ranges hold each (h, doc) whole and sorted, so the window neither exchanges nor sorts again
    first = F.row_number().over(Window.partitionBy("h", "doc").orderBy("pos")) == 1
    occurrences = cut_lineage(spread.withColumn("first", first), "lines")
    keys = occurrences.groupBy("h").agg(F.count_if("first").alias("docs"), F.max("doc").alias("keeper"), F.count("*").alias("n")).where(F.col("docs") >= least_docs)
    keys = cut_lineage(keys, "line-keys")
    total = occurrences.count()
    hot = F.col("n") > F.lit(max(1, total // HOT_SHARE))
    lost = F.broadcast(keys.where(hot))  # at most HOT_SHARE rows
    rare = keys.where(~hot)
    fall = ~F.col("doc").eqNullSafe(F.col("keeper"))
    others = occurrences.join(lost.select("h"), "h", "left_anti")
    dropped = occurrences.join(lost, "h").where(fall).select("doc", "text_key", "pos").unionByName(
        others.join(rare, "h").where(fall).select("doc", "text_key", "pos"))
    places = dropped.groupBy("doc", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    return places.select(F.col("doc").alias(doc_id), "text_key", _runs(F.col("at")).alias("runs"))


def _runs(at: Column) -> Column:
    """Run lengths (kept, dropped, kept, ...) of sorted, different dropped positions."""
    n = F.size(at)
    index = F.sequence(F.lit(0), n - 1)
    opens = F.filter(index, lambda i: (i == 0) | (F.get(at, i) - F.get(at, i - 1) > 1))
    closes = F.filter(index, lambda i: (i == n - 1) | (F.get(at, i + 1) - F.get(at, i) > 1))
    return F.flatten(F.transform(F.arrays_zip(opens.alias("o"), closes.alias("c"), F.sequence(F.lit(0), F.size(opens) - 1).alias("k")), lambda r: F.array(
        F.when(r["k"] == 0, F.get(at, F.lit(0))).otherwise(F.get(at, r["o"]) - F.get(at, r["o"] - 1) - 1), r["c"] - r["o"] + 1)))


def n_dropped(runs: Column) -> Column:
    """Dropped lines of a bitmap; 0 for null."""
    return F.coalesce(F.aggregate(F.filter(runs, lambda x, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def kept_text(text: Column, runs: Column) -> Column:
    """The lines that the bitmap keeps, joined by ``\n``; one pass over the lines."""
    keep = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    marked = F.filter(F.arrays_zip(lines_of(text).alias("line"), keep.alias("keep")), lambda x: F.coalesce(x["keep"], F.lit(True)))
    return F.when(runs.isNull(), F.coalesce(text.cast("string"), F.lit(""))).otherwise(F.array_join(F.transform(marked, lambda x: x["line"]), "\n"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``runs``, null where nothing is dropped. An existing ``runs`` column is replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "runs"])
    doc, key = fresh(docs, "bitmap_doc", "bitmap_key")
    marks = bitmaps.select(F.col(doc_id).alias(doc), F.col("text_key").alias(key), "runs")
    same = docs[doc_id].eqNullSafe(F.col(doc)) & (hash_128(docs[text]) == F.col(key))
    return docs.join(marks, same, "left").select(*[docs[c] for c in docs.columns], "runs")
