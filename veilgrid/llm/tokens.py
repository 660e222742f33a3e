"""Exact token counts of texts of any length with a public tokenizer; huge texts are encoded in overlapping chunks."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgrid.llm.frames import fresh, hash_128
from veilgrid.llm.words import column_bytes, pieces
from veilgrid.session import cut_lineage

#: Characters of a chunk, of the first overlap, and of a text that is encoded in one go.
CHUNK, OVERLAP, WHOLE = 32_768, 256, 65_536
#: A chunk's last characters may be parted otherwise than in the whole text: a special token's string, a contraction
#: or white space that is cut. No boundary so near to the end is used. Special strings must be shorter.
GUARD = 64

ENCODED = T.StructType([
    T.StructField("key", T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])),
    T.StructField("k", T.IntegerType()), T.StructField("copies", T.LongType()), T.StructField("last", T.BooleanType()),
    T.StructField("n", T.LongType()),
    T.StructField("head_at", T.ArrayType(T.IntegerType())), T.StructField("head_n", T.ArrayType(T.IntegerType())),
    T.StructField("tail_at", T.ArrayType(T.IntegerType())), T.StructField("tail_n", T.ArrayType(T.IntegerType())),
])


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    parts = json.loads(found.to_str())
    cut = parts["pre_tokenizer"] or {}
    if cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space") or parts["normalizer"]:
        raise ValueError("the tokenizer must part texts as byte-level models do, without changing them first")
    if any(len(t["content"]) >= GUARD - 4 or " " in t["content"] or t["lstrip"] or t["rstrip"] for t in parts["added_tokens"]):
        raise ValueError("a special token must be short, hold no blank and take none in")
    return found


class _Counter:
    """Token counts of texts, each different unit of some megabytes encoded once.

    A unit ends before a blank that follows a character that is no white space. No piece goes over such a place: a
    piece holds a blank only as its first character or among white space. Nor does a piece depend on what stands
    behind such a place. So a text has the tokens of its units.
    """

    #: Bytes of the units that a worker remembers; then it forgets them all and starts anew.
    REMEMBERED = 1 << 25

    def __init__(self, path: str):
        self.encoder = _tokenizer(path)
        self.known: dict[str, int] = {}
        self.size = 0

    def __call__(self, column: pa.Array) -> np.ndarray:
        data, offsets = column_bytes(column)
        if not len(data):
            return np.zeros(len(column), dtype=np.int64)
        solid = (data > 0x20) & (data < 0x7F)
        solid[1:] |= (data[1:] >= 0x80) & (data[:-1] == 0xC3)  # Latin letters of two bytes
        opens = data == 0x20
        opens[1:] &= solid[:-1]
        opens[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(opens)
        edges = pa.py_buffer(np.append(start, len(data)).astype(np.int64))
        strings = pa.LargeStringArray.from_buffers(len(start), edges, pa.py_buffer(np.ascontiguousarray(data)))
        coded = strings.dictionary_encode()  # by bytes, so that only equal units share a count
        n = self._lengths(coded.dictionary.to_pylist())
        sums = np.concatenate(([0], np.cumsum(n[coded.indices.to_numpy()])))
        return np.diff(sums[np.searchsorted(start, offsets)])

    def _lengths(self, units: list[str]) -> np.ndarray:
        new = [u for u in units if u not in self.known]
        counts = dict(zip(new, (len(e) for e in self.encoder.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        n = np.array([counts[u] if u in counts else self.known[u] for u in units], dtype=np.int64)
        self.size += sum(map(len, new))
        if self.size > self.REMEMBERED:
            self.known, self.size = {}, 0
        else:
            self.known |= counts
        return n


def token_counts(
    docs: DataFrame, path: str, *, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, whole: int = WHOLE,
) -> DataFrame:
    """``docs`` with ``n_tokens``: the ids that the tokenizer file at ``path`` gives for each whole text.

    No begin, end or padding tokens are added; special strings inside texts are handled as the file says. The file
    must hold a byte-level model that parts texts before merging and does not normalise: pieces are then encoded
    independently. Executors read it at ``path``.

    Texts of up to ``whole`` characters are encoded in one task (``_Counter``). Longer ones are cut into chunks of ``chunk``
    characters, each continued ``overlap`` characters into the next. Chunks are dealt over all tasks. A place in the
    overlap where both encodings start a new piece is a stable boundary: pieces after it depend only on what follows.
    The counts are spliced there. Texts with a pair of chunks without such a place are encoded again with overlap
    and chunk four times as wide, until all pairs have one or the text is one chunk.

    Null and empty texts have 0 tokens. Each row counts by itself, repeated ones too; equal huge rows are encoded
    once. An existing ``n_tokens`` column is replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "n_tokens"])
    short = F.length(text) <= whole
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())])
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == text.lower())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = _Counter(path)
        for batch in batches:
            for start, end in pieces(batch.column(at)):
                part = batch.slice(start, end - start)
                n = tokens_of(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], schema=pa.schema([*part.schema, pa.field("n_tokens", pa.int64())]))

    counted = docs.where(F.col(text).isNull() | short).mapInArrow(count, schema)
    huge = docs.where(~short)
    (key,) = fresh(docs, "text_key")
    sizes = huge_counts(huge.select(F.col(text).alias("text")), path, chunk=chunk, overlap=overlap)
    keyed = huge.withColumn(key, hash_128(F.col(text)))
    rest = keyed.join(sizes.select(F.col("key").alias(key), F.col("n").alias("n_tokens")), key, "left").select(*docs.columns, "n_tokens")
    return counted.unionByName(rest)


def huge_counts(texts: DataFrame, path: str, *, chunk: int, overlap: int) -> DataFrame:
    """``key`` (of ``hash_128``) and ``n`` tokens of every different text of ``texts``, by spliced chunks."""
    done = None
    texts = texts.select(hash_128(F.col("text")).alias("key"), "text")
    while True:
        encoded = cut_lineage(_encoded(texts, path, chunk, overlap), "token-chunks")
        spliced = _spliced(encoded)
        fine = spliced.where("aligned").select("key", "n")
        done = fine if done is None else done.unionByName(fine)
        failed = spliced.where("not aligned").select("key")
        if failed.isEmpty():
            return done
        chunk, overlap = 4 * chunk, 4 * overlap
        texts = texts.join(failed, "key", "left_semi")


def _encoded(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """One row per chunk: its tokens, and where pieces start in the parts that it shares with its neighbours.

    Places count from the start of the next chunk (tail) or of this one (head), so shared places have equal numbers;
    beside each stands the number of the chunk's tokens before it.
    """
    cuts = T.StructType([ENCODED["key"], ENCODED["k"], ENCODED["last"], T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, text = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                for k, start in enumerate(range(0, len(text), chunk)):
                    last = start + chunk >= len(text)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key], batch.column(0).type), pa.array([k], pa.int32()), pa.array([last]),
                         pa.array([text[start: start + chunk + overlap]])],
                        names=cuts.names,
                    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(path)
        for batch in batches:
            for row in range(batch.num_rows):
                k, last, text = (batch.column(c)[row].as_py() for c in (1, 2, 3))
                n, starts = _pieces(encoder, text)
                head = [(p, before) for p, before in starts if p < overlap] if k else []
                tail = [] if last else [(p - chunk, before) for p, before in starts if chunk <= p < len(text) - GUARD]
                lists = [pa.array([[x[i] for x in side]], pa.list_(pa.int32())) for side in (head, tail) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, 1), pa.array([k], pa.int32()), batch.column(4).slice(row, 1), pa.array([last]),
                     pa.array([n], pa.int64()), *lists],
                    names=ENCODED.names,
                )

    chunks = texts.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    pieces_of = chunks.select("key", "text").mapInArrow(cut, cuts)
    dealt = pieces_of.withColumn("copies", F.lit(1).cast("long")).repartition(F.col("key"), F.col("k"))
    return dealt.mapInArrow(encode, ENCODED)


def _pieces(encoder, text: str) -> tuple[int, list[tuple[int, int]]]:
    """Tokens of ``text``, and each piece's first character with the number of tokens before it.

    A special token's string is parted off before pieces are cut, so a boundary there is stable as well; a piece is
    what the model merges within, or one special token.
    """
    found = encoder.encode(text, add_special_tokens=False)
    starts, previous, end = [], object(), 0
    for i, (word, (begin, stop)) in enumerate(zip(found.word_ids, found.offsets, strict=True)):
        if (word is None or word != previous) and begin >= end:
            starts.append((begin, i))
        previous, end = word, max(end, stop)
    return len(found.ids), starts


def _spliced(encoded: DataFrame) -> DataFrame:
    """``key``, ``n`` and whether all neighbours of the text's chunks share a place. Rows hold no text."""
    nearby = Window.partitionBy("key").orderBy("k")
    one = encoded.dropDuplicates(["key", "k"])
    after = one.select(
        "*", F.lead("head_at").over(nearby).alias("next_at"), F.lead("head_n").over(nearby).alias("next_n"),
    )
    place = F.try_element_at(F.array_intersect("tail_at", "next_at"), F.lit(1))
    after = after.withColumn("place", place)
    before = F.element_at("tail_n", F.array_position("tail_at", F.col("place")).cast("int"))
    skipped = F.element_at("next_n", F.array_position("next_at", F.col("place")).cast("int"))
    own = F.when(F.col("last"), F.col("n")).when(F.col("place").isNotNull(), before - skipped)
    return after.groupBy("key").agg(F.sum(own).alias("n"), F.bool_and(F.col("last") | F.col("place").isNotNull()).alias("aligned"))
