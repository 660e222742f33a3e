"""MinHash near-duplicates with sequential Bayesian verification of candidates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgrid.llm.graphs import components
from veilgrid.llm.words import SPACED, Words, mix, pieces
from veilgrid.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    """``words`` per shingle; links have a Jaccard similarity of at least ``percent`` / 100.

    ``bands`` x ``rows`` MinHash values make candidates: a pair of the least similarity s shares no band with
    probability (1 - s ** rows) ** bands, 1.3e-7 by default. ``miss`` is the probability at which the posterior
    drops a candidate that is similar enough; it is looked at after each ``batch`` of values.
    """

    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5
    batch: int = 40
    miss: float = 1e-7

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


#: Bits of the filter that picks the documents whose sets are compared (16 MB); more ids let more others through.
MARKS = 1 << 27

SIGNED = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_hash", T.BinaryType()),
    T.StructField("signature", T.BinaryType()),
])
SETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("shingles", T.BinaryType())])


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's different shingles as sorted 64-bit hashes, row after row, and their n + 1 offsets.

    A row with fewer words than a shingle has its whole sequence as one; a row without words has none.
    """
    found = Words(column, SPACED)
    at, values = found.windows(words)
    n_words = np.diff(found.first)
    row = np.searchsorted(found.first, at, side="right") - 1
    for i in np.flatnonzero((n_words > 0) & (n_words < words)):
        h = np.uint64(0)
        for x in found.hash[found.first[i]: found.first[i + 1]]:
            h = mix(np.array([h ^ x], np.uint64))[0] + np.uint64(1)
        row, values = np.append(row, i), np.append(values, h)
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    row, values = row[new], values[new]
    return values, np.searchsorted(row, np.arange(len(column) + 1))


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return values[:n] | np.uint64(1), values[n:]


def signed(docs: DataFrame, s: Settings, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: set size, a 128-bit hash of the set, and one byte of each MinHash value."""
    factors, terms = _seeds(s.hashes)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in pieces(batch.column(1)):
                part = batch.slice(start, end - start)
                values, offsets = shingle_sets(part.column(1), s.words)
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes)
                least = np.zeros((part.num_rows, s.hashes), dtype=np.uint32)
                if len(full):
                    starts = offsets[:-1][full]
                    for k in range(s.hashes):
                        one = (values * factors[k] + terms[k]) >> np.uint64(32)
                        least[full, k] = np.minimum.reduceat(one.astype(np.uint32), starts)
                raw = values.tobytes()
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(sizes, pa.int64()),
                    pa.array([hashlib.blake2b(raw[8 * a: 8 * b], digest_size=16).digest() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary()),
                    pa.array([x.tobytes() for x in (least & 0xFF).astype(np.uint8)], pa.binary()),
                ], names=SIGNED.names)

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(sign, SIGNED)


def least_matches(s: Settings) -> list[int]:
    """Matches that a candidate needs after each batch to stay: fewer, and its similarity lies below the threshold
    with a posterior probability of 1 - ``miss`` at least.

    The prior is uniform, so the posterior after m of n matches is Beta(m + 1, n - m + 1). That a byte also matches
    by chance is not deducted; it only keeps more candidates.
    """
    t = s.percent / 100
    out = []
    for n in range(s.batch, s.hashes + 1, s.batch):
        # P(similarity >= t) = P(Binomial(n + 1, t) <= m)
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= s.miss:
                break
            m += 1
        out.append(m)
    return out


def likely(pairs: DataFrame, signatures: DataFrame, s: Settings) -> DataFrame:
    """``pairs`` (a, b) of which the signatures, batch after batch, do not rule out a link."""
    needed = least_matches(s)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, other = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, s.hashes) for c in (2, 3)
            )
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
            for k, least in enumerate(needed):
                part = slice(k * s.batch, (k + 1) * s.batch)
                matches = matches + (one[alive, part] == other[alive, part]).sum(axis=1)
                stays = matches >= least
                alive, matches = alive[stays], matches[stays]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], names=["a", "b"])

    left = signatures.select(F.col("id").alias("a"), F.col("signature").alias("one"), F.col("n_shingles").alias("n"))
    right = signatures.select(F.col("id").alias("b"), F.col("signature").alias("other"), F.col("n_shingles").alias("m"))
    both = pairs.join(left, "a").join(right, "b").where(F.least("n", "m") * 100 >= F.greatest("n", "m") * s.percent)
    return both.select("a", "b", "one", "other").mapInArrow(compare, "a bigint, b bigint")


#: Bits of one part of the filter; only parts with a bit that is set are held and sent.
PART = 1 << 15


def _marked(ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``MARKS`` bits, of which those of the hashes of ``ids`` are set: the place of each part, and the parts' bits as bytes.

    Parts without a set bit share place 0, whose bits are all clear. So the size goes with the ids, up to ``MARKS``.
    """
    at = F.pmod(F.xxhash64("id"), F.lit(MARKS))
    parts = ids.select(at.alias("at")).groupBy(F.expr(f"at DIV {PART}").alias("part")).agg(F.expr(f"bitmap_construct_agg(at % {PART})").alias("bits"))
    place, bits = np.zeros(MARKS // PART, dtype=np.int64), [bytes(PART // 8)]
    for row in parts.toLocalIterator():  # at most MARKS / PART rows
        place[row["part"]] = len(bits)
        bits.append(bytes(row["bits"]))
    return place, np.frombuffer(b"".join(bits), np.uint8)


def _may_be_marked(marked: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Whether the bits ``at`` are set."""
    place, bits = marked
    bit = place[at // PART] * PART + at % PART
    return (bits[bit >> 3] >> (bit & 7) & 1).astype(bool)


def _sets(docs: DataFrame, ids: DataFrame, s: Settings, doc_id: str, text: str) -> DataFrame:
    """``id`` and the whole shingle set of the documents ``ids``, and of a few others that share a bit with one.

    The bits are a filter in front of the joins that follow: texts themselves are not shuffled.
    """
    known = docs.sparkSession.sparkContext.broadcast(_marked(ids))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = known.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.take(pa.array(np.flatnonzero(_may_be_marked(marks, at))))
            for start, end in pieces(batch.column(1)):
                part = batch.slice(start, end - start)
                values, offsets = shingle_sets(part.column(1), s.words)
                raw = values.tobytes()
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([raw[8 * a: 8 * b] for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary()),
                ], names=SETS.names)

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.withColumn("at", F.pmod(F.xxhash64("id"), F.lit(MARKS))).mapInArrow(gather, SETS)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether the intersection of two sorted sets is at least ``percent`` / 100 of their union."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(x) < percent * len(y) or not len(x):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, docs: DataFrame, s: Settings, doc_id: str, text: str) -> DataFrame:
    """``pairs`` (a, b) of which the whole shingle sets have the least similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = [
                _similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in sets), s.percent)
                for sets in zip(batch.column(2), batch.column(3), strict=True)
            ]
            alive = pa.array(np.flatnonzero(stays))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(alive), batch.column(1).take(alive)], names=["a", "b"])

    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), s, doc_id, text)
    one, other = (sets.select(F.col("id").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "one"), ("b", "other")))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "one", "other").mapInArrow(verify, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document.

    Words are runs without white space, A-Z lower-cased; a document is the set of its different shingles. Documents
    are linked when the intersection of their sets is at least ``percent`` / 100 of the union; a component is what
    links reach, and keeps the document of the smallest id.

    1. Documents of equal sets are one class, its smallest id stands for it (partial aggregation, no pairs).
    2. Classes that share a band's key meet in a bucket. Each bucket first compares its members with its smallest
       one only. Candidates go through the Bayesian test on signature batches, survivors through an exact comparison
       of whole sets. Components of these links follow.
    3. Members of a bucket that are not in one component yet are compared with each other, so no link is lost: a pair
       left out is in one component already. Parts of a bucket meet as a whole, through the same two tests.

    Rows without words, null texts included, are linked with nothing. doc_ids should differ; rows of one doc_id are
    one document with the largest of their sets and come out once each. A null doc_id gives null component_id and
    is kept. No rows: no rows.
    """
    s = settings
    table = cut_lineage(signed(docs, s, doc_id, text), "signed")
    usable = table.where("id is not null and n_shingles > 0")
    # equal sets have equal signatures, so a class takes that of its smallest id
    reps = cut_lineage(usable.groupBy("set_hash", "n_shingles").agg(F.min("id").alias("id"), F.first("signature").alias("signature")), "classes")
    classes = usable.select("id", "set_hash", "n_shingles").join(reps.select("set_hash", "n_shingles", F.col("id").alias("class")), ["set_hash", "n_shingles"])
    reps = reps.groupBy("id").agg(F.max_by(F.struct("n_shingles", "signature"), "n_shingles").alias("r")).select("id", "r.*")
    keys = F.transform(F.sequence(F.lit(0), F.lit(s.bands - 1)), lambda b: F.struct(
        b.alias("band"), F.xxhash64(b, F.substring(F.col("signature"), b * s.rows + 1, F.lit(s.rows))).alias("bucket")))
    members = reps.select("id", "n_shingles", F.explode(keys).alias("k")).select("id", "n_shingles", "k.*")
    buckets = members.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("weight"), F.min("id").alias("first")).where("size > 1")
    crowded = cut_lineage(members.drop("n_shingles").join(buckets, "bucket"), "buckets")

    stars = crowded.where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    found = confirmed(cut_lineage(likely(stars, reps, s), "likely"), docs, s, doc_id, text)
    # documents of one id in several rows: their sets are one document's
    same = classes.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").select("a", "b")
    reached = cut_lineage(components(found.unionByName(same), "a", "b"), "components")
    member = cut_lineage(
        reps.select("id").join(reached, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "members",
    )
    more = cut_lineage(cross_links(crowded, member, reps, docs, s, doc_id, text), "links")
    if not more.isEmpty():
        between = more.join(member.toDF("a", "ca"), "a").join(member.toDF("b", "cb"), "b")
        joined = components(between, "ca", "cb").toDF("component", "whole")
        reached = reached.unionByName(joined.select(F.col("component").alias("id"), "component")).distinct().join(
            joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))

    ids = classes.groupBy("id").agg(F.min("class").alias("class"))
    grouped = ids.join(reached.withColumnRenamed("id", "class"), "class", "left").select("id", F.coalesce("component", "class").alias("component_id"))
    out = table.select("id", "n_shingles").join(grouped, "id", "left")
    return out.select(
        F.col("id").alias(doc_id), "n_shingles", F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole runs of rows that are equal in the first ``keys`` columns, run after run of a sorted input."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        last = [batch.column(c)[-1] for c in range(keys)]
        if [rest[0].column(c)[0] for c in range(keys)] == last:
            continue
        whole = pa.Table.from_batches(rest)
        differs = np.zeros(whole.num_rows, dtype=bool)
        for c in range(keys):
            differs |= whole.column(c).to_numpy() != last[c].as_py()
        cut = int(np.flatnonzero(differs)[-1]) + 1
        yield whole.slice(0, cut)
        rest = whole.slice(cut).to_batches()
    if rest:
        yield pa.Table.from_batches(rest)


def _bounds(table: pa.Table, keys: int) -> np.ndarray:
    """Where runs of rows equal in the first ``keys`` columns start, and the end."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for c in range(keys):
        column = table.column(c).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _faced(crowded: DataFrame, member: DataFrame, block: int, shingles: int) -> DataFrame:
    """``bucket``, ``i``, ``j``, ``part``, ``band``, ``id``, ``component`` of buckets with members of several components.

    A bucket of more than ``block`` members, or of more than ``shingles`` shingles, is cut into parts; every two parts
    meet under a key of their own, so no task holds more than two parts of a bucket.
    """
    own = crowded.where("size > 2").join(member, "id")
    mixed = own.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    parts = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("weight") / shingles)).cast("int")
    placed = own.join(mixed.select("bucket"), "bucket", "left_semi").select(
        "bucket", "band", "id", "component", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    each = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return each.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "band", "id", "component")


def cross_links(crowded: DataFrame, member: DataFrame, reps: DataFrame, docs: DataFrame, s: Settings, doc_id: str, text: str, block: int = 2048, shingles: int = 2_000_000) -> DataFrame:
    """Links (a, b) between bucket members of different components, without a row for each pair.

    Parts of a bucket are compared as a whole. A pair is looked at in the first band that it shares, which the
    signatures tell, and taken through the Bayesian batches. Each member goes on with the list of its likely
    partners, and these pairs are compared by their whole sets.
    """
    needed = least_matches(s)
    kinds = T.StructType([
        T.StructField("bucket", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
        T.StructField("id", T.LongType()), T.StructField("partners", T.ArrayType(T.LongType())),
    ])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 3):
            bounds = _bounds(table, 3)
            part, i, j, band, ids, own = (table.column(c).to_numpy() for c in ("part", "i", "j", "band", "id", "component"))
            marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, s.hashes)
            sizes = table.column("n_shingles").to_numpy()
            out: dict[str, list] = {"bucket": [], "i": [], "j": [], "id": [], "partners": []}
            for start, end in zip(bounds, bounds[1:], strict=False):
                at = np.arange(start, end)
                ones, others = (at, at) if i[start] == j[start] else (at[part[start:end] == i[start]], at[part[start:end] == j[start]])
                met: dict[int, list[int]] = {}
                for x in ones:
                    y = others[own[others] != own[x]]
                    y = y[y > x] if i[start] == j[start] else y
                    y = y[np.minimum(sizes[y], sizes[x]) * 100 >= np.maximum(sizes[y], sizes[x]) * s.percent]
                    matches = np.zeros(len(y), dtype=np.int64)
                    for k, least in enumerate(needed):
                        if not len(y):
                            break
                        piece = slice(k * s.batch, (k + 1) * s.batch)
                        matches = matches + (marks[y, piece] == marks[x, piece]).sum(axis=1)
                        y, matches = y[matches >= least], matches[matches >= least]
                    if len(y):
                        shared = (marks[y] == marks[x]).reshape(len(y), s.bands, s.rows).all(axis=2)
                        y = y[shared.argmax(axis=1) == band[start]]
                    if len(y):
                        met[int(x)] = ids[y].tolist()
                        for z in y.tolist():
                            met.setdefault(z, [])
                for x, partners in met.items():
                    for name, value in (("bucket", table.column("bucket")[x].as_py()), ("i", i[start]), ("j", j[start]), ("id", ids[x]), ("partners", partners)):
                        out[name].append(value)
            if out["id"]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["bucket"], pa.int64()), pa.array(out["i"], pa.int32()), pa.array(out["j"], pa.int32()),
                     pa.array(out["id"], pa.int64()), pa.array(out["partners"], pa.list_(pa.int64()))], names=kinds.names)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 3):
            bounds = _bounds(table, 3)
            ids, partners, raw = table.column("id").to_pylist(), table.column("partners").to_pylist(), table.column("shingles").combine_chunks()
            found: list[tuple[int, int]] = []
            for start, end in zip(bounds, bounds[1:], strict=False):
                sets = {ids[k]: np.frombuffer(raw[k].as_buffer(), np.uint64) for k in range(start, end)}
                found += [(ids[k], y) for k in range(start, end) for y in partners[k] if _similar(sets[ids[k]], sets[y], s.percent)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    faced = _faced(crowded, member, block, shingles).join(reps, "id").select(
        "bucket", "i", "j", "part", "band", "id", "component", "n_shingles", "signature")
    likely_members = cut_lineage(
        faced.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id").mapInArrow(compare, kinds), "likely")
    sets = _sets(docs, likely_members.select("id").distinct(), s, doc_id, text)
    grouped = likely_members.join(sets, "id").select("bucket", "i", "j", "id", "partners", "shingles")
    return grouped.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id").mapInArrow(verify, "a bigint, b bigint")
