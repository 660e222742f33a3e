"""Jaccard join of n-gram sets with R-trees over count vectors.

The shingles of a document are hashed into groups; the counts per group are a point. The overlap of two sets is at most the
sum of the smaller counts over all groups, and that of two boxes at most the sum of their smaller upper corners, so a
tree of boxes finds all pairs that can be similar enough. What survives is verified on the whole sets.

Which points meet in a tree: a linked pair differs in at most D shingles, so if shingles are also dealt into D + 1 blocks,
one block is the same in both. A document is therefore in one cell per block, keyed by the block's shingles, and each cell
has a tree. D follows from the size class of the smaller document; larger partners are of the same or the next class and
stand in the cells of both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgrid.llm.graphs import components
from veilgrid.llm.neardup import confirmed, shingle_sets
from veilgrid.llm.words import mix, pieces
from veilgrid.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    """``words`` per shingle; links have a Jaccard similarity of ``percent`` / 100 at least. Trees have leaves of
    ``leaf`` points. Cells of more than ``first`` members meet in parts in the first round, of more than ``block`` later."""

    words: int = 3
    percent: int = 90
    leaf: int = 32
    first: int = 256
    block: int = 1024


class Classes:
    """Size classes: ``start`` of each, and for pairs whose smaller set is in the class the most differing shingles
    (``most``), the largest partner (``partner``) and the groups of a count vector (``groups``, powers of two)."""

    def __init__(self, percent: int):
        start = [1]
        while start[-1] < 1 << 40:
            start.append(start[-1] * 100 // percent + 1)
        self.start = np.array(start)
        largest = np.append(self.start[1:], 1 << 41) - 1
        self.partner = largest * 100 // percent
        self.most = (largest + self.partner) * (100 - percent) // (100 + percent)
        self.groups = np.array([1 << min(max(int(n // 2).bit_length(), 4), 10) for n in start])

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, sizes, side="right") - 1


POINTS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_hash", T.BinaryType()),
    T.StructField("counts", T.BinaryType()), T.StructField("cells", T.ArrayType(T.LongType())),
])
_BLOCKS, _GROUPS = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x5851F42D4C957F2D)


def cell_keys(values: np.ndarray, row: np.ndarray, scheme: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the cells of rows that take part in the cells of size class ``scheme`` (below 0: none), and their n + 1 offsets.

    ``values`` are shingles, ``row`` their rows. A class whose pairs cannot differ has no cells: equal sets are linked anyway.
    """
    n = np.where((scheme >= 0) & (classes.most[scheme] > 0), classes.most[scheme] + 1, 0)
    offsets = np.concatenate(([0], np.cumsum(n)))
    inside = n[row] > 0
    values, row = values[inside], row[inside]
    dealt = mix(values ^ _BLOCKS)
    block = ((dealt >> np.uint64(32)) * n[row].astype(np.uint64)) >> np.uint64(32)
    sums = np.zeros(offsets[-1], dtype=np.uint64)
    np.add.at(sums, offsets[row] + block.astype(np.int64), mix(dealt))
    of = np.repeat(np.arange(len(n)), n)
    name = mix((scheme[of].astype(np.uint64) << np.uint64(48)) + (np.arange(len(of)) - offsets[of]).astype(np.uint64))
    return mix(sums + name).view(np.int64), offsets


def count_vectors(values: np.ndarray, row: np.ndarray, sizes: np.ndarray, classes: Classes) -> list[bytes]:
    """Each row's counts per group, two bytes each (four for sets of 65,536 shingles and more)."""
    groups = np.where(sizes > 0, classes.groups[classes.of(np.maximum(sizes, 1))], 0)
    offsets = np.concatenate(([0], np.cumsum(groups)))
    bits = np.log2(np.maximum(groups, 2)).astype(np.uint64)
    group = mix(values ^ _GROUPS) >> (np.uint64(64) - bits[row])
    counts = np.bincount(offsets[row] + group.astype(np.int64), minlength=offsets[-1])
    return [counts[a:b].astype(_width(n)).tobytes() for a, b, n in zip(offsets, offsets[1:], sizes, strict=False)]


def _width(size: int) -> type:
    return np.uint16 if size < 1 << 16 else np.uint32


def points(docs: DataFrame, s: Settings, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: set size, a 128-bit hash of the set, its count vector and the keys of its cells."""
    classes = Classes(s.percent)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in pieces(batch.column(1)):
                part = batch.slice(start, end - start)
                values, offsets = shingle_sets(part.column(1), s.words)
                sizes = np.diff(offsets)
                row = np.repeat(np.arange(len(sizes)), sizes)
                own = np.where(sizes > 0, classes.of(np.maximum(sizes, 1)), -1)
                below = np.where((own > 0) & (sizes <= classes.partner[own - 1]), own - 1, -1)
                (keys, at), (more, more_at) = (cell_keys(values, row, scheme, classes) for scheme in (own, below))
                both = np.concatenate([x for a, b, c, d in zip(at, at[1:], more_at, more_at[1:], strict=False) for x in (keys[a:b], more[c:d])] or [keys])
                raw = values.tobytes()
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(sizes, pa.int64()),
                    pa.array([hashlib.blake2b(raw[8 * a: 8 * b], digest_size=16).digest() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary()),
                    pa.array(count_vectors(values, row, sizes, classes), pa.binary()),
                    pa.ListArray.from_arrays(pa.array((at + more_at).astype(np.int32)), pa.array(both)),
                ], names=POINTS.names)

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(place, POINTS)


class CountTree:
    """An R-tree of count vectors, loaded from the top: the widest coordinate is halved until ``leaf`` points are left.

    A node has its points' upper corner, least size, and the one component and side they share, or -1.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, component: np.ndarray, side: np.ndarray, leaf: int):
        self.counts, self.sizes = counts, sizes
        self.upper, self.least, self.one, self.children, self.points = [], [], [], [], []
        self.leaves: list[int] = []
        waiting = [(np.arange(len(sizes)), -1)]
        while waiting:
            own, parent = waiting.pop()
            node = len(self.upper)
            if parent >= 0:
                self.children[parent].append(node)
            some = counts[own]
            upper = some.max(axis=0)
            self.upper.append(upper)
            self.least.append(int(sizes[own].min()))
            self.one.append(tuple(int(x[own[0]]) if (x[own] == x[own[0]]).all() else -1 for x in (component, side)))
            self.children.append([])
            self.points.append(own if len(own) <= leaf else None)
            if len(own) <= leaf:
                self.leaves.append(node)
                continue
            widest = int((upper.astype(np.int64) - some.min(axis=0)).argmax())
            order = own[np.argsort(some[:, widest], kind="stable")]
            half = len(order) // 2
            waiting += [(order[half:], node), (order[:half], node)]
        self.upper, self.least = np.array(self.upper), np.array(self.least)

    def near(self, leaf: int, percent: int, across: bool) -> list[int]:
        """Leaves from ``leaf`` on that can hold a partner of one of its points."""
        found, level = [], [0]
        while level:
            at = np.array(level)
            shared = np.minimum(self.upper[at], self.upper[leaf]).sum(axis=1, dtype=np.int64)
            fits = (100 + percent) * shared >= percent * (self.least[at] + self.least[leaf])
            level = []
            for node, ok in zip(at.tolist(), fits, strict=True):
                (component, side), (own_component, own_side) = self.one[node], self.one[leaf]
                if not ok or (component == own_component >= 0) or (across and side == own_side >= 0):
                    continue
                if self.children[node]:
                    level += self.children[node]
                elif node >= leaf:
                    found.append(node)
        return found


def similar_pairs(counts: np.ndarray, sizes: np.ndarray, component: np.ndarray, side: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of points of different components (and sides, if there are two) whose bound allows a link, and their bounds."""
    tree = CountTree(counts, sizes, component, side, s.leaf)
    across = bool((side != side[0]).any())
    out: list[tuple[np.ndarray, ...]] = []
    for leaf in tree.leaves:
        x = tree.points[leaf]
        for near in tree.near(leaf, s.percent, across):
            y = tree.points[near]
            shared = np.minimum(counts[x][:, None, :], counts[y][None, :, :]).sum(axis=2, dtype=np.int64)
            total = sizes[x][:, None] + sizes[y][None, :]
            fits = ((100 + s.percent) * shared >= s.percent * total) & (component[x][:, None] != component[y][None, :])
            if across:
                fits &= side[x][:, None] != side[y][None, :]
            if near == leaf:
                fits = np.triu(fits, 1)
            i, j = np.nonzero(fits)
            out.append((x[i], y[j], shared[i, j] / (total[i, j] - shared[i, j])))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def spanning(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The edges, best first, of a spanning forest of the labels: each label takes its best edge, round after round."""
    label = np.unique(label, return_inverse=True)[1].ravel()
    chosen, open_ = [], np.arange(len(x))
    while True:
        a, b = label[x[open_]], label[y[open_]]
        differ = a != b
        open_, a, b = open_[differ], a[differ], b[differ]
        if not len(open_):
            return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
        best = np.full(label.max() + 1, len(x))
        np.minimum.at(best, a, open_)
        np.minimum.at(best, b, open_)
        has = np.flatnonzero(best < len(x))
        chosen.append(best[has])
        parent = np.arange(len(best))
        ends = label[x[best[has]]], label[y[best[has]]]
        parent[has] = np.where(ends[0] == has, ends[1], ends[0])
        mutual = (parent[parent] == np.arange(len(best))) & (np.arange(len(best)) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = np.unique(parent[label], return_inverse=True)[1].ravel()


def best_partners(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """The edges, best first, that are among the ``most`` best of either end."""
    edge, end = np.tile(np.arange(len(x)), 2), np.concatenate((x, y))
    order = np.lexsort((edge, end))
    new = np.ones(len(order), dtype=bool)
    new[1:] = end[order][1:] != end[order][:-1]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return np.unique(edge[order][place < most])


def _folded(raw: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Count vectors at the least number of groups among them; neighbouring groups are merged."""
    found = [np.frombuffer(v, _width(n)) for v, n in zip(raw, sizes, strict=True)]
    least = min(map(len, found))
    wide = np.uint16 if max(sizes) < 1 << 16 else np.uint32
    return np.stack([v.astype(wide) if len(v) == least else v.reshape(least, -1).sum(axis=1).astype(wide) for v in found])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list]]]:
    """Rows of each cell and pair of parts of a sorted input, as lists by column; a run has at most two parts."""
    key, held = None, None
    for batch in batches:
        columns = batch.to_pydict()
        for row in zip(*columns.values(), strict=True):
            if row[:3] != key:
                if held:
                    yield key[0], held
                key, held = row[:3], {name: [] for name in columns}
            for name, value in zip(columns, row, strict=True):
                held[name].append(value)
    if held:
        yield key[0], held


def candidates(placed: DataFrame, s: Settings, round_: int) -> DataFrame:
    """``cell``, ``a``, ``b``: pairs of each run that may be linked; a row without pair says that the cell has more of them.

    The first round gives a spanning forest of a run's pairs, the best ones first, later rounds the 8, 64, ... best
    partners of each member in other components. So no run gives more than a few pairs per member at a time.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])

        def told() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["cell", "a", "b"])
            for c in out:
                c.clear()
            return rows

        for cell, run in _runs(batches):
            ids, sizes, component, side = (np.array(run[c], dtype=np.int64) for c in ("id", "n_shingles", "component", "part"))
            if (component == component[0]).all():
                continue
            x, y, bound = similar_pairs(_folded(run["counts"], sizes), sizes, component, side, s)
            order = np.lexsort((np.maximum(ids[x], ids[y]), np.minimum(ids[x], ids[y]), -bound))
            x, y = x[order], y[order]
            chosen = spanning(component, x, y) if round_ == 0 else best_partners(x, y, 8**round_)
            if len(chosen) < len(x) or round_ == 0 and run["parts"][0] > 1:
                chosen_rows = [(None, None)]
            else:
                chosen_rows = []
            chosen_rows += zip(ids[x[chosen]].tolist(), ids[y[chosen]].tolist(), strict=True)
            for a, b in chosen_rows:
                out[0].append(cell)
                out[1].append(a if a is None else min(a, b))
                out[2].append(b if b is None else max(a, b))
            if len(out[0]) > 50_000:
                yield told()
        if out[0]:
            yield told()

    dealt = placed.select("cell", "i", "j", "part", "parts", "id", "n_shingles", "component", "counts").repartition("cell", "i", "j")
    return dealt.sortWithinPartitions("cell", "i", "j", "id").mapInArrow(find, "cell bigint, a bigint, b bigint")


def _parted(own: DataFrame, s: Settings, round_: int) -> DataFrame:
    """Members of cells (cell, id, size, component, ...) with the parts of their cell in which they meet.

    In the first round a part of a large cell meets itself only. Later on the members of one component that fill a part have
    parts of their own, which do not meet each other; all other parts do, two at a time under a key of their own.
    """
    if round_ == 0:
        parts = F.ceil(F.col("size") / s.first).cast("int")
        part = F.pmod(F.xxhash64("id", "cell"), parts).cast("int")
        return own.withColumns({"parts": parts, "part": part, "i": part, "j": part})
    groups = own.groupBy("cell", "component").agg(F.count("*").alias("alike"))
    mixed = groups.groupBy("cell").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("alike") < s.block, F.col("alike"))).alias("few")).where("kinds > 1")
    sizes = groups.join(mixed, "cell").select(F.col("cell").alias("c"), F.col("component").alias("k"), "alike", F.coalesce("few", F.lit(0)).alias("few"))
    # few members of a component share parts with other components; the number of a part is a hash in either case
    alone = F.col("alike") >= s.block
    spread = F.ceil(F.when(alone, F.col("alike")).otherwise(F.col("few")) / s.block)
    slot = F.pmod(F.xxhash64(F.when(alone, F.col("id")).otherwise(F.col("component")), "cell"), spread)
    placed = own.join(sizes, (own["cell"] == sizes["c"]) & (own["component"] == sizes["k"])).withColumn("sole", F.when(alone, F.col("component")))
    placed = placed.withColumn("part", F.xxhash64(F.coalesce("sole", F.lit(-1)), F.col("sole").isNull(), slot)).drop("c", "k", "alike", "few")
    parts = placed.select("cell", "part", "sole").distinct()
    other = parts.select(F.col("cell").alias("c"), F.col("part").alias("q"), F.col("sole").alias("other_sole"))
    meet = parts.join(other, (parts["cell"] == other["c"]) & (F.col("part") <= F.col("q"))).where("sole IS NULL OR other_sole IS NULL OR sole <> other_sole")
    meet = meet.select(F.col("cell").alias("c"), F.col("part").alias("i"), F.col("q").alias("j"))
    sides = meet.select("c", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("p"))
    return placed.join(sides, (placed["cell"] == sides["c"]) & (placed["part"] == sides["p"])).withColumn("parts", F.lit(1))


def jaccard_components(docs: DataFrame, settings: Settings = Settings(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest id that links reach) of every row of ``docs``.

    Words are runs without white space, A-Z lower-cased; a document is the set of its different shingles, or its whole
    sequence of words where that is shorter. Two are linked when 100 * intersection >= ``percent`` * union.

    1. Documents of equal sets are one class; its smallest id stands for it (partial aggregation, no pairs).
    2. Classes meet in cells (see above). Cells of the same members are one: their number and two 64-bit hashes of them
       are compared. A row of a cell has an id and a count vector, no text and no set.
    3. Rounds: the trees of the cells give candidates between components, whole sets confirm them, components follow.
       Cells that have more candidates go into the next round, with components as they are then, until none has.
       So a pair is left out only if it is in one component already, and a group of copies never becomes all its pairs.

    Rows without words, null texts included, are linked with nothing. Rows of one doc_id are one document; a null doc_id
    is linked with nothing and has null as component. No rows: no rows.
    """
    s = settings
    table = cut_lineage(points(docs, s, doc_id, text), "points")
    usable = table.where("id IS NOT NULL AND n_shingles > 0")
    first = cut_lineage(usable.groupBy("set_hash", "n_shingles").agg(F.min("id").alias("class")), "classes")
    classes = usable.select("id", "set_hash", "n_shingles").join(first, ["set_hash", "n_shingles"])
    same = classes.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").select("a", "b")
    of_class = first.select("set_hash", "n_shingles", F.col("class").alias("id"))
    reps = usable.where("size(cells) > 0").join(of_class, ["set_hash", "n_shingles", "id"], "left_semi").dropDuplicates(["set_hash", "n_shingles", "id"])
    reps = cut_lineage(reps.select("id", "n_shingles", "counts", "cells", F.xxhash64("set_hash").alias("mark")), "points")

    members = reps.select("id", "mark", F.explode("cells").alias("cell"))
    held = members.groupBy("cell").agg(  # an id may stand for two sets, hence the mark
        F.count("*").alias("size"), *[F.bit_xor(F.xxhash64(F.lit(k), "id", "mark")).alias(c) for k, c in enumerate("xy")]).where("size > 1")
    kept = held.groupBy("size", "x", "y").agg(F.min("cell").alias("cell")).select("cell", "size")
    open_ = cut_lineage(members.drop("mark").join(kept, "cell"), "cells")

    links = cut_lineage(same, "links")
    member, round_ = None, 0
    while True:
        own = open_.join(reps.select("id", "n_shingles", "counts"), "id")
        if member is None:
            own = own.withColumn("component", F.col("id"))
        else:
            own = own.join(member, "id", "left").withColumn("component", F.coalesce("component", "id"))
        found = cut_lineage(candidates(_parted(own, s, round_), s, round_), "candidates")
        pairs = found.where("b IS NOT NULL").select("a", "b").distinct()
        links = links.unionByName(cut_lineage(confirmed(cut_lineage(pairs, "pairs"), docs, s, doc_id, text), "links")).distinct()
        member = cut_lineage(components(links, "a", "b"), "components")
        again = found.where("b IS NULL").select("cell").distinct()
        if again.isEmpty():
            break
        open_, round_ = cut_lineage(open_.join(again, "cell", "left_semi"), "cells"), round_ + 1

    ids = classes.groupBy("id").agg(F.min("class").alias("class"))
    grouped = ids.join(member.withColumnRenamed("id", "class"), "class", "left").select("id", F.coalesce("component", "class").alias("component_id"))
    out = table.select("id", "n_shingles").join(grouped, "id", "left")
    return out.select(F.col("id").alias(doc_id), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
