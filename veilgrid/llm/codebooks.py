"""Product codes of vectors by Lloyd rounds over partition-local cover trees.

Vectors are dealt into blocks. Of each block and part position a cover tree is built once over its different points:
a node has a point, the radius of all points below it, and the number and the sum of them. A round sends the small
codebooks to every task. A node whose nearest entry beats all others by more than twice its radius gives its whole count
and sum to that entry (triangle inequality); other nodes pass the entries still open down to their children, and
single points are compared exactly in integers. Tasks give back one sum per entry and component.
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

from veilgrid.llm.frames import fresh
from veilgrid.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    """``parts`` of a vector, ``entries`` of each part's codebook, Lloyd ``rounds``, vectors in a ``block`` (one tree
    for each part), points in a ``leaf``. Components are ``scale`` times the vector's, rounded down."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    block: int = 1024
    leaf: int = 8


#: Integer components are held within this bound, so that squared distances fit 64 bits: components of vectors beyond 16,384.
BOUND = 1 << 24
#: Squared distances below this are exact in double precision.
EXACT = 1 << 52

TREE = "point radius first_child end_child first_point end_point count total".split()


def quantised(rows: list, scale: int) -> np.ndarray:
    """Integer components of vectors of one length, rounded down."""
    x = np.floor(np.array(rows, dtype=np.float64) * scale)
    return np.clip(x, -BOUND, BOUND).astype(np.int64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``y``, as doubles where these are exact, else as integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * most * most * x.shape[1] < EXACT:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - y[None, :, k]) ** 2
    return out


def cover_tree(points: np.ndarray, weight: np.ndarray, leaf: int) -> dict[str, np.ndarray]:
    """A cover tree of different ``points`` that stand for ``weight`` vectors each, nodes in breadth-first order.

    Children of a node lie more than half its radius apart and cover its points within half its radius; the first
    child keeps the node's point. Nodes of at most ``leaf`` points have no children. ``order`` lists the points as the
    nodes hold them: each node has a run of it.
    """
    apart = np.sqrt(squared(points, points).astype(np.float64))
    order = np.arange(len(points))
    centre, start, end = [0], [0], [len(points)]
    first, last = [], []
    node = 0
    while node < len(centre):
        own = order[start[node]: end[node]]
        distance = apart[centre[node], own]
        first.append(len(centre))
        if len(own) > leaf:
            near = distance.max() / 2
            group = np.full(len(own), -1)
            chosen = centre[node]
            k = 0
            while True:
                open_ = np.flatnonzero(group < 0)
                if not len(open_):
                    break
                chosen = chosen if k == 0 else own[open_[0]]
                group[open_[apart[chosen, own[open_]] <= near]] = k
                centre.append(int(chosen))
                k += 1
            by_group = np.argsort(group, kind="stable")
            order[start[node]: end[node]] = own[by_group]
            edges = start[node] + np.searchsorted(group[by_group], np.arange(k + 1))
            start += edges[:-1].tolist()
            end += edges[1:].tolist()
        last.append(len(centre))
        node += 1
    start, end, centre = np.array(start), np.array(end), np.array(centre)
    radius = np.array([apart[c, order[a:b]].max() for c, a, b in zip(centre, start, end, strict=True)])
    counts = np.concatenate(([0], np.cumsum(weight[order])))
    totals = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order] * weight[order, None], axis=0)))
    return {
        "point": centre, "radius": radius, "first_child": np.array(first), "end_child": np.array(last), "first_point": start, "end_point": end,
        "count": counts[end] - counts[start], "total": totals[end] - totals[start], "order": order,
    }


def _expanded(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges first..end, and the number of the range of each."""
    sizes = end - first
    which = np.repeat(np.arange(len(first)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[which], which


def nearest(points: np.ndarray, tree: dict[str, np.ndarray], book: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Whole subtrees as (nodes, entries), and single points with their entries; ties go to the lower entry."""
    whole: list[tuple[np.ndarray, np.ndarray]] = []
    single: list[tuple[np.ndarray, np.ndarray]] = []
    nodes = np.zeros(1, dtype=np.int64)
    open_ = np.ones((1, len(book)), dtype=bool)
    while len(nodes):
        far = np.sqrt(squared(points[tree["point"][nodes]], book).astype(np.float64))
        far[~open_] = np.inf
        reach = far.min(axis=1) + 2 * tree["radius"][nodes]
        open_ = far <= (reach * (1 + 1e-9) + 1e-9)[:, None]
        sure = open_.sum(axis=1) == 1
        whole.append((nodes[sure], open_[sure].argmax(axis=1)))
        nodes, open_ = nodes[~sure], open_[~sure]
        inner = tree["end_child"][nodes] > tree["first_child"][nodes]
        leaves = nodes[~inner]
        at, which = _expanded(tree["first_point"][leaves], tree["end_point"][leaves])
        if len(at):
            at = tree["order"][at]
            exact = squared(points[at], book)
            exact[~open_[~inner][which]] = np.iinfo(np.int64).max if exact.dtype == np.int64 else np.inf
            single.append((at, exact.argmin(axis=1)))
        children, which = _expanded(tree["first_child"][nodes[inner]], tree["end_child"][nodes[inner]])
        nodes, open_ = children, open_[inner][which]
    at, entry = (np.concatenate([x[k] for x in single]) if single else np.zeros(0, np.int64) for k in (0, 1))
    return whole, at, entry


def _packed(points: np.ndarray, tree: dict[str, np.ndarray], back: np.ndarray) -> dict[str, bytes]:
    return {"points": points.astype(np.int32).tobytes(), "back": back.astype(np.int32).tobytes()} | {
        k: v.astype(np.float64 if k == "radius" else np.int64).tobytes() for k, v in tree.items()}


def _unpacked(row: dict, size: int) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]:
    points = np.frombuffer(row["points"], np.int32).reshape(-1, size).astype(np.int64)
    tree = {k: np.frombuffer(row[k], np.float64 if k == "radius" else np.int64) for k in (*TREE, "order")}
    tree["total"] = tree["total"].reshape(-1, size)
    back = np.frombuffer(row["back"], np.int32)
    return points, tree, back, np.bincount(back, minlength=len(points))


_TREE_TYPE = T.StructType([T.StructField(k, T.BinaryType()) for k in ("points", "back", *TREE, "order")])
_TREES = pa.list_(pa.struct([(k, pa.binary()) for k in _TREE_TYPE.names]))
_BLOCK = T.StructType([T.StructField("keys", T.BinaryType()), T.StructField("trees", T.ArrayType(_TREE_TYPE))])


def planted(vectors: DataFrame, s: Settings) -> DataFrame:
    """Blocks of vectors (``key``, ``vector``) with a cover tree for each part, made where the rows lie."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        n = 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            x = quantised(rows.column(1).to_pylist(), s.scale)
            size = x.shape[1] // s.parts
            trees = []
            for k in range(s.parts):
                points, back, weight = np.unique(x[:, k * size: (k + 1) * size], axis=0, return_inverse=True, return_counts=True)
                trees.append(_packed(points, cover_tree(points, weight, s.leaf), back.ravel()))
            keys = rows.column(0).to_numpy().astype(np.int64).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([keys], pa.binary()), pa.array([trees], _TREES)], names=_BLOCK.names)

        for batch in batches:
            rest.append(batch)
            n += batch.num_rows
            while n >= s.block:
                table = pa.Table.from_batches(rest)
                yield block(table.slice(0, s.block))
                rest, n = table.slice(s.block).to_batches(), n - s.block
        if n:
            yield block(pa.Table.from_batches(rest))

    return vectors.select("key", "vector").mapInArrow(plant, _BLOCK)


def lloyd_sums(blocks: DataFrame, books: np.ndarray, s: Settings) -> DataFrame:
    """``part``, ``entry``, ``n`` and ``component`` sums of the vectors that are nearest to each entry of ``books``."""
    sent = blocks.sparkSession.sparkContext.broadcast(books)  # entries x dimension numbers, whatever the rows

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        size = books.shape[2]
        n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for k, packed in enumerate(batch.column(0)[row].as_py()):
                    points, tree, _, weight = _unpacked(packed, size)
                    whole, at, entry = nearest(points, tree, books[k])
                    for nodes, entries in whole:
                        np.add.at(n[k], entries, tree["count"][nodes])
                        np.add.at(sums[k], entries, tree["total"][nodes])
                    np.add.at(n[k], entry, weight[at])
                    np.add.at(sums[k], entry, points[at] * weight[at, None])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([
            pa.array(part.repeat(size), pa.int32()), pa.array(entry.repeat(size), pa.int32()), pa.array(np.tile(np.arange(size), len(part)), pa.int32()),
            pa.array(n[part, entry].repeat(size), pa.int64()), pa.array(sums[part, entry].ravel(), pa.int64()),
        ], names=["part", "entry", "component", "n", "total"])

    found = blocks.select("trees").mapInArrow(add, "part int, entry int, component int, n bigint, total bigint")
    return found.groupBy("part", "entry", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def fitted(vectors: DataFrame, blocks: DataFrame, s: Settings) -> np.ndarray | None:
    """Codebooks (part, entry, component) after all rounds; None without vectors."""
    first = vectors.where("vec_id IS NOT NULL").orderBy("vec_id", "vector").limit(s.entries).collect()  # at most entries rows
    if not first:
        return None
    x = quantised([r["vector"] for r in first], s.scale)
    books = x.reshape(len(x), s.parts, -1).transpose(1, 0, 2).copy()
    for _ in range(s.rounds):
        for r in lloyd_sums(blocks, books, s).toLocalIterator():  # at most entries x dimension rows
            books[r["part"], r["entry"], r["component"]] = r["total"] // r["n"]
    return books


def encoded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``key``, ``code`` and ``error`` of every vector of ``blocks``."""
    sent = blocks.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                codes, errors = [], 0
                for k, packed in enumerate(batch.column(1)[row].as_py()):
                    points, tree, back, _ = _unpacked(packed, books.shape[2])
                    whole, at, entry = nearest(points, tree, books[k])
                    code = np.zeros(len(points), np.int64)
                    code[at] = entry
                    for nodes, entries in whole:
                        below, which = _expanded(tree["first_point"][nodes], tree["end_point"][nodes])
                        code[tree["order"][below]] = entries[which]
                    codes.append(code[back])
                    errors = errors + ((points - books[k][code]) ** 2).sum(axis=1)[back]
                keys = np.frombuffer(batch.column(0)[row].as_py(), np.int64)
                text = ["".join(f"{c:02x}" for c in x) for x in zip(*(c.tolist() for c in codes), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(text), pa.array(errors, pa.int64())], names=["key", "code", "error"])

    return blocks.mapInArrow(encode, "key bigint, code string, error bigint")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, s: Settings = Settings(), *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vectors`` with ``code``, ``error`` and ``codebooks_sha256``.

    Rows whose vector is null or holds nulls, NaN or infinities are dropped. Rows whose vector has no component, or not
    the number of components of the row of the smallest id (which must be a multiple of ``parts``, else no row has a
    code), stay with null results. A codebook starts with the parts of the ``entries`` smallest ids, or of all where
    there are fewer (equal ids by their vectors; null ids start none, but have codes if another row has an id).
    Repeated rows count each and share a code. Components are held within ``BOUND`` after scaling. Columns that are
    named like the results are replaced. No rows: no rows.

    Executors rebuild a lost block from the written vectors; nothing but codebooks passes the driver.
    """
    key, = fresh(vectors, "vec_key")
    results = {"code", "error", "codebooks_sha256"}
    vectors = vectors.drop(*[c for c in vectors.columns if c.lower() in results])
    unusual = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(F.col(vector).isNotNull() & ~F.coalesce(unusual, F.lit(False)))
    rows = cut_lineage(usable.withColumn(key, F.monotonically_increasing_id()), "vectors")
    plain = rows.select(F.col(key).alias("key"), F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    head = plain.where("vec_id IS NOT NULL").orderBy("vec_id", "vector").select(F.size("vector").alias("n")).first()
    size = head["n"] if head and head["n"] % s.parts == 0 else 0
    plain = plain.where((F.size("vector") == size) & F.lit(size > 0))
    blocks = cut_lineage(planted(plain, s), "cover-trees")
    books = fitted(plain, blocks, s) if size else None
    if books is None:
        return rows.drop(key).select("*", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("string").alias("codebooks_sha256"))
    codes = encoded(blocks, books).withColumnRenamed("key", key)
    return rows.join(codes, key, "left").drop(key).withColumn("codebooks_sha256", F.lit(books_sha256(books)))


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: the sum of ``error`` over rows of an equal label, nulls together; null if no row has one.

    Sums are combined before the shuffle, one row per label comes back, so a label of any share of the rows is no hot key there.
    """
    coded = coded.drop(*[c for c in coded.columns if c.lower() == "label_error"])
    of, = fresh(coded, "label_of")
    sums = coded.groupBy(F.col(label).alias(of)).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    return coded.join(sums, coded[label].eqNullSafe(sums[of]), "left").drop(of)
