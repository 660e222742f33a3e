"""Product codes against plain Lloyd rounds over all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.llm import codebooks

SCHEMA = "vec_id bigint, embedding array<float>, label int, CODE string, vec_key string, label_of int"


def plain(rows, s):
    """Rows (vec_id, vector, label) to (vec_id, code, error), and the codebooks."""
    x = [(i, [math.floor(s.scale * c) for c in v]) for i, v, *_ in rows]
    size = len(x[0][1]) // s.parts
    cut = lambda v, k: v[k * size: (k + 1) * size]
    first = sorted(x, key=lambda r: (r[0], r[1]))[: s.entries]
    books = [[cut(v, k) for _, v in first] for k in range(s.parts)]

    def best(v, k):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, k), entry, strict=True)), e) for e, entry in enumerate(books[k]))

    for _ in range(s.rounds):
        for k in range(s.parts):
            held = {}
            for _, v in x:
                held.setdefault(best(v, k)[1], []).append(cut(v, k))
            books[k] = [[sum(c) // len(held[e]) for c in zip(*held[e], strict=True)] if e in held else entry for e, entry in enumerate(books[k])]
    out = []
    for i, v in x:
        found = [best(v, k) for k in range(s.parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return sorted(out), books


def vectors(seed, n, dimension=8, spread=0.2):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dimension)] for _ in range(5)]
    return [[np.float32(c + r.gauss(0, spread)).item() for c in r.choice(centres)] for _ in range(n)]


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, "old", "k", 0) for r in rows], SCHEMA).repartition(partitions)


@pytest.mark.parametrize("block, entries, spread", [(16, 8, 0.05), (64, 16, 0.5), (1024, 256, 0.2)])
def test_against_plain_rounds(spark, block, entries, spread):
    s = codebooks.Settings(block=block, entries=entries, leaf=2)
    some = vectors(block, 150, spread=spread)
    rows = [(1000 - 3 * i, v, i % 3 or None) for i, v in enumerate(some)] + [(2000 + i, some[0], 1) for i in range(40)] + [(997, some[1], 2), (5, [0.0] * 8, 1)]
    expected, books = plain(rows, s)
    coded = codebooks.with_label_error(codebooks.compressed(frame(spark, rows), s)).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in coded) == expected
    assert {r["codebooks_sha256"] for r in coded} == {codebooks.books_sha256(np.array(books))}
    totals = {}
    for r in coded:
        totals[r["label"]] = totals.get(r["label"], 0) + r["error"]
    assert all(r["label_error"] == totals[r["label"]] for r in coded)


def test_dropped_and_uncoded_rows(spark):
    good = vectors(3, 20)
    rows = [(i, v, 0) for i, v in enumerate(good)] + [
        (50, None, 0), (51, [1.0] * 7 + [None], 0), (52, [1.0] * 7 + [float("nan")], 0), (53, [1.0] * 7 + [float("-inf")], 0),
        (54, [1.0] * 4, None), (55, [], 3), (None, good[0], 0), (56, [1e30] * 8, 0)]
    coded = {r["vec_id"]: r for r in codebooks.with_label_error(codebooks.compressed(frame(spark, rows))).collect()}
    assert set(coded) == {*range(20), None, 54, 55, 56}
    assert coded[54]["code"] is None and coded[55]["label_error"] is None and coded[None]["code"] == coded[0]["code"]
    assert coded[0]["error"] == 0 and coded[56]["code"] is not None
    for none in (rows[20:24], [(1, [1.0] * 7, 0)], []):
        left = codebooks.compressed(frame(spark, none, 1)).collect()
        assert len(left) == (none == [(1, [1.0] * 7, 0)]) and all(r["code"] is None for r in left)


def test_trees_cover_and_hold_each_point_once():
    points = np.unique(np.random.default_rng(2).integers(-500, 500, (400, 3)), axis=0)
    weight = np.random.default_rng(3).integers(1, 5, len(points))
    tree = codebooks.cover_tree(points, weight, 4)
    assert sorted(tree["order"]) == list(range(len(points))) and tree["count"][0] == weight.sum()
    for node in range(len(tree["point"])):
        below = tree["order"][tree["first_point"][node]: tree["end_point"][node]]
        apart = np.sqrt(((points[below] - points[tree["point"][node]]) ** 2).sum(axis=1))
        assert apart.max() <= tree["radius"][node] and tree["count"][node] == weight[below].sum()
        assert np.array_equal(tree["total"][node], (points[below] * weight[below, None]).sum(axis=0))
        children = range(tree["first_child"][node], tree["end_child"][node])
        assert sum(tree["count"][c] for c in children) in (0, tree["count"][node])
        assert all(tree["radius"][c] <= tree["radius"][node] / 2 + 1e-9 for c in children)


def test_whole_subtrees_are_assigned_where_clusters_are_clear():
    r = np.random.default_rng(4)
    centres = np.array([[0, 0], [10_000, 0], [0, 10_000]])
    points = np.unique(np.concatenate([c + r.integers(-50, 50, (200, 2)) for c in centres]), axis=0)
    tree = codebooks.cover_tree(points, np.ones(len(points), np.int64), 4)
    whole, single, _ = codebooks.nearest(points, tree, centres)
    assert not len(single) and sum(tree["count"][n].sum() for n, _ in whole) == len(points) and sum(len(n) for n, _ in whole) < 20


def test_large_components_are_exact():
    r = np.random.default_rng(5)
    x, y = r.integers(-codebooks.BOUND, codebooks.BOUND, (2, 6, 4))
    exact = [[sum(int(a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in y] for p in x]
    assert codebooks.squared(x, y).tolist() == exact
    assert codebooks.squared(x >> 12, y >> 12).tolist() == [[sum(int(a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in y >> 12] for p in x >> 12]


def test_a_hot_vector_is_one_point_of_each_tree(spark):
    docs = spark.range(5000).select(F.col("id").alias("vec_id"), F.expr("transform(sequence(1, 8), i -> CAST(i AS FLOAT))").alias("embedding"), F.lit(1).alias("label"))
    rows = codebooks.with_label_error(codebooks.compressed(docs)).groupBy("code", "error", "label_error").count().collect()
    assert [tuple(r) for r in rows] == [("00000000", 0, 0, 5000)]
