"""The filter audit against a plain simulation of every order."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from veilgrid.llm import interactions

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("mask", T.StringType()), T.StructField("part", T.StringType()), T.StructField("good", T.StringType()),
])
LABELS = "doc_id bigint, quality int, toxic int, part string, rows string"


def simulated(docs, labels):
    fails = []
    for i, text, source in docs:
        body = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        f = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in body) > 5 * len(body),
            "D": bool(re.search(r"[#$%&*|]", body)),
            "E": i is not None and any(j is not None and j < i and (t or "") == body for j, t, _ in docs),
        }
        said = [x for x in labels if i is not None and x[0] == i]
        fails.append((source or "", f, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out, shapley = {}, Counter()
    for part in {x[0] for x in fails}:
        own = [x for x in fails if x[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if x[1][name]]
                before = len([x for x in own if x[1][name]]) - len(gone)
                left = [x for x in left if not x[1][name]]
                shapley[part, name] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), before, sum(x[1][name] and sum(x[1].values()) == 1 for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def frames(spark, docs, labels):
    return (spark.createDataFrame([(*d, "m", "p", "g") for d in docs], DOCS).repartition(3),
            spark.createDataFrame([(*x, "p", "r") for x in labels], LABELS))


def test_against_a_simulation_of_every_order(spark):
    varied = " ".join(f"word{i}" for i in range(60))
    docs = [
        (1, varied, "a"), (2, varied, "a"), (2, varied, "b"), (3, varied.upper(), "a"), (4, "x " * 80, "a"), (5, None, "a"), (6, "", None), (7, " \t\n\x0b", ""),
        (8, varied + " #", "a"), (9, "SHORT $ TEXT", "b"), (9, "SHORT $ TEXT", "b"), (None, varied, "a"), (None, None, None), (10, "é" * 70_000 + " É", "b"),
        (11, ("A| " * 90) + varied, "a"), (12, "a\x0bb\x0cc " * 30, "b"), (13, varied, None), (14, varied + " ", "a"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (9, 1, 1), (None, 1, 1), (99, 1, 1), (11, 0, 1)]
    rows = interactions.filter_audit(*frames(spark, docs, labels)).collect()
    assert len(rows) == 3 * 600 and {tuple(r) for r in rows} == simulated(docs, labels)


def test_no_rows_and_no_labels(spark):
    docs, labels = frames(spark, [(1, "a", "s")], [(1, 1, 1)])
    assert interactions.filter_audit(docs.limit(0), labels).count() == 0
    assert {r["good_lost"] for r in interactions.filter_audit(docs, labels.limit(0)).collect()} == {0}


def test_gray_walk_equals_sums_over_cells():
    counts = np.random.default_rng(1).integers(0, 50, (3, 32, 3))
    states = interactions.gray_states(counts)
    for s in range(32):
        assert np.array_equal(states[:, s], counts[:, [m for m in range(32) if not m & s]].sum(axis=1))


def test_a_hot_text_is_spread_over_tasks(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'the same text' AS text", "'s' AS source", "'' AS mask")
    masks = interactions.failure_masks(docs)
    assert sorted((r["mask"] >> 4, r["count"]) for r in masks.groupBy("mask").count().collect()) == [(0, 1), (1, 2999)]
