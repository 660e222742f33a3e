"""The Jaccard join against all pairs, and its parts one by one."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from test_text_operators import ODD, WORD, frame, lower

from veilgrid.llm import countjoin


def shingles(text, n):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def all_pairs(texts, n=3, percent=90):
    """Sorted (doc_id, n_shingles, component_id); rows of one id are one document."""
    sets = [(i, shingles(t, n)) for i, t in texts]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, x), (j, y) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return sorted((-1 if i is None else i, len(x), -1 if i is None else find(i)) for i, x in sets)


def found(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in df.collect())


def edited(words, r, changes):
    out = list(words)
    for _ in range(changes):
        k = r.randrange(len(out))
        what = r.randrange(3)
        if what == 0:
            out[k] = f"new{r.randrange(10**6)}"
        elif what == 1:
            del out[k]
        else:
            out.insert(k, f"more{r.randrange(10**6)}")
    return out


def families(seed, n=40):
    """Texts of all sizes with copies that differ in none to more words than a link allows, chains among them."""
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [f"w{r.randrange(60)}" for _ in range(r.choice([2, 3, 9, 11, 12, 14, 60, 80, 150, 400]))]
        for _ in range(r.choice([1, 2, 4, 8])):
            texts.append(" ".join(words))
            words = edited(words, r, r.choice([0, 1, 1, max(1, len(words) // 60), max(1, len(words) // 20)])) or ["x"]
    return texts


@pytest.mark.parametrize("settings", [countjoin.Settings(), countjoin.Settings(first=3, block=3, leaf=2)])
def test_against_all_pairs(spark, settings):
    texts = [(100 + 7 * i, t) for i, t in enumerate(families(1))] + [(i, t) for i, t in ODD if i != 6] + [(None, "no id"), (None, "no id"), (107, "another text of this id")]
    assert found(countjoin.jaccard_components(frame(spark, texts), settings)) == all_pairs(texts)
    assert len({c for _, _, c in all_pairs(texts)}) < len(texts) - 20


def test_a_group_of_many_different_copies(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = [(i, " ".join(edited(base, r, 1))) for i in range(300)] + [(1000 + i, " ".join(edited(base, r, 6))) for i in range(30)]
    settings = countjoin.Settings(first=16, block=64)
    assert found(countjoin.jaccard_components(frame(spark, texts), settings)) == all_pairs(texts)


def test_empty_tables(spark):
    assert countjoin.jaccard_components(frame(spark, [])).count() == 0
    assert found(countjoin.jaccard_components(frame(spark, [(1, None), (2, "")]))) == [(1, 0, 1), (2, 0, 2)]


def test_linked_sets_share_a_cell_and_stay_within_the_bound():
    r, classes = np.random.default_rng(3), countjoin.Classes(90)
    for _ in range(300):
        size = int(r.integers(9, 600))
        x = np.unique(r.integers(1, 1 << 62, size).astype(np.uint64))
        drop = int(r.integers(0, max(1, size // 18) + 1))
        y = np.unique(np.concatenate((x[drop:], r.integers(1, 1 << 62, int(r.integers(0, max(1, size // 18) + 1))).astype(np.uint64))))
        if 100 * len(np.intersect1d(x, y)) < 90 * len(np.union1d(x, y)):
            continue
        cells, counts = [], []
        for z in (x, y):
            sizes = np.array([len(z)])
            own = classes.of(sizes)
            below = np.where((own > 0) & (sizes <= classes.partner[own - 1]), own - 1, -1)
            row = np.zeros(len(z), np.int64)
            cells.append({k for scheme in (own, below) for k in countjoin.cell_keys(z, row, scheme, classes)[0].tolist()})
            counts += countjoin.count_vectors(z, row, sizes, classes)
        assert cells[0] & cells[1] or np.array_equal(x, y)
        folded = countjoin._folded(counts, np.array([len(x), len(y)]))
        assert folded.sum() == len(x) + len(y) and np.minimum(*folded).sum() >= len(np.intersect1d(x, y))


def test_trees_find_all_pairs_within_the_bound():
    r = np.random.default_rng(6)
    base = r.poisson(6, (20, 16))
    counts = np.maximum(0, np.repeat(base, 15, axis=0) + r.integers(-1, 2, (300, 16))).astype(np.uint16)
    sizes, component, side = counts.sum(axis=1).astype(np.int64), r.integers(0, 40, 300), r.integers(0, 2, 300)
    shared = np.minimum(counts[:, None, :], counts[None, :, :]).sum(axis=2)
    fits = np.triu((190 * shared >= 90 * (sizes[:, None] + sizes)) & (component[:, None] != component), 1)
    for sides, expected in ((np.zeros(300, int), fits), (side, fits & (side[:, None] != side))):
        x, y, _ = countjoin.similar_pairs(counts, sizes, component, sides, countjoin.Settings(leaf=8))
        assert {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist(), strict=True)} == set(zip(*(a.tolist() for a in np.nonzero(expected)), strict=True))
        assert len(x) == expected.sum() > 50


def test_boxes_leave_out_distant_leaves():
    counts = np.repeat(np.eye(8, dtype=np.uint16) * 40, 50, axis=0)
    tree = countjoin.CountTree(counts, counts.sum(axis=1).astype(np.int64), np.arange(400), np.zeros(400, int), 10)
    assert max(len(tree.near(leaf, 90, False)) for leaf in tree.leaves) <= 12 < len(tree.leaves)


def test_forests_connect_what_edges_connect():
    r = np.random.default_rng(7)
    x, y = r.integers(0, 200, (2, 230))
    x, y = x[x != y], y[x != y]
    def classes_of(edges):
        label = np.arange(200)
        for _ in range(200):
            for k in edges:
                label[[x[k], y[k]]] = min(label[x[k]], label[y[k]])
        return label
    chosen = countjoin.spanning(np.arange(200), x, y)
    assert np.array_equal(classes_of(chosen), classes_of(range(len(x)))) and len(chosen) == 200 - len(set(classes_of(chosen)))
    assert set(countjoin.best_partners(x, y, 1)) >= set(chosen[:1]) and len(countjoin.best_partners(x, y, 999)) == len(x)
