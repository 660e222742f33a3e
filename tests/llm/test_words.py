"""Word hashes: equal for equal bytes only, also for patterns that cancel out in a polynomial modulo a power of two."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from test_text_operators import frame, hits, lower

from veilgrid.llm import decontaminate, neardup, queries, tokens, words


def thue_morse(one: str, other: str, n: int = 2048) -> str:
    return "".join((one, other)[i.bit_count() & 1] for i in range(n))


PAIRS = [("a", "b"), ("x", "9"), ("é", "ü")]
WORDS = [thue_morse(*p) for p in PAIRS] + [thue_morse(*p[::-1]) for p in PAIRS]


def test_patterned_words_have_hashes_of_their_own():
    found = words.Words(pa.array([" ".join(WORDS), WORDS[0], f"lead {WORDS[3]}"]), words.SPACED)
    assert len(set(found.hash[:6].tolist())) == 6
    assert found.hash[6] == found.hash[0] and found.hash[8] == found.hash[3]


@pytest.mark.parametrize("span", [7, 64, 1 << 18])
def test_hashes_do_not_depend_on_where_a_span_lies(monkeypatch, span):
    monkeypatch.setattr(words, "_SPAN", span)
    long = "k" * 500 + "z"
    found = words.Words(pa.array([f"one {long}", None, "", f"  {long} two one", "o ne"]), words.SPACED)
    assert found.hash[0] == found.hash[4] and found.hash[1] == found.hash[2] != found.hash[3]
    assert len(set(found.hash.tolist())) == 5
    monkeypatch.setattr(words, "_SPAN", 1 << 18)
    assert np.array_equal(found.hash, words.Words(pa.array([f"one {long}", None, "", f"  {long} two one", "o ne"]), words.SPACED).hash)


def test_token_counts_of_patterned_words(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    texts = [(i, w) for i, w in enumerate([*WORDS, *(f"a {w}" for w in WORDS)])]
    rows = tokens.token_counts(frame(spark, texts, 1), queries.tokenizer_path()).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts}


def test_sets_of_patterned_words(spark):
    texts = [(i, f"{w} {x} {w}") for i, (w, x) in enumerate(zip(WORDS, [*WORDS[3:], *WORDS[:3]], strict=True))]
    rows = neardup.near_duplicates(frame(spark, texts, 1), neardup.Settings(words=2)).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows} == {(0, 2, 0), (1, 2, 1), (2, 2, 2), (3, 2, 0), (4, 2, 1), (5, 2, 2)}


def test_benchmark_passages_of_patterned_words(spark):
    items = [(1, WORDS[0]), (2, f"{WORDS[1]} {WORDS[4]}")]
    texts = [(i, f"x {w} {v} y") for i, (w, v) in enumerate((w, v) for w in WORDS for v in WORDS)]
    rows = decontaminate.benchmark_hits(frame(spark, texts, 1), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_hit"], tuple(sorted(r["items"]))) for r in rows) == sorted(
        (i, n, tuple(names)) for i, t in texts for _, n, names in [hits(t, items)])
    assert lower("É") == "É"
