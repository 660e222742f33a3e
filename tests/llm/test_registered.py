"""The registered training-data queries against their SQL, and the columns that are agreed for them."""

from __future__ import annotations

import pytest
from compare import compare, duck
from conftest import SF_DIR

import __spark_entry__ as entry
import corpus_pipeline
from veilgrid.llm import queries, sql

COLUMNS = {
    "op1_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_url_filter": "page_id host path rule verdict",
    "op6_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op7_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op8_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op10_near_duplicates": "doc_id n_shingles component_id kept",
    "op11_vector_codes": "vec_id code error label_error codebooks_sha256",
    "op12_filter_interactions": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op13_jaccard_join": "doc_id n_shingles component_id",
}


def test_all_are_registered():
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert corpus_pipeline.ORACLE_SQL is None and set(sql.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_equal_to_sql(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    assert name not in COLUMNS or df.columns == COLUMNS[name].split()
    problem, rows = compare(df, duck(SF_DIR), sql.SQL[name])
    assert not problem and rows


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, SF_DIR, "documents").collect()}
    rows = queries.op8_token_counts(spark, SF_DIR)
    assert rows.columns == COLUMNS["op8_token_counts"].split()
    expected = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows.collect()} == {
        i: (len(texts[i].encode()), n, n > 512) for i, n in expected.items()}
