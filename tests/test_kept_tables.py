"""Work that several parts of a query need is done once and kept as a table."""

from __future__ import annotations

import random

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from veilgrid.functions import detect as D
from veilgrid.operators import audit as A
from veilgrid.operators import fusion as J
from veilgrid.operators import vault as U
from veilgrid.plans import catalog


@pytest.mark.parametrize("name", ["token_decisions", "audit_violations", "audit_verdicts", "raw_value_leaks"])
def test_elements_are_classified_once(spark, name):
    assert not any("lineitem" in f for f in catalog.QUERIES[name](spark, SF_DIR).inputFiles())


def test_stored_payloads_are_compressed(spark):
    files = catalog.QUERIES["payload_regions"](spark, SF_DIR).inputFiles()
    assert files and all(f.endswith(".json.gz") for f in files)


def test_findings_are_looked_for_once_by_the_gate(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "payload_id int")
    clean, held = A.send_gate(rows, spark.createDataFrame([(2,), (2,), (None,)], "payload_id int"))
    assert [r.payload_id for r in clean.collect()] == [1] and {r.payload_id for r in held.collect()} == {2, None}
    for side in (clean, held):
        assert any("held-payloads" in f for f in side.inputFiles())


def test_texts_without_spans_end_at_the_gate(spark):
    texts = ["el-1-123-456", "[EMAIL_abc]", "", None, "4111 1111-1111 1111", "9876543210", "ABCD0123456", "a@b.co", "code 1234", "1234 x Verification",
             "1234", "12-34-56-78-90-12", "0000000000", "OTP"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", f"{D.may_hold_sql('t')} as may", f"{D.spans_sql('t')} as s").collect()
    assert {r.t for r in rows if r.may} >= {r.t for r in rows if r.s}
    assert {r.t: r.may for r in rows}["el-1-123-456"] is False
    assert [len(r.s) for r in rows] == [0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 0, 1, 0, 0]


def test_tokens_name_the_first_type_and_rows_without_value_have_none(spark):
    rows = spark.createDataFrame(
        [("s", 1, "v", "EMAIL"), ("s", 2, "v", "NAME"), ("s", 3, None, "NAME"), ("s", 4, "", None), (None, 5, "v", "NAME"), ("t", 6, "v", "NAME")],
        "session_id string, seq int, raw_value string, sensitivity_type string")
    got = {r.seq: r.token for r in U.attach_tokens(rows, "k", ("seq",)).collect()}
    assert got[1] == got[2] and got[1].startswith("[EMAIL_") and got[6].startswith("[NAME_") and got[3] is got[4] is None and len(got) == 6


BOX = "payload_id int, seq bigint, box struct<x:int,y:int,w:int,h:int>"


def odd_boxes(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(12)]),
             (rng.choice([0, 5, 40, None]), rng.choice([0, 4]), rng.choice([0, 20, 24, None]), rng.choice([10, 20, -1]))) for _ in range(60)]
    return [*rows, *rows[:10]]


def test_small_payloads_are_matched_as_large_ones(spark):
    dom, vision = (spark.createDataFrame(odd_boxes(i), BOX) for i in (1, 2))
    whole, parts = J.match_regions(dom, vision), J.match_regions(dom, vision, block=1)
    assert not whole.inputFiles() and parts.inputFiles()
    rows = [sorted((str(tuple(r)) for r in found.collect())) for found in (whole, parts)]
    assert rows[0] == rows[1] and len(rows[0]) > 40


def test_small_payloads_are_merged_as_large_ones(spark):
    dom, vision = (spark.createDataFrame(odd_boxes(i), BOX).withColumn("note", F.lit(i)) for i in (3, 4))
    columns = ["payload_id", "seq", "box", "note", "source", "vision_confirmed"]
    whole = J.merge_channels(dom, vision)
    assert not whole.inputFiles()
    rows = [sorted(str(tuple(r)) for r in found.select(*columns).collect()) for found in (whole, J._merge_large(dom, vision))]
    assert rows[0] == rows[1] and any("True" in r for r in rows[0])


def test_leaves_are_opened_by_generators(spark):
    """Functions of lists are interpreted, leaf by leaf."""
    rows = spark.createDataFrame(
        [(1, {"b": [{"c": "x", "n": 1}, None, {"c": None, "n": 2}]}, {"Pwd": ["p", None], "k": None}, "t", [[["deep"]]]), (2, None, None, None, []), (None, {"b": None}, {}, "u", None)],
        "payload_id int, a struct<b:array<struct<c:string,n:int>>>, m map<string,array<string>>, note string, l array<array<array<string>>>")
    leaves = A.string_leaves(rows, ["payload_id"], ("pwd",))
    assert "lambda" not in leaves._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((str(r.payload_id), r.path, r.value, r.named) for r in leaves.collect()) == [
        ("1", "a.b[0].c", "x", False), ("1", "l[0][0][0]", "deep", False), ("1", "m.Pwd[0]", "p", True), ("1", "note", "t", False), ("None", "note", "u", False)]


def test_types_are_counted_as_spans_are(spark):
    rng = random.Random(3)
    parts = ["4111 1111-1111 1111", "9876543210", "1234-5678-9012", "ABCD0123456", "a@b.co", "a.b@c.de@f.gh", "OTP 1234", "code 123456", "el-3-123456-7890", "é", "😀", " ", "  ", "7", "x", ""]
    texts = [None, "9876543210 9876543210", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(500))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(
        "t", f"{D.spans_sql('t')} as s", f"{D.span_types_sql('t')} as kinds", f"{D.may_hold_sql('t')} as may").collect()
    assert all([s.type for s in r.s] == (r.kinds or []) for r in rows) and all(r.may for r in rows if r.s)
    assert all(r.t[s.start_idx:s.end_idx] == s.match for r in rows for s in r.s) and sum(len(r.s) for r in rows) > 300
