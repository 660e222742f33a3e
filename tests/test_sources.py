from __future__ import annotations

import json

from veilgrid.functions import registry
from veilgrid.operators import elements as E
from veilgrid.session import shared_folder
from veilgrid.sources import audit_log, html, payloads, vision


def test_multi_line_payload_with_mark(spark, tmp_path):
    doc = {"session_id": "s", "task_instruction": "go", "step_number": 1, "dom_summary": {"url": "u", "elements": [
        {"element_id": "el-1", "tag": "input", "role": "textbox", "is_sensitive": True, "semantic_token": "[EMAIL_1]",
         "bounding_box": {"x": 1, "y": 2, "w": 3, "h": 4}}]},
        "detection_confidence_notes": [{"element_id": "el-1", "confidence": 0.95, "method": "dom_heuristic"}]}
    path = tmp_path / "payload.json"
    path.write_text("﻿" + json.dumps(doc, indent=2), encoding="utf-8")
    tables = payloads.payload_tables(payloads.read_payloads(spark, str(path), multi_line=True))
    element = tables["elements"].first()
    assert (element.element_id, element.bounding_box.h, element.session_id) == ("el-1", 4, "s")
    assert tables["notes"].first().confidence == 0.95 and tables["regions"].count() == 0
    assert tables["payloads"].first().payload_id is not None


def test_broken_and_unknown_payloads_stay(spark, tmp_path):
    path = tmp_path / "lines.json"
    path.write_text('{"payload_id":7,"memo":"4111111111111111"}\n{broken\n[1]\n\n{"session_id":"s"}\n', encoding="utf-8")
    rows = payloads.read_payloads(spark, str(path)).collect()
    assert sorted(str(r.reject_reason) for r in rows) == ["None", "None", "invalid_json", "invalid_json"]
    assert len({r.payload_id for r in rows}) == 4 and "4111111111111111" in {r.payload_id: str(r.line) for r in rows}[7]


def test_audit_appends(spark):
    path = shared_folder(spark, "log")
    rows = spark.createDataFrame([("s", 1, "h", ("type", "[REDACTED]"), 0.9)],
                                 "session_id string, step_number int, instruction_hash string, action struct<type:string,value:string>, confidence double")
    audit_log.append_audit(rows, path)
    audit_log.append_audit(rows, path)
    back = audit_log.read_audit(spark, path)
    assert back.count() == 2 and back.where("timestamp is null").count() == 0


def test_ocr_and_faces(spark):
    pages = spark.createDataFrame([(1, [{"paragraphs": [{"lines": [
        {"text": " hi ", "bbox": {"x0": -3.0, "y0": 1.5, "x1": 4.4, "y1": 1.0}, "confidence": 90.0},
        {"text": "  ", "bbox": None, "confidence": None}]}, {"lines": None}]}])], f"id int, blocks {vision.OCR_BLOCKS}")
    row = vision.ocr_lines(pages).first()
    assert (row.text, tuple(row.box), row.confidence) == ("hi", (0, 2, 7, 0), 0.9)
    faces = spark.createDataFrame([(1, -4.0, 2.5, 10.0, 10.4, None), (2, 1.0, 1.0, 0.2, 5.0, 0.5)],
                                  "id int, origin_x double, origin_y double, width double, height double, score double")
    got = vision.face_rows(faces).collect()
    assert [(r.id, tuple(r.box), r.confidence) for r in got] == [(1, (0, 3, 10, 10), 0.0)]


PAGE = """<html><body><label for=u>User <b>name</b></label><input id=u value=tom><label>Pass<input type=password data-ext-id=x9></label>
<p>Total: <!-- note --> <input name=t></p><div><span>Phone</span><br><input type=tel></div>
<select id=s><option value=1>One<option value=2 selected>Two</select><textarea>some
text</textarea><button type=submit><i>Send</i> now</button><label for=u>later</label></div></body>"""


def test_html_elements(spark):
    rows = html.html_elements(spark.createDataFrame([(7, PAGE), (8, None), (9, "<p>x")], "page_id bigint, html string"))
    got = rows.orderBy("seq").collect()
    assert [(r.tag, r.own_label and " ".join(r.own_label.split()), r.sibling_text, r.value) for r in got] == [
        ("input", "User name", "User name", "tom"), ("input", "Pass", "Pass", None), ("input", None, "Total:", None),
        ("input", None, "Phone", None), ("select", None, "Phone", "2"), ("textarea", None, "OneTwo", "some\ntext"),
        ("button", None, "some\ntext", None)]
    typed = {r.seq: (r.sensitivity_type, r.label_text) for r in E.classify_elements(rows).collect()}
    assert typed[0] == ("NAME", "User name") and typed[1] == ("PASSWORD", "Pass") and typed[2][0] == "AMOUNT"
    assert typed[3] == ("PHONE", "Phone") and typed[6] == ("UNKNOWN", "Send now")


def test_page_failures(spark):
    pages = spark.createDataFrame([
        ("<p>ok</p>",), ("<p>Login <b>failed</b></p>",), ("<script>error</script><p>ok</p>",), ("<p class='x alert-danger'>!</p>",),
        ("<p class='noerror'>fine</p>",), ("<p role=\"alert\"></p>",), ("<div role=alert></div>",), ("<span class=error></span>",),
        ("<!-- <p class='error'>access denied</p> -->",), ("<p>access\n   denied</p>",), ("<p>try</p><p>again</p>",), (None,)], "html string")
    assert [r.verified for r in html.page_failures(pages).collect()] == [
        True, False, True, False, True, False, False, False, True, False, False, True]


def test_normalised_responses(spark):
    raw = ['{"type":"click"}', '[{"type":"wait"}]', '[]', '{"action":{"type":"type"}}', '{"actions":[{"type":"scroll"}]}',
           '{"result":"x","type":"wait"}', '"x"', "{", "", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "id int, raw_response string")
    got = [(r.type, r.reject_reason) for r in payloads.normalise_responses(rows).orderBy("id").collect()]
    assert got == [("click", None), ("wait", None), (None, "not_an_object"), ("type", None), ("scroll", None), ("wait", None),
                   (None, "not_an_object"), (None, "invalid_json"), (None, "empty_response"), (None, "empty_response")]


def test_sql_functions_and_detectors(spark):
    registry.register_sql_functions(spark)
    row = spark.sql("select pii_top_type('a@b.com 4111111111111111') a, sensitivity_tier('OTP') b, confidence_badge(0.7) c,"
                    " needs_credentials('please sign in') d, pii_value_guard('9876543210') e").first()
    assert tuple(row) == ("CARD_NUMBER", 1, "yellow", True, "PHONE")
    registry.register_pattern("plate", "PLATE", "[A-Z]{2}-[0-9]{3}")
    rows = spark.createDataFrame([(1, "AB-123 and a@b.com")], "id int, text string")
    got = [(r.detector, r.match, r.start_idx) for r in registry.detect_all(rows, ["plate", "EMAIL"]).collect()]
    assert got == [("plate", "AB-123", 0), ("EMAIL", "a@b.com", 11)]


def test_audit_log_is_gzipped_and_grows(spark, tmp_path):
    from veilgrid.sources import audit_log

    rows = spark.createDataFrame([("s", 1, "h"), ("s", 2, None)], "session_id string, step_number int, instruction_hash string")
    for i in (1, 2):
        audit_log.append_audit(rows.where(f"step_number = {i}"), str(tmp_path / "log"))
    assert {p.name[-8:] for p in (tmp_path / "log").glob("part-*")} == {".json.gz"}
    got = audit_log.read_audit(spark, str(tmp_path / "log")).collect()
    assert {(r.session_id, r.step_number, r.instruction_hash) for r in got} == {("s", 1, "h"), ("s", 2, None)} and all(r.timestamp for r in got)
