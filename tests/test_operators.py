from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from veilgrid.functions import tiers as T
from veilgrid.operators import audit as A
from veilgrid.operators import elements as E
from veilgrid.operators import fusion as J
from veilgrid.operators import policy as P
from veilgrid.operators import relink as R
from veilgrid.operators import text as X
from veilgrid.operators import validate as W
from veilgrid.operators import vault as U

RAW = "payload_id int, seq bigint, dom_id string, tag string, type string, autocomplete string, aria_label string, own_label string, inner_text string, value string"
ELEMENTS = [
    (1, 1, "card", "input", None, "cc-number", None, None, None, "4111 1111 1111 1111"),
    (1, 2, "mail", "input", "email", None, None, None, None, "user12@example.com"),
    (1, 3, "pw", "input", "password", None, None, None, None, "SuperSecret12!Pass"),
    (1, 4, "empty", "input", "password", None, None, "Password", None, ""),
    (1, 5, "div", "div", None, None, None, None, "user@example.com", None),
    (1, 6, "promo", "input", None, None, None, "Promo Code", None, "SAVE10"),
    (1, 7, "btn", "button", None, None, "Delete Account Permanently", None, "Continue", None),
]


def test_classified_elements(spark):
    rows = E.classify_elements(spark.createDataFrame(ELEMENTS, RAW))
    got = {r.element_id: r for r in rows.collect()}
    assert [(got[k].sensitivity_type, got[k].sensitivity_tier) for k in ("card", "mail", "pw", "empty", "div", "promo", "btn")] == [
        ("CARD_NUMBER", 1), ("EMAIL", 2), ("PASSWORD", 1), ("PASSWORD", 1), ("EMAIL", 2), ("UNKNOWN", 3), ("UNKNOWN", 3)]
    assert not got["empty"].has_value and got["empty"].reason == "labelled 'Password' by nearby DOM text"
    assert got["div"].reason == "matched EMAIL pattern" and got["div"].confidence == 0.6
    assert got["btn"].label_text == "Delete Account Permanently"
    assert E.deceptive_labels(spark.createDataFrame(ELEMENTS, RAW)).count() == 1


def test_memory_never_makes_a_field_sensitive(spark):
    rows = E.classify_elements(spark.createDataFrame(ELEMENTS, RAW)).withColumn("origin", F.lit("o"))
    labels = spark.createDataFrame([("o", "Promo Code"), ("o", "Password")], "origin string, label string")
    got = {r.element_id: r for r in R.origin_boost(rows, labels).collect()}
    assert not got["promo"].is_sensitive and not got["promo"].origin_confirmed
    assert got["empty"].confidence == 0.99 and got["empty"].sensitivity_tier == 1


def test_vault_is_one_to_one_and_first_type_wins(spark):
    rows = [("a", f"v{i % 700}", ("EMAIL", "PHONE")[i % 2], i) for i in range(3000)] + [("b", "v1", "NAME", 0)]
    df = spark.createDataFrame(rows, "session_id string, raw_value string, sensitivity_type string, ord int")
    for letters in (24, 2):
        vault = U.issue_vault(df, "k", ("ord",), letters).collect()
        assert len(vault) == 701 and len({(r.session_id, r.token) for r in vault}) == 701
        first = {(s, v): k for s, v, k, _ in reversed(rows)}
        assert all(first[r.session_id, r.raw_value] == r.sensitivity_type for r in vault)
    vault = U.issue_vault(df, "k", ("ord",))
    assert vault.where("raw_value = 'v1'").select("token").distinct().count() == 2
    claims = spark.createDataFrame([("a", "[PASSWORD_a1b2c3d4e5]"), ("a", "plain")], "session_id string, token string")
    assert [r.token for r in U.forged_tokens(claims, vault).collect()] == ["[PASSWORD_a1b2c3d4e5]"]


def test_ten_thousand_tokens_do_not_meet(spark):
    df = spark.range(10_000).selectExpr("'s' as session_id", "concat('v', id) as raw_value", "'NAME' as sensitivity_type")
    row = U.token_uniqueness(U.issue_vault(df, "k")).first()
    assert (row.n_issued, row.n_distinct, row.is_unique) == (10_000, 10_000, True)


@pytest.mark.parametrize(("text", "bucket"), [
    ("9.99", "[AMOUNT: $<10]"), ("10", "[AMOUNT: $10-50]"), ("50", "[AMOUNT: $10-50]"), ("50.5", "[AMOUNT: $50-100]"),
    ("pay 100", "[AMOUNT: $50-100]"), ("500", "[AMOUNT: $100-500]"), ("1000", "[AMOUNT: $500-1000]"),
    ("1000.01", "[AMOUNT: $1000+]"), ("none", "[AMOUNT]"), ("2,499.00", "[AMOUNT: $<10]"),
])
def test_amount_bucket(spark, text, bucket):
    row = spark.createDataFrame([(text,)], "t string").selectExpr(f"{T.amount_number_sql('t')} as n").selectExpr(
        f"{T.amount_bucket_sql('n')} as b").first()
    assert row.b == bucket


def test_thousands_mark_can_be_read(spark):
    row = spark.createDataFrame([("₹2,499.00",)], "t string").selectExpr(f"{T.amount_number_sql('t', True)} as n").first()
    assert row.n == 2499.0


def test_confidence_gate(spark):
    rows = spark.createDataFrame([
        (1, "OTP", "[OTP_a]", 0.7), (1, "OTP", None, 0.7), (2, "NAME", "[NAME_a]", 0.5), (2, "NAME", None, 0.5),
        (2, "NAME", "[NAME_a]", 0.6), (3, "UNKNOWN", None, 0.1)], "t int, k string, tok string, c double")
    got = [tuple(r) for r in rows.selectExpr(T.gate_action_sql("t", "c") + " as a", T.gate_token_sql("t", "k", "tok", "c") + " as g").collect()]
    assert got == [
        ("hard_redact", "[OTP_a?]"), ("hard_redact", None), ("soft_redact_flagged", "[NAME_a: uncertain]"),
        ("soft_redact_flagged", "[NAME: uncertain]"), ("hard_redact", "[NAME_a]"), ("no_redact", None)]


def test_action_risk_and_targets(spark):
    page = spark.createDataFrame([
        (1, 1, "del", "Delete Account Permanently", False), (1, 2, "go", "Continue", False),
        (1, 3, "view", "View order history", False), (1, 4, "pw", "Password", True)],
        "payload_id int, seq int, element_id string, label_text string, is_sensitive boolean")
    acts = spark.createDataFrame([
        (1, "click", "del", "safe", "calm"), (1, "click", "go", "safe", "will delete it"), (1, "click", "view", "safe", "look"),
        (1, "type", "pw", "safe", "fill"), (1, "click", "ghost", "safe", "x"), (1, "task_complete", None, "risky", "done"),
        (1, "scroll", "view", None, "x")],
        "payload_id int, type string, target_element_id string, risk_tier string, reasoning_short string")
    got = {(r.type, r.target_element_id): r.policy_risk
           for r in P.policy_risk(P.attach_targets(acts, page, ("label_text", "is_sensitive"))).collect()}
    assert [got[k] for k in (("click", "del"), ("click", "go"), ("click", "view"), ("type", "pw"), ("click", "ghost"),
                             ("task_complete", None), ("scroll", "view"))] == [
        "risky", "risky", "safe", "risky", "safe", "safe", "risky"]
    assert [r.target_element_id for r in P.hallucinated_targets(acts, page).collect()] == ["ghost"]


def test_contracts(spark):
    acts = spark.createDataFrame([
        ("click", None, None, "safe", "r"), ("type", "a", None, "safe", "r"), ("type", "a", "x", "1", "r"), ("wait", None, None, "safe", "r")],
        "type string, target_element_id string, value string, risk_tier string, reasoning_short string")
    good, bad = W.split_checked(W.check_actions(acts))
    assert good.count() == 1 and bad.count() == 3
    from veilgrid.sources.payloads import PAYLOAD_SCHEMA
    element = {"element_id": "e", "tag": "a", "role": "link", "is_sensitive": False, "has_value": False,
               "bounding_box": {"x": 1, "y": 1, "w": 1, "h": 1}}
    base = {"session_id": "s", "task_instruction": "go", "step_number": 1, "dom_summary": {"url": "u", "elements": [element]}}
    many = {**base, "dom_summary": {"url": "u", "elements": [element] * 501}}
    leaky = {**base, "dom_summary": {"url": "u", "elements": [{**element, "is_sensitive": True, "has_value": True}]}}
    empty = {**base, "dom_summary": {"url": "u", "elements": [{**element, "is_sensitive": True}]}}
    rows = spark.createDataFrame([
        base, many, leaky, empty, {**base, "last_action_error": "e" * 1001}, {**base, "task_instruction": ""},
        {**base, "detection_confidence_notes": [{"element_id": "e", "confidence": 1.5, "method": "vision_model"}]},
        {**base, "redacted_image_base64": "i" * 8_000_001}], PAYLOAD_SCHEMA)
    assert [r.reject_reasons for r in W.check_payloads(rows).collect()] == [
        [], ["too_many_elements"], ["sensitive_without_token"], [], ["last_action_error_length"],
        ["task_instruction_length"], ["confidence_range"], ["image_too_large"]]


def test_response_contract(spark):
    rows = spark.createDataFrame([
        (True, "s", "s", 1, 2, True, "click", "safe"), (True, "x", "s", 1, 2, True, "click", "safe"),
        (True, "s", "s", 1, 3, True, "click", "safe"), (True, "s", "s", 1, 2, False, None, None),
        (True, "s", "s", 1, 2, True, "fly", "safe"), (True, "s", "s", 1, 2, True, "click", "1"), (False, None, "s", 1, None, None, None, None)],
        "has_response boolean, session_id string, expected_session string, expected_step int, step_number int, has_action boolean, type string, risk_tier string")
    assert [r.reject_reason for r in W.check_responses(rows).collect()] == [
        None, "Session mismatch", "Step mismatch", "Missing action", "Invalid action type", "Invalid risk tier", "Invalid response"]


BOX = "payload_id int, seq bigint, box struct<x:int,y:int,w:int,h:int>"


def greedy(dom, vision):
    """The merge one box at a time."""
    def iou(a, b):
        w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
        h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        union = a[2] * a[3] + b[2] * b[3] - w * h
        return w * h / union if union > 0 else 0

    merged = [("dom", s, b) for s, b in sorted(dom)]
    out = {}
    for s, b in sorted(vision):
        hit = next(((k, n) for k, n, m in merged if iou(m, b) > 0.3), (None, None))
        out[s] = hit
        if hit[0] is None:
            merged.append(("vision", s, b))
    return out


@pytest.mark.parametrize("block", [4096, 40])
def test_channel_merge_equals_the_greedy_one(spark, block):
    rng = random.Random(7)

    def boxes(n, first):
        return [(first + i, (rng.randrange(0, 400, 9), rng.randrange(0, 400, 9), rng.choice([0, 30, 60, 300]), rng.choice([25, 40, 280])))
                for i in range(n)]

    pages = {p: (boxes(rng.randint(0, 12), 0), boxes(rng.randint(1, 60), 0)) for p in range(12)}
    pages[12] = (boxes(40, 0), boxes(1500, 0))
    pages[13] = ([(1, (0, 0, 100_000, 100_000))], [(1, (5, 5, 99_990, 99_000)), (2, (0, 0, 30, 30)), (3, (-7, -7, 30, 30))])
    dom = spark.createDataFrame([(p, s, b) for p, (d, _) in pages.items() for s, b in d], BOX)
    vision = spark.createDataFrame([(p, s, b) for p, (_, v) in pages.items() for s, b in v], BOX)
    got = {(r.payload_id, r.seq): (r.match_source, r.match_seq) for r in J.match_regions(dom, vision, block).collect()}
    want = {(p, s): hit for p, (d, v) in pages.items() for s, hit in greedy(d, v).items()}
    assert got == want


def test_a_chain_of_boxes_takes_few_jobs(spark):
    chain = [(1, i, (10 * i, 0, 25, 20)) for i in range(500)]
    status, before = spark.sparkContext.statusTracker(), "box-chain"
    spark.sparkContext.setJobGroup(before, "a chain of boxes")
    try:
        rows = J.match_regions(spark.createDataFrame([], BOX), spark.createDataFrame(chain, BOX)).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {r.seq: r.match_seq for r in rows}
    assert got == dict(greedy_hits(chain)) and len(got) == 500
    assert len(status.getJobIdsForGroup(before)) <= 24  # a query stage of an adaptive plan is a job of its own


def greedy_hits(chain):
    return {s: (hit and hit[1]) for s, hit in greedy([], [(s, b) for _, s, b in chain]).items()}


def test_boxes_of_one_seq_are_matched_by_themselves(spark):
    vision = spark.createDataFrame([(1, 5, (0, 0, 20, 20)), (1, 5, (900, 900, 20, 20)), (1, 6, (0, 0, 20, 20))], BOX)
    rows = J.match_regions(spark.createDataFrame([], BOX), vision).collect()
    assert sorted((r.seq, r.box.x, r.match_source, r.match_seq) for r in rows) == [(5, 0, None, None), (5, 900, None, None), (6, 0, "vision", 5)]


def test_page_regions_name_no_vision_channel(spark):
    elements = spark.createDataFrame([(1, 2**62 + 5, 10, 10, 100, 20, "EMAIL", 2, "el", "ocr_regex", 0.9, "r")],
                                     "payload_id int, seq bigint, x int, y int, w int, h int, sensitivity_type string, sensitivity_tier int,"
                                     " element_id string, method string, confidence double, reason string")
    lines = spark.createDataFrame([(1, 2**62 + 7, (500, 500, 90, 20), 0.1, "4111 1111 1111 1111")], BOX + ", confidence double, text string")
    fused = J.fused_regions(elements, lines.drop("text"), lines)
    assert {(r.source, r.detection_source) for r in fused.collect()} == {("dom", None), ("vision", "vision_model")}
    rolled = A.region_rollup(fused).first()
    assert (rolled.dom_heuristic, rolled.vision_model, rolled.ocr_regex) == (1, 1, 0)


def test_roll_ups_by_type_and_risk(spark):
    regions = spark.createDataFrame(
        [(1, None, "EMAIL", 1), (1, "ocr_regex", "EMAIL", 1), (1, None, "EMAIL", 1), (1, None, "NAME", 2), (None, "vision_model", None, None)],
        "payload_id int, detection_source string, sensitivity_type string, sensitivity_tier int")
    assert {tuple(r) for r in A.region_types(regions).collect()} == {
        (1, "dom_heuristic", "EMAIL", 1, 2), (1, "ocr_regex", "EMAIL", 1, 1), (1, "dom_heuristic", "NAME", 2, 1), (None, "vision_model", None, None, 1)}
    actions = spark.createDataFrame(
        [(1, "click", "risky"), (1, "click", "safe"), (1, "click", None), (1, "type", "Risky"), (2, None, "risky")], "payload_id int, type string, risk_tier string")
    assert {tuple(r) for r in A.risk_rollup(actions).collect()} == {(1, "click", 1, 2), (1, "type", 0, 1), (2, None, 1, 0)}
    assert A.region_types(regions.limit(0)).isEmpty() and A.risk_rollup(actions.limit(0)).isEmpty()


def test_audit_looks_into_maps_and_variants(spark):
    rows = spark.createDataFrame([(1,)], "payload_id int").selectExpr(
        "payload_id", "map('k', '4111111111111111') as extra", "array(map('m', named_struct('deep', 'a@b.com'))) as listed",
        """parse_json('{"a":{"note":"9876543210","n":1},"l":[1,"x\\\\"y:",{"password":"p"}],"e":""}') as line""", "cast(null as variant) as none")
    got = {(r.path, r.value) for r in A.string_leaves(rows, ["payload_id"]).collect()}
    assert got == {("extra.k", "4111111111111111"), ("listed[0].m.deep", "a@b.com"), ("line.a.note", "9876543210"), ("line.l[1]", 'x"y:'),
                   ("line.l[2].password", "p"), ("line.e", "")}


def test_variants_have_exact_paths(spark):
    deep = "[" * 60 + '"end"' + "]" * 60
    cases = {
        '{"password":{"x":"hunter2"}}': {("v.password.x", "hunter2")},
        '{"password":["[A_b]","hunter2",{"y":[["z"]]}]}': {("v.password[0]", "[A_b]"), ("v.password[1]", "hunter2"), ("v.password[2].y[0][0]", "z")},
        '{"a.secret":{"b":"1"},"[":"]","{":"}{"}': {("v.a.secret.b", "1"), ("v.[", "]"), ("v.{", "}{")},
        '"only"': {("v", "only")}, "7": set(), "null": set(), "{}": set(), '[[],{},"x",null,true,1.5]': {("v[2]", "x")},
        r'{"a":"q\"}{[","b":"\u0041\\"}': {("v.a", 'q"}{['), ("v.b", "A\\")}, deep: {("v" + "[0]" * 60, "end")},
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "payload_id int, text string").selectExpr("payload_id", "parse_json(text) as v")
    got = {i: set() for i in range(len(cases))}
    for r in A.string_leaves(rows, ["payload_id"]).collect():
        got[r.payload_id].add((r.path, r.value))
    assert list(got.values()) == list(cases.values())


def test_nothing_below_a_sensitive_key_is_sent(spark):
    texts = ['{"password":{"x":"hunter2"}}', '{"password":["[A_b]","hunter2"]}', '{"login":[{"pwd":{"now":"s3"}}]}', '{"my.secret":"s"}', '{"password":{"x":"","n":1}}',
             '{"note":"fine"}']
    rows = spark.createDataFrame([*enumerate(texts), (None, '{"note":"no id"}')], "payload_id int, text string").selectExpr("payload_id", "parse_json(text) as v")
    found = A.leaf_violations(A.string_leaves(rows, ["payload_id"]), spark.createDataFrame([], "token string"))
    clean, held = A.send_gate(rows, found)
    assert {r.payload_id for r in clean.collect()} == {4, 5} and {r.payload_id for r in held.collect()} == {0, 1, 2, 3, None}


def test_leaks_are_found_whatever_white_space_surrounds_them(spark):
    leaves = spark.createDataFrame([(1, "label", "say hunter2 now")], "payload_id int, path string, value string")
    secrets = spark.createDataFrame([(1, "hunter2\n\t")], "payload_id int, raw_value string")
    assert [r.raw_value for r in A.raw_value_leaks(leaves, secrets).collect()] == ["hunter2"]


def test_tokens_of_ambiguous_sessions_differ(spark):
    rows = spark.createDataFrame([("a", "b|c", "NAME"), ("a|b", "c", "NAME")], "session_id string, raw_value string, sensitivity_type string")
    assert U.issue_vault(rows, "k").select("token").distinct().count() == 2


def test_tokens_of_a_value_of_two_types_are_one(spark):
    """The vault names the first type, a redacted text the type of its span."""
    seen = spark.createDataFrame([("s", "a@b.com", "NAME", 1), ("s", "a@b.com", "EMAIL", 2), ("s", "other", "NAME", 3)],
                                 "session_id string, raw_value string, sensitivity_type string, n int")
    vault = U.issue_vault(seen, "k", ("n",))
    text = X.redact_text(spark.createDataFrame([(1, "s", "write to a@b.com")], "doc_id int, session_id string, text string"), "k").first().redacted_text
    token = text.split()[-1]
    assert token.startswith("[EMAIL_") and vault.where(F.col("token") == token).count() == 0
    rows = spark.createDataFrame([("s", token), ("t", token), ("s", token.replace("EMAIL_", "EMAIL_x"))], "session_id string, token string")
    assert {(r.session_id, r.raw_value, r.status) for r in U.resolve_tokens(rows, vault).collect()} == {
        ("s", "a@b.com", "ok"), ("t", None, "unresolvable_token"), ("s", None, "unresolvable_token")}
    assert U.has_token(rows, vault).collect() == [rows.first()]
    assert [r.token for r in U.forged_tokens(rows, vault).collect()] == [token.replace("EMAIL_", "EMAIL_x")]
    short = U.issue_vault(seen, "k", ("n",), letters=4)
    assert U.resolve_tokens(short.select("session_id", "token"), short).where("status = 'ok'").count() == 2


def test_vision_cases(spark):
    faces = spark.createDataFrame([(1, 1, (300, 50, 80, 80), 0.05)], BOX + ", confidence double")
    lines = spark.createDataFrame([
        (1, 2, (0, 200, 90, 20), 0.1, "Card on file: 4111 1111 1111 1111"), (1, 3, (0, 300, 90, 20), 0.9, "Welcome back!")],
        BOX + ", confidence double, text string")
    found = {r.element_id: r for r in J.vision_regions(faces, lines).collect()}
    assert set(found) == {"vision-face-1", "vision-ocr-2"}
    assert found["vision-ocr-2"].reason == "matched CARD_NUMBER pattern in on-screen text (OCR)"
    dom = spark.createDataFrame([(1, 1, (10, 10, 100, 20))], BOX)
    near = spark.createDataFrame([(1, 1, (12, 11, 95, 20)), (1, 2, (500, 500, 50, 50))], BOX)
    merged = J.merge_channels(dom, near).collect()
    assert sorted((r.source, r.vision_confirmed) for r in merged) == [("dom", True), ("vision", False)]


def test_channel_consistency_modes(spark):
    page = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", False)], "payload_id int, element_id string, is_sensitive boolean")
    painted = spark.createDataFrame([(1, "a", None), (1, "vision-face-1", "vision_model"), (1, "c", None)],
                                    "payload_id int, element_id string, detection_source string")
    assert {r.element_id for r in J.channel_mismatches(page, painted).collect()} == {"b", "c", "vision-face-1"}
    assert {r.element_id for r in J.channel_mismatches(page, painted, True).collect()} == {"b", "c"}


def test_leaf_walk_and_leaks(spark):
    rows = spark.createDataFrame([(1, {"b": [{"c": "x4111111111111111", "n": 1}, {"c": None, "n": 2}]}, ["p", None], "[EMAIL_a] secret")],
                                 "payload_id int, a struct<b:array<struct<c:string,n:int>>>, tags array<string>, note string")
    leaves = A.string_leaves(rows, ["payload_id"])
    assert sorted((r.path, r.value) for r in leaves.collect()) == [
        ("a.b[0].c", "x4111111111111111"), ("note", "[EMAIL_a] secret"), ("tags[0]", "p")]
    secret = spark.createDataFrame([(1, "4111111111111111"), (1, "p"), (1, "secret"), (2, "4111111111111111")], "payload_id int, raw_value string")
    for block in (200, 1):
        assert [(r.path, r.raw_value) for r in A.raw_value_leaks(leaves, secret, block).collect()] == [("a.b[0].c", "4111111111111111")]


def test_issued_token_under_a_sensitive_key(spark):
    vault = spark.createDataFrame([("s", "[OTP_abcdef]")], "session_id string, token string")
    leaves = spark.createDataFrame([(1, "otp", "[OTP_abcdef]"), (1, "otp", "[OTP_abcdef?]"), (1, "pwd", "[OTP_forged]"), (1, "pwd", ""), (1, "note", "ok")],
                                   "payload_id int, path string, value string")
    assert [r.path for r in A.leaf_violations(leaves, vault).collect()] == ["pwd"]
    assert A.leaf_violations(leaves, vault, strict_reference=True).count() == 3


def test_relink_cases(spark):
    columns = "payload_id int, element_id string, tag string, label string"
    before = spark.createDataFrame([(1, "a", "button", "Pay"), (2, "a", "button", "Pay"), (3, "a", "button", "Pay"),
                                    (4, "a", "button", "Pay"), (5, "a", "button", "Pay"), (6, "a", "button", "")], columns)
    after = spark.createDataFrame([
        (1, "a", "button", "Pay"), (2, "b", "button", " pay "), (3, "a", "input", "Other"), (3, "n", "button", "Pay"),
        (4, "x", "button", "Pay"), (4, "y", "button", "Pay"), (6, "z", "button", "")], columns).withColumn("seq", F.monotonically_increasing_id())
    got = {r.payload_id: (r.resolved_id, r.reindexed) for r in R.relink(before, after).collect()}
    assert got == {1: ("a", False), 2: ("b", True), 3: ("n", True), 4: (None, False), 5: (None, False), 6: (None, False)}


def test_audit_record_masks_and_hashes(spark):
    rows = spark.createDataFrame([("s", 1, None, ("type", None), 0.9, "n")],
                                 "session_id string, step_number int, instruction string, action struct<type:string,value:string>, confidence double, payload_notes string")
    row = A.audit_records(rows).first()
    assert row.action.value == "[REDACTED]"
    assert row.instruction_hash == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_purge(spark):
    vault = spark.createDataFrame([("a", "t"), ("b", "u")], "session_id string, token string")
    assert [r.token for r in U.purge_vault(vault, spark.createDataFrame([("a",), ("a",)], "session_id string")).collect()] == ["u"]
