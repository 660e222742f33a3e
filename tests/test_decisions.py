"""The decision chain against a plain run of it, request by request."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from veilgrid.operators import decisions as DC
from veilgrid.operators import sessions as S

ASKED = "request_id int, session_id string, arrival bigint, step_number int, instruction string, allowed boolean, reject_reason string"
ANSWERS = "request_id int, attempt int, type string, target_element_id string, value string, risk_tier string, reasoning_short string, error string"
PAGE = [("pay", "Pay now", False, 0), ("pw", "Password", True, 1), ("list", "Orders", False, 2)]
GOOD = {"click pay": ("click", "pay", None), "type pw": ("type", "pw", "[NAME_ab]"), "click list": ("click", "list", None), "wait": ("wait", None, None)}
BAD = {"no such target": ("click", "gone", None), "no target": ("click", "", None), "no value": ("type", "list", None), "no type": ("tap", None, None)}
RAW = {"raw": ("type", "list", "mail a@b.com")}


def chain(requests, answers):
    """request_id: verdict, in_history, returned action."""
    history, out = {}, {}
    for i, session, _, step, _, allowed, reason in sorted(requests, key=lambda r: r[2]):
        last = history.get(session, 0)
        verdict, action = ("rate_limited", None) if not allowed else ("invalid_payload", None) if reason else (None, None)
        if not verdict and step > 1 and not last:
            verdict = "continuity_broken"
        for kind, error in answers[i][:3]:
            if verdict:
                break
            if error:
                verdict = "model_rate_limited" if error == "rate_limited" else "api_failure"
            elif kind in RAW:
                verdict = "raw_value"
            elif kind in GOOD and step == last + 1:
                verdict, action, history[session] = "ok", GOOD[kind], step
        out[i] = (verdict or "no_valid_action", verdict == "ok", action)
    return out


def frames(spark, requests, answers):
    rows = [(i, k, *(GOOD | BAD | RAW | {None: (None, None, None)})[kind], "safe", "next", error) for i, tries in answers.items() for k, (kind, error) in enumerate(tries)]
    pages = [(r[0], *p) for r in requests for p in PAGE]
    return (spark.createDataFrame(requests, ASKED).repartition(3), spark.createDataFrame(rows, ANSWERS).repartition(3),
            spark.createDataFrame(pages, "request_id int, element_id string, label_text string, is_sensitive boolean, seq int"))


def test_verdicts_follow_the_chain(spark):
    rng, requests, answers = random.Random(4), [], {}
    step = {}
    for i in range(400):
        session = "hot" if rng.random() < 0.5 else f"s{rng.randint(0, 8)}"
        step[session] = step.get(session, 0) + 1 if rng.random() < 0.6 else rng.randint(1, 4)
        requests.append((i, session, i, step[session], "go", rng.random() < 0.95, None if rng.random() < 0.95 else "session_id_missing"))
        answers[i] = [(None, rng.choice(["rate_limited", "api_failure"])) if rng.random() < 0.06 else (rng.choice([*GOOD, *GOOD, *GOOD, *BAD, *RAW]), None) for _ in range(rng.randint(0, 5))]
    want = chain(requests, answers)
    assert {v for v, _, _ in want.values()} >= {"ok", "continuity_broken", "raw_value", "no_valid_action", "rate_limited", "invalid_payload", "api_failure", "model_rate_limited"}
    analyzed = DC.analyzed_requests(*frames(spark, requests, answers), block=30)
    got = {r.request_id: r for r in analyzed.collect()}
    assert {i: (r.verdict, r.in_history, r.action and (r.action.type, r.action.target_element_id, r.action.value)) for i, r in got.items()} == want
    assert all(r.action.risk_tier == ("risky" if r.action.target_element_id in ("pay", "pw") else "safe") for r in got.values() if r.action)
    handled = [i for i, (v, _, _) in want.items() if v not in ("rate_limited", "invalid_payload")]
    events = DC.audit_events(analyzed)
    assert sorted(r.request_id for r in events.select("request_id").collect()) == sorted(handled)
    assert {r.value for r in events.where("action.error is null").select("action.value").distinct().collect()} == {"[REDACTED]"}
    asked = analyzed.where("audit is not null").selectExpr("request_id as session_id", "step_number")
    assert S.audit_gaps(asked, events.selectExpr("request_id as session_id", "step_number")).count() == 0
    assert S.audit_gaps(asked, events.where("request_id % 2 = 0").selectExpr("request_id as session_id", "step_number")).count() > 0


def test_a_refused_step_does_not_enter_the_history(spark):
    requests = [(i, "s", i, step, "go", True, None) for i, step in enumerate((1, 2, 2, 3, 3))]
    answers = {0: [("wait", None)], 1: [("raw", None), ("wait", None)], 2: [("no target", None)] * 3 + [("wait", None)], 3: [("wait", None)], 4: [("wait", None), ("raw", None)]}
    rows = DC.analyzed_requests(*frames(spark, requests, answers)).orderBy("request_id").collect()
    assert [(r.verdict, r.status_code, r.in_history) for r in rows] == [
        ("ok", 200, True), ("raw_value", 422, False), ("no_valid_action", 500, False), ("no_valid_action", 500, False), ("raw_value", 422, False)]
    assert rows[1].audit.action.error == "Rejected: value field matched raw EMAIL shape, not a valid token"
    assert rows[0].audit.instruction_hash == spark.range(1).select(F.sha2(F.lit("go"), 256)).first()[0]


def test_no_requests(spark):
    requests, answers, pages = frames(spark, [(0, "s", 0, 1, "go", True, None)], {0: [("wait", None)]})
    assert DC.analyzed_requests(requests.limit(0), answers, pages).count() == 0
    assert DC.analyzed_requests(requests, answers.limit(0), pages.limit(0)).first().verdict == "no_valid_action"
