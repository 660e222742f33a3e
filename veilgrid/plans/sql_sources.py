"""SQL for sources, streams and SQL functions."""

from __future__ import annotations

from veilgrid.plans import derived as d
from veilgrid.plans.sql_audit import FUSION, PAY
from veilgrid.plans.sql_sessions import EPOCHS, RATE, STEPS, log
from veilgrid.plans.sql_text import ACTIONS, TEXT_SPANS, TEXTS, kept, spans, tier, token, with_

_WHO = "CAST(page_id AS VARCHAR)"


def source_queries() -> dict[str, str]:
    redacted = f"""pieces AS (SELECT doc_id, rn, end_idx, substr(text, prev_end + 1, start_idx - prev_end) || {token('source', 'match', 'type')} AS piece
            FROM kept JOIN documents USING (doc_id, source)),
        joined AS (SELECT doc_id, string_agg(piece, '' ORDER BY rn) AS head, max(end_idx) AS last, count(*) AS n FROM pieces GROUP BY doc_id)"""
    round_up = "CAST(greatest(floor(coalesce({}, 0) + 0.5), 0) AS INTEGER)"
    box = ", ".join(f"{round_up.format(e)} AS {n}" for e, n in (("x0", "x"), ("y0", "y"), ("x1 - x0", "w"), ("y1 - y0", "h")))
    return {
        "payload_elements": with_(*PAY, """SELECT payload_id, CAST(i AS INTEGER) AS pos, element_id, pel.tag, pel.role, pel.is_sensitive, pel.semantic_token, tok.has_value,
            CASE WHEN payload_id % 17 <> 6 THEN x END AS x, CASE WHEN payload_id % 17 <> 6 THEN h END AS h FROM pel JOIN tok USING (payload_id, seq, element_id)"""),
        "payload_regions": with_(*PAY, "SELECT payload_id, CAST(i AS INTEGER) AS pos, element_id, semantic_token FROM preg"),
        "audit_log": with_(ACTIONS, """SELECT CAST(action_seq % 20 AS INTEGER) AS step_number, type, '[REDACTED]' AS value, count(*) AS n_events,
            count(DISTINCT coalesce(reasoning_short, '')) AS n_instructions FROM actions GROUP BY ALL"""),
        "audit_step_metrics": """SELECT * FROM (SELECT 's' || user_id AS session_id, unnest(['total', 'vision-total']) AS name, count(*) AS n, unnest([max(value), max(value / 2)]) AS max_ms
            FROM events GROUP BY user_id) JOIN (SELECT 's' || user_id AS session_id, count(*) FILTER (event_id % 3 = 0) AS n_dom FROM events GROUP BY user_id) USING (session_id)""",
        "ocr_lines": f"""WITH flat AS (SELECT l_orderkey AS payload_id, CAST(l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS BIGINT) AS seq, * FROM lineitem),
            lines AS (SELECT payload_id, seq, 0 AS pos, 'Card ' || l_suppkey AS text, l_quantity - 10.5 AS x0, l_discount * 100 AS y0, l_quantity + 40.4 AS x1, l_discount * 100 + 12 AS y1, (l_suppkey % 100)::DOUBLE / 100 AS confidence FROM flat
            UNION ALL SELECT payload_id, seq, 1, 'Total due', 1, 2, 0.2, 9.5, 0.5 FROM flat WHERE l_partkey % 3 <> 0
            UNION ALL SELECT payload_id, seq, 2, 'Welcome', l_quantity, l_quantity, l_quantity * 2, l_quantity + 0.5, 0.5 FROM flat WHERE l_partkey % 5 <> 0)
            SELECT payload_id, seq, pos, text, {box}, confidence::DOUBLE AS confidence FROM lines""",
        "face_rows": f"""SELECT payload_id, seq, {round_up.format('origin_x')} AS x, {round_up.format('origin_y')} AS y, CAST(floor(width + 0.5) AS INTEGER) AS w,
            CAST(floor(height + 0.5) AS INTEGER) AS h, coalesce(score, 0)::DOUBLE AS confidence FROM ({d.select_sql(d.FACES, 'lineitem')}) WHERE floor(width + 0.5) > 0 AND floor(height + 0.5) > 0""",
        "html_elements": f"""SELECT page_id AS payload_id, 0::BIGINT AS seq, 'em' || page_id AS element_id, 'input' AS tag, 'Email address' AS label_text, 'user' || page_id || '@example.com' AS raw_value, 'EMAIL' AS sensitivity_type FROM pages WHERE page_id % 4 = 0
            UNION ALL SELECT page_id, 1, 'pw' || page_id, 'input', 'Password', NULL, 'PASSWORD' FROM pages WHERE page_id % 4 = 0
            UNION ALL SELECT page_id, 0, 'cc' || page_id, 'input', 'Card number', '4111 1111 1111 1111', 'CARD_NUMBER' FROM pages WHERE page_id % 4 = 1
            UNION ALL SELECT page_id, 1, 'b' || page_id, 'button', 'Delete Account Permanently', 'Continue', 'UNKNOWN' FROM pages WHERE page_id % 4 = 1
            UNION ALL SELECT page_id, 0, 't' || page_id, 'textarea', 'Mobile', '9' || lpad({_WHO}, 9, '0'), 'PHONE' FROM pages WHERE page_id % 4 = 2
            UNION ALL SELECT page_id, 1, 's' || page_id, 'select', 'Total price', '7', 'AMOUNT' FROM pages WHERE page_id % 4 = 2""",
        "page_failures": rf"""WITH noted AS ({d.select_sql(d.NOTICE_PAGES, 'pages')}),
            seen AS (SELECT page_id, html, lower(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')) AS visible FROM noted),
            judged AS (SELECT page_id, CASE WHEN regexp_matches(visible, 'invalid username|invalid password|login failed|incorrect password|error|try again|access denied') THEN 'Visible error text detected on page'
                WHEN regexp_matches(html, '(?i)role\s*=\s*["'']alert["'']|aria-invalid\s*=\s*["'']true["'']|class\s*=\s*["''](?:[^"'']*\s)?(?:error|alert-danger)(?:\s[^"'']*)?["'']') THEN 'Element with error role/class detected' END AS failure_reason FROM seen)
            SELECT page_id, failure_reason IS NULL AS verified, failure_reason FROM judged""",
        "normalised_responses": """SELECT c_custkey, CASE k WHEN 0 THEN 'click' WHEN 1 THEN 'type' WHEN 2 THEN 'scroll' WHEN 3 THEN 'wait' WHEN 4 THEN 'task_complete' WHEN 5 THEN 'task_failed' WHEN 10 THEN 'wait' END AS type,
            CASE WHEN k IN (0, 1, 2) THEN 'el-' || c_custkey END AS target_element_id, CASE k WHEN 1 THEN 'hello' WHEN 3 THEN CAST(c_custkey AS VARCHAR) END AS value,
            CASE k WHEN 0 THEN 'safe' WHEN 1 THEN 'risky' END AS risk_tier, CASE k WHEN 0 THEN 'go' END AS reasoning_short,
            CASE k WHEN 9 THEN 'empty_response' WHEN 8 THEN 'invalid_json' WHEN 6 THEN 'not_an_object' WHEN 7 THEN 'not_an_object' END AS reject_reason
            FROM (SELECT c_custkey, c_custkey % 11 AS k FROM customer)""",
        "unknown_field_leaks": """SELECT path, matched_type, count(*) AS n_found FROM (
            SELECT unnest([
                CASE WHEN k % 7 = 3 THEN {'path': 'line', 'matched_type': 'invalid_json'} END,
                CASE WHEN k % 7 <> 3 AND k % 5 = 1 THEN {'path': 'line.memo', 'matched_type': 'CARD_NUMBER'} END,
                CASE WHEN k % 7 <> 3 AND k % 3 = 1 THEN {'path': 'line.extra.list[1].mail', 'matched_type': 'EMAIL'} END,
                CASE WHEN k % 7 <> 3 AND k % 4 = 1 THEN {'path': 'line.extra.password', 'matched_type': 'PASSWORD'} END,
                CASE WHEN k % 7 <> 3 AND k % 6 = 1 THEN {'path': 'line.redacted_regions[0].note', 'matched_type': 'PHONE'} END,
                CASE WHEN k % 7 <> 3 AND k % 8 = 1 THEN {'path': 'line.login.password.x.y', 'matched_type': 'PASSWORD'} END,
                CASE WHEN k % 7 <> 3 AND k % 8 = 1 THEN {'path': 'line.login.pwd[0]', 'matched_type': 'PASSWORD'} END,
                CASE WHEN k % 7 <> 3 AND k % 8 = 1 THEN {'path': 'line.login.pwd[1][1]', 'matched_type': 'PASSWORD'} END,
                CASE WHEN k % 7 <> 3 AND k % 8 = 1 THEN {'path': 'line.login.kept.secret', 'matched_type': 'PASSWORD'} END], recursive := true)
            FROM (SELECT o_orderkey AS k FROM orders)) WHERE path IS NOT NULL GROUP BY ALL""",
        "unknown_field_gate": """SELECT CASE WHEN o_orderkey % 7 = 3 THEN -1 ELSE o_orderkey END AS payload_id, CASE WHEN o_orderkey % 7 = 3 OR o_orderkey % 5 = 1 OR o_orderkey % 3 = 1
            OR o_orderkey % 4 = 1 OR o_orderkey % 6 = 1 OR o_orderkey % 8 = 1 THEN 'hold' ELSE 'send' END AS gate FROM orders""",
        "streamed_redaction": with_(spans("documents", "doc_id, source"), kept("doc_id, source"), redacted, """SELECT doc_id, sha256(coalesce(head || substr(text, last + 1), text)) AS redacted_sha,
            CAST(coalesce(n, 0) AS INTEGER) AS n_redacted, 'clean' AS outcome FROM documents LEFT JOIN joined USING (doc_id)"""),
        "streamed_rate_limit": with_(RATE, "SELECT event_id, client, at_us, window_start, CAST(request_no AS BIGINT) AS request_no, request_no <= 20 AS allowed FROM walk"),
        "streamed_steps": with_(STEPS, "SELECT session_id, arrival, step_number, accepted, expected_step FROM walk"),
        "streamed_frames": with_(log(d.FRAMES), """SELECT event_id, session_id, coalesce(content_hash <> ''
            AND lag(content_hash) OVER (PARTITION BY session_id ORDER BY ts, event_id) = content_hash, false) AS skipped FROM log"""),
        "streamed_sessions": with_(f"""stamped AS (SELECT *, epoch_us(ts) AS us, min(epoch_us(ts)) OVER () AS low, max(epoch_us(ts)) OVER () AS high FROM ({d.select_sql(d.ACCESSES, "events")})),
            parted AS (SELECT *, least(2, (us - low) // ((high - low) // 3 + 1) + CASE WHEN {d.DELAYED} THEN 1 ELSE 0 END) AS part FROM stamped),
            marks AS (SELECT part, max(max(us) // 1000 - 600000) OVER (ORDER BY part) * 1000 AS upto FROM parted GROUP BY part),
            behind AS (SELECT parted.*, coalesce(us < upto, false) AS late FROM parted LEFT JOIN marks ON marks.part = parted.part - 1),
            log AS (SELECT * FROM behind WHERE NOT late)""", EPOCHS,
            """lives AS (SELECT session_id, min(ts) AS opened, max(ts) AS last_access, count(*) AS n_accesses, 'closed' AS outcome FROM epochs GROUP BY session_id, vault_epoch)""",
            """SELECT * FROM lives WHERE epoch_us(last_access) + 1800000000 < (SELECT max(upto) FROM marks)
            UNION ALL SELECT session_id, ts, ts, 1, 'late' FROM behind WHERE late"""),
        "streamed_audit": "SELECT 's' || user_id AS session_id, CAST(event_id AS INTEGER) AS step_number, sha256(event_type) AS instruction_hash, '[REDACTED]' AS value FROM events",
        "named_detectors": with_(TEXTS, TEXT_SPANS, r"""extra AS (SELECT unnest(regexp_extract_all(text, '[A-Z]{4}0[0-9]{6}')) FROM texts)""",
            """SELECT type AS detector, type, count(*) AS n_spans FROM spans WHERE type IN ('EMAIL', 'IFSC') GROUP BY type
            UNION ALL SELECT 'order_no', 'ORDER_NO', count(*) FROM extra"""),
        "sql_functions": with_(TEXTS, TEXT_SPANS, f"SELECT session_id, type, {tier('type')} AS tier, count(*) AS n_spans FROM spans GROUP BY ALL"),
        "tier_2_switch": with_(*FUSION, "SELECT sensitivity_tier, count(*) AS n_painted FROM fused_rows WHERE sensitivity_tier = 1 GROUP BY ALL"),
    }
