"""SQL for session logs."""

from __future__ import annotations

from veilgrid.functions import values as V
from veilgrid.plans import derived as d
from veilgrid.plans.sql_text import ACTIONS, VAULT, _names, with_

NOW = "TIMESTAMP '2024-01-30 12:00:00'"


def log(columns: list[str]) -> str:
    return f"log AS MATERIALIZED ({d.select_sql(columns, 'events')})"


STEPS = f"""steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS rn FROM ({d.select_sql(d.STEPS, 'conversations')})),
    walk AS (SELECT *, step_number = 1 AS accepted, 1 AS expected_step, CASE WHEN step_number = 1 THEN 1 ELSE 0 END AS last FROM steps WHERE rn = 1
        UNION ALL SELECT s.*, s.step_number = w.last + 1, w.last + 1, CASE WHEN s.step_number = w.last + 1 THEN s.step_number ELSE w.last END
        FROM walk w JOIN steps s ON s.session_id = w.session_id AND s.rn = w.rn + 1)"""
EPOCHS = """gaps AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh
        FROM log WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
    epochs AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS BIGINT) AS vault_epoch FROM gaps)"""
RATE = f"""requests AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY client ORDER BY at_us, event_id) AS rn FROM ({d.REQUESTS_SQL})),
    walk AS (SELECT *, at_us AS window_start, 1 AS request_no FROM requests WHERE rn = 1
        UNION ALL SELECT r.*, CASE WHEN r.at_us - w.window_start > 60000000 THEN r.at_us ELSE w.window_start END,
            CASE WHEN r.at_us - w.window_start > 60000000 THEN 1 ELSE w.request_no + 1 END
        FROM walk w JOIN requests r ON r.client = w.client AND r.rn = w.rn + 1)"""
BINDING = """msgs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS rn FROM log),
    walk AS (SELECT *, CASE WHEN event = 'send' THEN tab_id END AS bt, CASE WHEN event = 'send' THEN frame_id END AS bf,
            CASE WHEN event = 'send' THEN 'bound' ELSE 'ignored' END AS verdict FROM msgs WHERE rn = 1
        UNION ALL SELECT m.*, CASE WHEN m.event = 'send' THEN coalesce(w.bt, m.tab_id) WHEN m.event = 'end' OR w.bt = m.tab_id THEN NULL ELSE w.bt END,
            CASE WHEN m.event = 'send' THEN coalesce(w.bf, m.frame_id) WHEN m.event = 'end' OR w.bt = m.tab_id THEN NULL ELSE w.bf END,
            CASE WHEN m.event = 'send' THEN CASE WHEN w.bt IS NULL THEN 'bound' WHEN w.bt = m.tab_id AND w.bf = m.frame_id THEN 'ok' ELSE 'rejected' END
                 WHEN w.bt IS NOT NULL AND (m.event = 'end' OR w.bt = m.tab_id) THEN 'released' ELSE 'ignored' END
        FROM walk w JOIN msgs m ON m.session_id = w.session_id AND m.rn = w.rn + 1)"""


CHAIN = f"""asked AS MATERIALIZED ({d.select_sql(d.ASKED, 'conversations')}),
    paced AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY client ORDER BY at_us, request_id) AS rn FROM asked),
    pace AS (SELECT request_id, client, rn, at_us AS opened, 1 AS no FROM paced WHERE rn = 1
        UNION ALL SELECT p.request_id, p.client, p.rn, CASE WHEN p.at_us - w.opened > 60000000 THEN p.at_us ELSE w.opened END,
            CASE WHEN p.at_us - w.opened > 60000000 THEN 1 ELSE w.no + 1 END FROM pace w JOIN paced p ON p.client = w.client AND p.rn = w.rn + 1),
    answers AS ({d.select_sql(d.ANSWERS, '(SELECT * FROM conversations, range(3) AS r(attempt))')}),
    judged AS (SELECT *, CASE WHEN error = 'rate_limited' THEN 'model_rate_limited' WHEN error IS NOT NULL THEN error
            WHEN type NOT IN ({_names(V.ACTION_TYPES)}) OR (type IN ('click', 'type') AND coalesce(target_element_id, '') = '') OR (type = 'type' AND value IS NULL)
                OR target_element_id = 'el-99' THEN 'invalid' WHEN value LIKE '4111%' THEN 'raw_value' ELSE 'ok' END AS status FROM answers),
    settled AS (SELECT request_id, min(attempt) FILTER (status = 'ok') AS ok_at, min(attempt) FILTER (status NOT IN ('ok', 'invalid')) AS end_at FROM judged GROUP BY request_id),
    chained AS MATERIALIZED (SELECT asked.*, no <= 20 AS allowed, instruction = '' AS broken, coalesce(ok_at < end_at, ok_at IS NOT NULL) AS answered, ok_at, end_at,
        row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS place FROM asked JOIN pace USING (request_id) LEFT JOIN settled USING (request_id)),
    story AS (SELECT request_id, session_id, place, 0 AS before, CASE WHEN allowed AND NOT broken AND answered AND step_number = 1 THEN 1 ELSE 0 END AS last FROM chained WHERE place = 1
        UNION ALL SELECT c.request_id, c.session_id, c.place, s.last, CASE WHEN c.allowed AND NOT c.broken AND c.answered AND c.step_number = s.last + 1 THEN c.step_number ELSE s.last END
        FROM story s JOIN chained c ON c.session_id = s.session_id AND c.place = s.place + 1),
    decided AS (SELECT c.*, last > before AS in_history, CASE WHEN NOT allowed THEN 'rate_limited' WHEN broken THEN 'invalid_payload' WHEN step_number > 1 AND before = 0 THEN 'continuity_broken'
        WHEN last > before THEN 'ok' WHEN end_at IS NOT NULL THEN e.status ELSE 'no_valid_action' END AS verdict,
        CASE WHEN last > before THEN o.type END AS type, CASE WHEN last > before THEN o.target_element_id END AS target_element_id,
        CASE WHEN last > before THEN CASE WHEN o.target_element_id IN ('el-2', 'el-0') THEN 'risky' ELSE 'safe' END END AS risk_tier
        FROM chained c JOIN story USING (request_id) LEFT JOIN judged e ON e.request_id = c.request_id AND e.attempt = end_at
        LEFT JOIN judged o ON o.request_id = c.request_id AND o.attempt = ok_at)"""


def session_queries() -> dict[str, str]:
    access = log(d.ACCESSES)
    last = f"last AS (SELECT session_id, max(ts) AS last_access FROM log WHERE ts <= {NOW} GROUP BY session_id)"
    return {
        "step_acceptance": with_(STEPS, "SELECT session_id, arrival, step_number, accepted, expected_step FROM walk"),
        "continuity_breaks": with_(STEPS, "SELECT session_id, arrival, step_number FROM walk WHERE step_number > 1 AND expected_step = 1"),
        "unchanged_frames": with_(log(d.FRAMES), """SELECT event_id, session_id, coalesce(content_hash <> ''
            AND lag(content_hash) OVER (PARTITION BY session_id ORDER BY ts, event_id) = content_hash, false) AS skipped FROM log"""),
        "session_expiry": with_(access, EPOCHS, "SELECT event_id, session_id, vault_epoch FROM epochs"),
        "expired_sessions": with_(access, last, f"SELECT *, {NOW} - last_access > INTERVAL 30 MINUTE AS expired FROM last"),
        "active_sessions": with_(access, last, f"SELECT count(*) AS n_active, count(*) >= 3 AS warn FROM last WHERE {NOW} - last_access <= INTERVAL 30 MINUTE"),
        "session_concurrency": with_(access, EPOCHS, """spans AS (SELECT session_id, vault_epoch, min(ts) AS opened, max(ts) AS last FROM epochs GROUP BY ALL),
            changes AS (SELECT session_id, vault_epoch, opened AS changed_at, 0 AS side, 1 AS change FROM spans
                UNION ALL SELECT session_id, vault_epoch, last + INTERVAL 30 MINUTE, 1, -1 FROM spans),
            total AS (SELECT *, CAST(sum(change) OVER (ORDER BY changed_at, side, session_id, vault_epoch) AS BIGINT) AS active FROM changes)""",
            "SELECT session_id, changed_at, change, active, change = 1 AND active > 8 AS over_limit FROM total"),
        "context_binding": with_(log(d.BINDINGS), BINDING, "SELECT event_id, session_id, verdict FROM walk"),
        "rate_limit": with_(RATE, "SELECT event_id, client, at_us, window_start, CAST(request_no AS BIGINT) AS request_no, request_no <= 20 AS allowed FROM walk"),
        "analyzed_requests": with_(CHAIN, """SELECT request_id, verdict, CASE verdict WHEN 'ok' THEN 200 WHEN 'rate_limited' THEN 429 WHEN 'model_rate_limited' THEN 429
            WHEN 'invalid_payload' THEN 422 WHEN 'raw_value' THEN 422 WHEN 'continuity_broken' THEN 400 ELSE 500 END AS status_code, in_history, type, target_element_id, risk_tier,
            CASE WHEN allowed AND NOT broken THEN sha256(instruction) END AS instruction_hash, CASE verdict WHEN 'continuity_broken' THEN 'Session continuity broken (fresh UUID mid-task)'
            WHEN 'model_rate_limited' THEN 'Rate limit exceeded (429)' WHEN 'api_failure' THEN 'API Failure' WHEN 'no_valid_action' THEN 'Failed to generate valid action'
            WHEN 'raw_value' THEN 'Rejected: value field matched raw CARD_NUMBER shape, not a valid token' END AS error, CASE WHEN in_history THEN '[REDACTED]' END AS logged_value,
            CASE WHEN allowed AND NOT broken THEN CASE WHEN in_history THEN 0.9::DOUBLE ELSE 0::DOUBLE END END AS confidence FROM decided"""),
        "analyzed_audit_gaps": with_(CHAIN, "SELECT 0::BIGINT AS n_gaps, count(*) AS n_events FROM decided WHERE allowed AND NOT broken"),
        "aligned_rate_limit": f"""SELECT client, make_timestamp(at_us - at_us % 60000000) AS window_start, count(*) AS n_requests,
            greatest(count(*) - 20, 0) AS n_over FROM ({d.REQUESTS_SQL}) GROUP BY ALL""",
        "server_steps": with_(log(d.ATTEMPTS), """SELECT event_id, session_id, CAST(1 + coalesce(sum(succeeded::INT)
            OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS request_step FROM log"""),
        "previous_errors": with_(log(d.ATTEMPTS), """SELECT event_id, session_id, lag(CASE WHEN NOT succeeded THEN error END) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS last_action_error FROM log"""),
        "task_limits": with_(log(d.ATTEMPTS), """per AS (SELECT session_id, step_number, count(*) FILTER (NOT succeeded) AS bad FROM log GROUP BY ALL),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step_number) AS n FROM per),
            ended AS (SELECT *, n = 20 OR bad >= 3 AS ends FROM ranked),
            task AS (SELECT session_id, coalesce(min(n) FILTER (ends), max(n)) AS n_steps, arg_min(CASE WHEN bad >= 3 THEN step_number END, n) FILTER (ends) AS f,
                arg_min(step_number, n) FILTER (ends) AS last_step, arg_min(bad, n) FILTER (ends) AS last_bad FROM ended GROUP BY session_id)""",
            """SELECT session_id, CASE WHEN last_bad >= 3 THEN last_step END AS failed_step, n_steps,
            CASE WHEN last_bad >= 3 THEN 'max_retries_exceeded' WHEN n_steps >= 20 THEN 'max_steps_exceeded' END AS outcome FROM task"""),
        "task_outcomes": with_(log(d.ENDS), "SELECT reason, count(*) AS n_sessions FROM (SELECT session_id, arg_max(reason, ts) AS reason FROM log GROUP BY session_id) GROUP BY reason"),
        "audit_completeness": with_(STEPS, """asked AS (SELECT session_id, step_number FROM steps),
            logged AS (SELECT * FROM asked WHERE (session_id + step_number) % 9 <> 0 UNION ALL SELECT * FROM asked WHERE session_id % 10 = 1)""",
            """SELECT session_id, step_number, coalesce(a.n, 0) AS n_requests, coalesce(l.n, 0) AS n_events
            FROM (SELECT session_id, step_number, count(*) AS n FROM asked GROUP BY ALL) a
            FULL JOIN (SELECT session_id, step_number, count(*) AS n FROM logged GROUP BY ALL) l USING (session_id, step_number)
            WHERE coalesce(a.n, 0) <> coalesce(l.n, 0)"""),
        "session_history": with_(STEPS, """told AS (SELECT session_id, 'Previous steps taken:' || chr(10) || string_agg('Step ' || step_number || ': Intended to ''' || instruction
            || '''. Executed action: ' || action_type || ' on ' || coalesce(target_element_id, 'None') || chr(10), '' ORDER BY step_number) AS history
            FROM walk WHERE accepted GROUP BY session_id)""",
            "SELECT session_id, coalesce(history, 'No previous steps in this session.') AS history FROM (SELECT DISTINCT session_id FROM steps) LEFT JOIN told USING (session_id)"),
        "response_pairs": with_(STEPS, """SELECT s.session_id, s.arrival, s.step_number, a.step_number AS response_step, a.n_chars, a.session_id IS NOT NULL AS paired
            FROM steps s LEFT JOIN (SELECT conv_id AS session_id, CAST(turn + 2 AS INTEGER) AS step_number, CAST(length(text) AS INTEGER) AS n_chars FROM conversations WHERE role = 'assistant') a
            ON a.session_id = s.session_id AND a.step_number = s.step_number + 1"""),
        "response_contract": with_(ACTIONS, f"""SELECT payload_id, action_seq, CASE WHEN action_seq % 31 = 0 THEN 'Invalid response'
            WHEN action_seq % 23 = 0 THEN 'Session mismatch' WHEN action_seq % 19 = 0 THEN 'Step mismatch' WHEN action_seq % 29 = 0 THEN 'Missing action'
            WHEN type NOT IN ({_names(V.ACTION_TYPES)}) THEN 'Invalid action type' WHEN coalesce(risk_tier, '') NOT IN ('safe', 'risky') THEN 'Invalid risk tier' END AS reject_reason FROM actions"""),
        "purged_vault": with_(*VAULT, """closed AS (SELECT 'cust' || (c_custkey % 40) AS session_id FROM customer WHERE c_acctbal < 0 AND 'cust' || (c_custkey % 40) LIKE 'cust2%'
            UNION SELECT 'src' || n_nationkey FROM nation WHERE 'src' || n_nationkey LIKE 'src1%')""",
            "SELECT session_id, token FROM vault WHERE session_id NOT IN (SELECT session_id FROM closed)"),
    }
