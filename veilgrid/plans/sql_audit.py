"""SQL for channels, payload audits, snapshots and origins."""

from __future__ import annotations

from veilgrid.functions import values as V
from veilgrid.plans import derived as d
from veilgrid.plans.sql_elements import ACT, EL, ELEMENTS, RAW, TOKENIZED, trim
from veilgrid.plans.sql_text import (
    ACTIONS, ISSUED_SHAPE, STRICT_SHAPE, TEXT_KEPT, TEXT_SPANS, TEXTS, spans, tier, with_,
)

REGIONS = f"regions AS ({d.select_sql(d.REGIONS, 'lineitem', d.REGIONS_WHERE)})"
VISION = f"vision AS MATERIALIZED ({d.select_sql(d.VISION_BOXES, 'lineitem')})"
DOM_BOXES = "doms AS MATERIALIZED (SELECT payload_id, seq, x, y, w, h FROM raw)"


def iou(a: str, b: str) -> str:
    inter = (
        f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))::DOUBLE"
        f" * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"
    )
    union = f"({a}.w::DOUBLE * {a}.h + {b}.w::DOUBLE * {b}.h - {inter})"
    return f"(CASE WHEN {union} <= 0 THEN 0 ELSE {inter} / {union} END)"


def mismatches(more: str = "") -> str:
    return f"""wanted AS (SELECT DISTINCT payload_id, element_id FROM el WHERE is_sensitive),
    painted AS (SELECT DISTINCT payload_id, element_id FROM regions {more}),
    mismatches AS (SELECT payload_id, element_id, '{V.ISSUE_NOT_REDACTED}' AS issue FROM (SELECT * FROM wanted EXCEPT SELECT * FROM painted)
        UNION ALL SELECT payload_id, element_id, '{V.ISSUE_NOT_SENSITIVE}' FROM (SELECT * FROM painted EXCEPT SELECT * FROM wanted))"""


DOM_ONLY = "WHERE detection_source = 'dom_heuristic'"


def matching(dom: str = "doms", seen: str = "vision") -> str:
    """CTEs dom_hit and walk (added or absorbed vision boxes, in order, with the list of added ones)."""
    return f"""dom_hit AS MATERIALIZED (SELECT v.payload_id, v.seq, min(d.seq) AS dom_seq FROM {seen} v JOIN {dom} d ON d.payload_id = v.payload_id AND {iou('d', 'v')} > 0.3 GROUP BY ALL),
    loose AS MATERIALIZED (SELECT payload_id, seq, {{'seq': seq, 'x': x, 'y': y, 'w': w, 'h': h}} AS box, row_number() OVER (PARTITION BY payload_id ORDER BY seq) AS rn
        FROM {seen} v ANTI JOIN dom_hit USING (payload_id, seq)),
    walk AS (SELECT payload_id, seq, rn, CAST(NULL AS BIGINT) AS vision_seq, [box] AS added FROM loose WHERE rn = 1
        UNION ALL SELECT l.payload_id, l.seq, l.rn, list_filter(w.added, lambda k: {iou('k', 'l.box')} > 0.3)[1].seq,
            CASE WHEN len(list_filter(w.added, lambda k: {iou('k', 'l.box')} > 0.3)) = 0 THEN list_append(w.added, l.box) ELSE w.added END
        FROM walk w JOIN loose l ON l.payload_id = w.payload_id AND l.rn = w.rn + 1)"""


UNION = """confirmed AS (SELECT DISTINCT payload_id, 'dom' AS source, dom_seq AS seq FROM dom_hit
        UNION SELECT DISTINCT payload_id, 'vision', vision_seq FROM walk WHERE vision_seq IS NOT NULL)"""
FUSED = f"""doms AS MATERIALIZED (SELECT *, CAST(NULL AS VARCHAR) AS detection_source FROM el WHERE sensitivity_tier IN (1, 2)),
    lines AS MATERIALIZED (SELECT * FROM vision WHERE text IS NOT NULL),
    {spans('lines', 'payload_id, seq', prefix='line_')},
    line_best AS (SELECT payload_id, seq, arg_min(type, (tier, ord, start_idx)) AS kind FROM line_spans GROUP BY ALL),
    seen AS MATERIALIZED (SELECT payload_id, seq, x, y, w, h, confidence, 'FACE' AS sensitivity_type, 1 AS sensitivity_tier, 'vision-face-' || seq AS element_id,
            'vision_model' AS detection_source, '{V.REASON_FACE}' AS reason FROM vision WHERE text IS NULL
        UNION ALL SELECT payload_id, seq + 4611686018427387904, x, y, w, h, confidence, kind, {tier('kind')}, 'vision-ocr-' || seq, 'ocr_regex',
            'matched ' || kind || ' pattern in on-screen text (OCR)' FROM lines JOIN line_best USING (payload_id, seq))"""
FUSED_ROWS = """everything AS (
        SELECT payload_id, 'dom' AS source, seq, element_id, sensitivity_type, sensitivity_tier, detection_source, reason, confidence, x, y, w, h FROM doms
        UNION ALL SELECT payload_id, 'vision', seq, element_id, sensitivity_type, sensitivity_tier, detection_source, reason, confidence, x, y, w, h
        FROM seen SEMI JOIN (SELECT payload_id, seq FROM walk WHERE vision_seq IS NULL) USING (payload_id, seq)),
    fused_rows AS (SELECT e.*, c.seq IS NOT NULL AS vision_confirmed FROM everything e LEFT JOIN confirmed c USING (payload_id, source, seq))"""
FUSION = (*EL, VISION, FUSED, matching("doms", "seen"), UNION, FUSED_ROWS)

# Payload documents, taken apart.
PAYLOADS = """pel AS MATERIALIZED (SELECT payload_id, seq, element_id, tag, role, CASE WHEN payload_id % 6 = 1 AND is_sensitive THEN concat_ws(' ', label_text, raw_value) ELSE label_text END AS label_text,
        is_sensitive, CASE WHEN payload_id % 17 = 3 THEN 4 ELSE sensitivity_tier END AS sensitivity_tier,
        CASE WHEN payload_id % 17 = 4 THEN 'SSN' ELSE sensitivity_type END AS sensitivity_type, semantic_token AS own_token,
        CASE WHEN payload_id % 17 = 5 THEN NULL ELSE semantic_token END AS semantic_token, method,
        row_number() OVER (PARTITION BY payload_id ORDER BY seq) - 1 AS i FROM tok JOIN orders ON o_orderkey = payload_id),
    preg AS MATERIALIZED (SELECT payload_id, seq, element_id, semantic_token, row_number() OVER (PARTITION BY payload_id ORDER BY seq) - 1 AS i,
        payload_id % 17 = 6 OR (payload_id % 9 = 4 AND seq % 3 = 0) OR payload_id % 9 = 5 AS bad_box
        FROM pel WHERE is_sensitive AND (payload_id % 5 <> 2 OR seq % 2 = 0)),
    pay AS MATERIALIZED (SELECT o_orderkey AS payload_id, o_orderkey % 17 AS k, * FROM orders SEMI JOIN pel ON pel.payload_id = o_orderkey),
    leaves AS MATERIALIZED (SELECT payload_id, path, value FROM (
        SELECT payload_id, 'session_id' AS path, CASE WHEN k = 8 THEN NULL ELSE 'cust' || o_custkey END AS value FROM pay
        UNION ALL SELECT payload_id, 'task_instruction', CASE WHEN k = 9 THEN '' WHEN k = 10 THEN repeat(o_orderpriority, 400) ELSE o_orderpriority END FROM pay
        UNION ALL SELECT payload_id, 'last_action_error', CASE WHEN k = 11 THEN repeat('e', 1001) END FROM pay
        UNION ALL SELECT payload_id, 'redacted_image_base64', repeat('i', CASE WHEN k = 12 THEN 90 ELSE 120 END) FROM pay
        UNION ALL SELECT payload_id, 'dom_summary.url', CASE WHEN k <> 13 THEN 'https://shop.example.com' END FROM pay
        UNION ALL SELECT payload_id, 'extra.otp_hint', CASE payload_id % 4 WHEN 0 THEN (CASE WHEN k <> 5 THEN own_token END) WHEN 1 THEN '[PASSWORD_a83f]' WHEN 2 THEN '' END
            FROM pay JOIN pel USING (payload_id) WHERE i = 0
        UNION ALL SELECT payload_id, 'dom_summary.elements[' || i || '].' || name, value FROM (
            SELECT payload_id, i, unnest(['element_id', 'tag', 'role', 'label_text', 'sensitivity_type', 'semantic_token']) AS name,
                unnest([element_id, tag, role, label_text, sensitivity_type, semantic_token]) AS value FROM pel)
        UNION ALL SELECT payload_id, 'detection_confidence_notes[' || i || '].' || name, value FROM (
            SELECT payload_id, i, unnest(['element_id', 'method']) AS name, unnest([element_id, CASE WHEN payload_id % 17 = 14 THEN 'guess' ELSE method END]) AS value FROM pel)
        UNION ALL SELECT payload_id, 'redacted_regions[' || i || '].' || name, value FROM (
            SELECT payload_id, i, unnest(['element_id', 'semantic_token']) AS name, unnest([element_id, semantic_token]) AS value FROM preg)
        ) WHERE value IS NOT NULL),
    coverage AS (SELECT payload_id, n_required, coalesce(n, 0) AS n_regions, n_required > 0 AND coalesce(n, 0) < n_required AS redaction_missing
        FROM (SELECT payload_id, CAST(count(*) FILTER (is_sensitive AND sensitivity_tier IN (1, 2)) AS INTEGER) AS n_required FROM pel GROUP BY payload_id)
        LEFT JOIN (SELECT payload_id, CAST(count(*) AS INTEGER) AS n FROM preg GROUP BY payload_id) USING (payload_id))"""
PAY = (*EL, TOKENIZED, PAYLOADS)


def violations(shape: str, plain: str) -> str:
    keys = "|".join(V.SENSITIVE_KEY_WORDS)
    return rf"""live AS MATERIALIZED (SELECT * FROM leaves WHERE path <> 'redacted_image_base64' AND NOT (regexp_matches(value, '{shape}')
            AND {plain} IN (SELECT token FROM el_vault))),
    {spans('live', 'payload_id, path', 'value', 'leaf_')},
    violations AS MATERIALIZED (
        SELECT payload_id, path, 'raw PII value found outside semantic token' AS reason, type AS matched_type FROM leaf_spans
        UNION ALL SELECT payload_id, path, 'unredacted password or secret string found in sensitive field', 'PASSWORD' FROM live WHERE value <> '' AND regexp_matches(lower(path), '{keys}')
        UNION ALL SELECT payload_id, 'redacted_image_base64', 'redacted_image_base64 is suspiciously short or malformed', 'IMAGE_DATA_WARNING' FROM pay WHERE k = 12
        UNION ALL SELECT payload_id, 'redacted_regions', 'redacted_regions count does not cover all tier 1/2 sensitive elements', 'REDACTION_MISSING' FROM coverage WHERE redaction_missing
        UNION ALL SELECT payload_id, 'redacted_regions[' || i || ']', 'Invalid bounding_box in redacted_regions', 'INVALID_BOUNDING_BOX' FROM preg WHERE bad_box)"""


LOOSE = violations(ISSUED_SHAPE, r"regexp_replace(value, '\?\]$|: uncertain\]$', ']')")
STRICT = violations(STRICT_SHAPE, "value")
CONFIRMED = """conf AS MATERIALIZED (SELECT DISTINCT 'https://shop' || (a.payload_id % 25) || '.example.com' AS origin, el.label_text AS label
        FROM actions a JOIN el ON el.payload_id = a.payload_id AND el.element_id = a.target_element_id
        WHERE a.risk_tier = 'risky' AND a.payload_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND el.is_sensitive AND coalesce(el.label_text, '') <> '')"""


def audit_queries() -> dict[str, str]:
    half = f"{VISION}, {DOM_BOXES}, {matching()}"
    return {
        "box_iou": with_(RAW, VISION, f"SELECT d.payload_id, d.seq, {iou('d', 'v')}::DOUBLE AS iou FROM raw d JOIN vision v ON d.payload_id = v.payload_id AND d.seq = v.seq"),
        "channel_mismatches": with_(*EL, REGIONS, mismatches(), "SELECT * FROM mismatches"),
        "channel_verdicts": with_(*EL, REGIONS, mismatches(DOM_ONLY), """SELECT o_orderkey AS payload_id, coalesce(n, 0) AS n_mismatches, n IS NULL AS consistent
            FROM orders LEFT JOIN (SELECT payload_id, count(*) AS n FROM mismatches GROUP BY ALL) m ON m.payload_id = o_orderkey"""),
        "channel_differences": with_(*EL, REGIONS, mismatches(DOM_ONLY), "SELECT issue, count(*) AS n_ids FROM mismatches GROUP BY issue"),
        "region_matches": with_(RAW, half, "SELECT payload_id, seq, dom_seq FROM dom_hit"),
        "vision_collapse": with_(RAW, half, "SELECT payload_id, seq, vision_seq IS NULL AS added, vision_seq FROM walk"),
        "channel_union": with_(RAW, half, UNION, """merged AS (SELECT payload_id, 'dom' AS source, seq, x, y, w, h FROM doms
            UNION ALL SELECT payload_id, 'vision', seq, x, y, w, h FROM vision SEMI JOIN (SELECT payload_id, seq FROM walk WHERE vision_seq IS NULL) USING (payload_id, seq))""",
            "SELECT m.*, c.seq IS NOT NULL AS vision_confirmed FROM merged m LEFT JOIN confirmed c USING (payload_id, source, seq)"),
        "fused_regions": with_(*FUSION, """SELECT payload_id, element_id, sensitivity_type, sensitivity_tier, detection_source, reason, confidence, vision_confirmed FROM fused_rows"""),
        "redaction_rects": with_(*FUSION, """sized AS (SELECT *, CASE WHEN w <= 80 AND h <= 24 THEN 80 WHEN w <= 160 AND h <= 24 THEN 160 ELSE 260 END AS pw FROM fused_rows),
            rects AS (SELECT *, (CASE WHEN source = 'dom' THEN x + w / 2 - pw / 2 ELSE x - 4 END)::DOUBLE AS draw_x,
                (CASE WHEN source = 'dom' THEN y + h / 2 - 12 ELSE y - 4 END)::DOUBLE AS draw_y, (CASE WHEN source = 'dom' THEN pw ELSE w + 8 END)::DOUBLE AS draw_w,
                (CASE WHEN source = 'dom' THEN 24 ELSE h + 8 END)::DOUBLE AS draw_h FROM sized)""",
            """SELECT payload_id, element_id, draw_x, draw_y, draw_w, draw_h,
            draw_x <= x AND draw_y <= y AND draw_x + draw_w >= x + w AND draw_y + draw_h >= y + h AS fully_covers FROM rects"""),
        "string_leaves": with_(*PAY, "SELECT * FROM leaves"),
        "redaction_coverage": with_(*PAY, "SELECT * FROM coverage"),
        "audit_violations": with_(*PAY, LOOSE, "SELECT * FROM violations"),
        "audit_violations_strict": with_(*PAY, STRICT, "SELECT matched_type, count(*) AS n_violations FROM violations GROUP BY ALL"),
        "audit_verdicts": with_(*PAY, LOOSE, """SELECT o_orderkey AS payload_id, coalesce(n, 0) AS n_violations, n IS NULL AS passed
            FROM orders LEFT JOIN (SELECT payload_id, count(*) AS n FROM violations GROUP BY ALL) v ON v.payload_id = o_orderkey"""),
        "send_gate": with_(*PAY, LOOSE, REGIONS, mismatches(DOM_ONLY), """SELECT payload_id, CASE WHEN payload_id IN (SELECT payload_id FROM violations)
            OR payload_id IN (SELECT payload_id FROM mismatches) THEN 'hold' ELSE 'send' END AS gate FROM pay"""),
        "raw_value_leaks": with_(*PAY, f"""secrets AS (SELECT DISTINCT payload_id, {trim('v')} AS raw_value FROM (
                SELECT payload_id, raw_value AS v FROM el WHERE sensitivity_tier IN (1, 2) AND raw_value IS NOT NULL
                UNION ALL SELECT payload_id, match FROM spans JOIN el USING (payload_id, seq) WHERE el.sensitivity_tier IN (1, 2)) WHERE length({trim('v')}) >= 3)""",
            """SELECT l.payload_id, path, raw_value FROM leaves l JOIN secrets s ON s.payload_id = l.payload_id AND contains(l.value, s.raw_value)
            WHERE path <> 'redacted_image_base64' AND NOT starts_with(value, '[')"""),
        "audit_records": with_(ACTIONS, """SELECT 's' || payload_id AS session_id, CAST(action_seq % 20 AS INTEGER) AS step_number, sha256(coalesce(reasoning_short, '')) AS instruction_hash,
            type, target_element_id, '[REDACTED]' AS value, risk_tier, 0.9::DOUBLE AS confidence FROM actions"""),
        "region_rollup": with_(*FUSION, """SELECT payload_id, count(*) FILTER (detection_source IS NULL) AS dom_heuristic,
            count(*) FILTER (detection_source = 'vision_model') AS vision_model, count(*) FILTER (detection_source = 'ocr_regex') AS ocr_regex FROM fused_rows GROUP BY payload_id"""),
        "region_types": with_(*FUSION, """SELECT payload_id, coalesce(detection_source, 'dom_heuristic') AS detection_source, sensitivity_type, sensitivity_tier, count(*) AS n
            FROM fused_rows GROUP BY ALL"""),
        "risk_rollup": with_(ACTIONS, """SELECT payload_id, type, count(*) FILTER (risk_tier IS NOT DISTINCT FROM 'risky') AS risky, count(*) FILTER (risk_tier IS DISTINCT FROM 'risky') AS safe
            FROM actions GROUP BY ALL"""),
        "latency_rollup": """SELECT event_type AS name, count(*) AS n, max(value) AS max_ms, quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.95) AS p95_ms FROM events GROUP BY event_type""",
        "newest_steps": "SELECT event_id, user_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
        "ordered_spans": with_(TEXTS, TEXT_SPANS, TEXT_KEPT, """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_idx DESC) - 1 AS INTEGER) AS pos,
            type, start_idx, end_idx FROM kept"""),
        "relinked_elements": with_(RAW, ELEMENTS, f"""before AS (SELECT payload_id, element_id, seq, tag, label_text AS label FROM dom),
            after AS MATERIALIZED (SELECT payload_id, seq, CASE seq % 5 WHEN 0 THEN 'new-' || element_id ELSE element_id END AS element_id, CASE WHEN seq % 7 = 0 THEN 'span' ELSE tag END AS tag,
                coalesce(lower({trim("CASE WHEN seq % 7 < 2 THEN label || ' 2' ELSE upper(label) END")}), '') AS label FROM before WHERE seq % 13 <> 0),
            direct AS (SELECT payload_id, element_id, arg_min(tag, seq) AS tag, arg_min(label, seq) AS label FROM after GROUP BY ALL),
            single AS (SELECT payload_id, tag, label, min(element_id) AS other FROM after WHERE label <> '' GROUP BY ALL HAVING count(*) = 1)""",
            f"""SELECT b.payload_id, b.element_id, CASE WHEN coalesce(a.tag = b.tag OR a.label = coalesce(lower({trim('b.label')}), ''), false) THEN b.element_id ELSE other END AS resolved_id,
            NOT coalesce(a.tag = b.tag OR a.label = coalesce(lower({trim('b.label')}), ''), false) AND other IS NOT NULL AS reindexed
            FROM before b LEFT JOIN direct a ON a.payload_id = b.payload_id AND a.element_id = b.element_id
            LEFT JOIN single s ON s.payload_id = b.payload_id AND s.tag = b.tag AND s.label = coalesce(lower({trim('b.label')}), '')"""),
        "confirmed_labels": with_(*ACT[:-1], CONFIRMED, "SELECT origin, label FROM conf"),
        "origin_profiles": with_(*ACT[:-1], CONFIRMED, "SELECT origin, string_agg(label, '|' ORDER BY label) AS labels FROM conf GROUP BY origin"),
        "origin_boost": with_(*ACT[:-1], CONFIRMED, """SELECT payload_id, seq, CASE WHEN is_sensitive AND label IS NOT NULL THEN least(confidence + 0.15::DOUBLE, 0.99::DOUBLE) ELSE confidence END AS confidence,
            is_sensitive AND label IS NOT NULL AS origin_confirmed, sensitivity_tier
            FROM el LEFT JOIN conf ON origin = 'https://shop' || (payload_id % 25) || '.example.com' AND label = label_text"""),
    }
