"""SQL for element, tier, action and contract queries."""

from __future__ import annotations

from veilgrid.functions import classify as C
from veilgrid.functions import values as V
from veilgrid.plans import derived as d
from veilgrid.plans.sql_text import ACTIONS, GUARD, _names, spans, tier, token, with_

WS = C.WHITESPACE


def trim(x: str) -> str:
    return f"trim({x}, '{WS}')"


def full(x: str) -> str:
    return f"nullif({trim(x)}, '')"


RAW = f"raw AS MATERIALIZED ({d.select_sql(d.RAW_ELEMENTS, 'lineitem')})"
ROLE = """coalesce(role, CASE WHEN lower(tag) = 'button' OR coalesce(lower(type), '') IN ('submit', 'button') THEN 'button'
    WHEN lower(tag) IN ('input', 'textarea') THEN 'textbox' WHEN lower(tag) = 'select' THEN 'combobox' WHEN lower(tag) = 'a' THEN 'link' ELSE 'generic' END)"""
LABEL = "coalesce({})".format(", ".join(
    full(c) for c in ("own_label", "for_label", "parent_label", "aria_label", "placeholder", "sibling_text")))
ELEMENT_ID = f"""CASE WHEN {full('dom_id')} IS NOT NULL THEN dom_id WHEN ext_id IS NOT NULL THEN ext_id
    ELSE 'ext-el-' || substr(sha256(payload_id || '|' || seq), 1, 16) END"""
ELEMENTS = rf"""dom1 AS (SELECT *, {ELEMENT_ID} AS element_id, {LABEL} AS nearby,
        lower(tag) = 'button' OR coalesce(lower(type), '') IN ('submit', 'button') OR coalesce(role, '') = 'button' AS is_button,
        CASE WHEN {full('value')} IS NOT NULL THEN value ELSE {full('inner_text')} END AS raw_value,
        coalesce({trim('inner_text')}, '') AS el_text FROM raw),
    dom2 AS (SELECT *, CASE WHEN is_button THEN NULL WHEN lower(type) = 'password' THEN 'PASSWORD'
        WHEN contains(lower(autocomplete), 'cc-number') THEN 'CARD_NUMBER'
        WHEN contains(lower(autocomplete), 'email') OR lower(type) = 'email' THEN 'EMAIL'
        WHEN regexp_matches(coalesce(nearby, ''), '(?i)amount|price|total') OR regexp_matches(coalesce(placeholder, ''), '(?i)amount|price|total')
            OR regexp_matches(el_text, '(?i)amount|price|total|\$[0-9]') THEN 'AMOUNT'
        WHEN contains(lower(autocomplete), 'tel') OR lower(type) = 'tel' OR regexp_matches(coalesce(nearby, ''), '(?i)phone|mobile|contact number')
            OR regexp_matches(coalesce(placeholder, ''), '(?i)phone|mobile|contact number') THEN 'PHONE'
        WHEN contains(lower(autocomplete), 'name') OR regexp_matches(coalesce(nearby, ''), '(?i)name') THEN 'NAME'
        ELSE 'UNKNOWN' END AS dom_type FROM dom1),
    dom AS MATERIALIZED (SELECT * EXCLUDE (tag, role, nearby), CASE WHEN is_button THEN 'button' ELSE lower(tag) END AS tag,
        CASE WHEN is_button THEN 'button' ELSE {ROLE} END AS role,
        CASE WHEN is_button THEN coalesce({full('aria_label')}, nullif(inner_text, ''))
             WHEN dom_type = 'AMOUNT' THEN coalesce(nearby, nullif(el_text, '')) ELSE nearby END AS label_text,
        {full('raw_value')} IS NOT NULL AS has_value FROM dom2)"""
EL_SPANS = spans("dom", "payload_id, seq", "coalesce(raw_value, '')")
CLASSIFIED = f"""best AS (SELECT payload_id, seq, arg_min(type, (tier, ord, start_idx)) AS pii_type, count(*) AS n_spans FROM spans GROUP BY payload_id, seq),
    joined0 AS (SELECT dom.*, pii_type, coalesce(n_spans, 0) AS n_spans,
        CASE WHEN coalesce(dom_type, 'UNKNOWN') <> 'UNKNOWN' THEN dom_type END AS known FROM dom LEFT JOIN best USING (payload_id, seq)),
    fused AS (SELECT *, CASE WHEN known IS NULL THEN coalesce(pii_type, 'UNKNOWN') WHEN pii_type IS NULL OR known = pii_type THEN known
            WHEN {tier('known')} < {tier('pii_type')} THEN known ELSE pii_type END AS sensitivity_type,
        CASE WHEN known IS NULL THEN CASE WHEN pii_type IS NOT NULL THEN 'pii' END WHEN pii_type IS NULL OR known = pii_type THEN 'dom'
            WHEN {tier('known')} < {tier('pii_type')} THEN 'dom' ELSE 'pii' END AS source FROM joined0),
    el AS MATERIALIZED (SELECT *, coalesce(known <> pii_type, false) AS type_mismatch, {tier('sensitivity_type')} AS sensitivity_tier,
        {tier('sensitivity_type')} <> 3 AS is_sensitive, 'pay' || (payload_id % 40) AS session_id,
        CASE WHEN coalesce(dom_type, '') = 'UNKNOWN' AND n_spans > 0 THEN 0.6::DOUBLE ELSE 0.92::DOUBLE END AS confidence,
        CASE WHEN coalesce(dom_type, '') = 'UNKNOWN' AND n_spans > 0 THEN 'ocr_regex' ELSE 'dom_heuristic' END AS method,
        CASE WHEN source = 'dom' AND coalesce(label_text, '') <> '' THEN 'labelled ''' || label_text || ''' by nearby DOM text'
             WHEN source = 'dom' THEN 'matched a DOM attribute for ' || sensitivity_type
             WHEN source = 'pii' THEN 'matched ' || sensitivity_type || ' pattern' END AS reason FROM fused)"""
EL = (RAW, ELEMENTS, EL_SPANS, CLASSIFIED)
TOKENIZED = f"""el_vault AS (SELECT session_id, raw_value, {token('session_id', 'raw_value', 'kind')} AS token FROM (
        SELECT session_id, raw_value, arg_min(sensitivity_type, (payload_id, seq)) AS kind FROM el
        WHERE sensitivity_tier IN (1, 2) AND has_value GROUP BY session_id, raw_value)),
    tok AS MATERIALIZED (SELECT el.*, CASE WHEN sensitivity_tier IN (1, 2) AND coalesce(raw_value, '') <> '' THEN token END AS semantic_token
        FROM el LEFT JOIN el_vault USING (session_id, raw_value))"""
TARGETED = """page AS (SELECT payload_id, element_id AS target_element_id, arg_min(struct_pack(label_text := label_text, is_sensitive := is_sensitive,
        input_type := lower(type), inner_text := inner_text, interactable := (w > 0 AND h > 0 AND x < 760)), seq) AS e FROM el GROUP BY payload_id, element_id),
    targeted AS (SELECT a.*, 'pay' || (payload_id % 40) AS session_id, e.label_text AS label_text, e.is_sensitive AS is_sensitive, e.input_type AS input_type,
        e.inner_text AS inner_text, e.interactable AS interactable, e IS NOT NULL AS found
        FROM actions a LEFT JOIN page USING (payload_id, target_element_id))"""
ACT = (ACTIONS, *EL, TARGETED)
_WORDS = "|".join(V.DANGEROUS_KEYWORDS)
_TARGETS = "|".join(V.SENSITIVE_TARGET_WORDS)


def element_queries() -> dict[str, str]:
    return {
        "element_labels": with_(RAW, "firsts AS (SELECT payload_id, dom_id, arg_min(for_label, seq) AS first_label FROM raw WHERE for_label IS NOT NULL AND dom_id <> '' GROUP BY ALL)",
            f"SELECT payload_id, seq, {LABEL.replace('for_label', 'first_label')} AS nearby_label FROM raw LEFT JOIN firsts USING (payload_id, dom_id)"),
        "element_roles": with_(RAW, f"SELECT payload_id, seq, {ROLE} AS role FROM raw"),
        "button_labels": with_(RAW, ELEMENTS, "SELECT payload_id, seq, tag, role, label_text, dom_type FROM dom WHERE is_button"),
        "element_dom_types": with_(RAW, ELEMENTS, "SELECT payload_id, seq, tag, role, label_text, dom_type FROM dom"),
        "element_ids": with_(RAW, f"SELECT payload_id, seq, {ELEMENT_ID} AS element_id FROM raw"),
        "element_values": with_(RAW, ELEMENTS, "SELECT payload_id, seq, raw_value, has_value FROM dom"),
        "deceptive_labels": with_(RAW, f"""SELECT payload_id, seq, inner_text, aria_label FROM raw WHERE {trim('aria_label')} <> {trim('inner_text')}
            AND {trim('inner_text')} <> '' AND regexp_matches(lower(aria_label), '{_WORDS}')"""),
        "element_tiers": with_(*EL, "SELECT sensitivity_type, sensitivity_tier, count(*) AS n_elements FROM el GROUP BY ALL"),
        "type_fusion": with_(*EL, "SELECT payload_id, seq, dom_type, pii_type, sensitivity_type, source, type_mismatch FROM el"),
        "element_reasons": with_(*EL, "SELECT payload_id, seq, reason FROM el WHERE reason IS NOT NULL"),
        "amount_buckets": with_(*EL, """first_match AS (SELECT payload_id, seq, arg_min(match, (ord, start_idx)) AS m FROM spans WHERE regexp_matches(match, '[0-9]') GROUP BY payload_id, seq),
            am AS (SELECT payload_id, seq, coalesce(m, concat_ws(' ', nullif(label_text, ''), nullif(raw_value, ''))) AS amount_text
                FROM el LEFT JOIN first_match USING (payload_id, seq) WHERE sensitivity_type = 'AMOUNT' AND coalesce(raw_value, '') <> ''),
            num AS (SELECT payload_id, seq, try_cast(nullif(regexp_extract(amount_text, '[0-9]+(?:\\.[0-9]+)?', 0), '') AS DOUBLE) AS number FROM am)""",
            """SELECT payload_id, seq, number, CASE WHEN number IS NULL THEN '[AMOUNT]' WHEN number < 10 THEN '[AMOUNT: $<10]' WHEN number <= 50 THEN '[AMOUNT: $10-50]'
            WHEN number <= 100 THEN '[AMOUNT: $50-100]' WHEN number <= 500 THEN '[AMOUNT: $100-500]' WHEN number <= 1000 THEN '[AMOUNT: $500-1000]' ELSE '[AMOUNT: $1000+]' END AS amount_token FROM num"""),
        "token_decisions": with_(*EL, TOKENIZED, "SELECT payload_id, seq, sensitivity_type, semantic_token FROM tok"),
        "base_confidence": with_(*EL, "SELECT payload_id, seq, confidence, method FROM el"),
        "confidence_gate": with_(*EL, TOKENIZED, r"""SELECT payload_id, seq, sensitivity_tier,
            CASE WHEN sensitivity_tier = 1 OR (sensitivity_tier = 2 AND c >= 0.6) THEN 'hard_redact' WHEN sensitivity_tier = 2 THEN 'soft_redact_flagged' ELSE 'no_redact' END AS action,
            CASE WHEN sensitivity_tier = 1 AND c < 0.75 THEN left(semantic_token, -1) || '?]'
                 WHEN sensitivity_tier = 2 AND c < 0.6 THEN coalesce(left(semantic_token, -1) || ': uncertain]', '[' || sensitivity_type || ': uncertain]')
                 ELSE semantic_token END AS gated_token FROM (SELECT *, (seq % 101)::DOUBLE / 100 AS c FROM tok)"""),
        "confidence_badges": f"""SELECT CASE WHEN confidence >= 0.85 THEN 'green' WHEN confidence >= 0.6 THEN 'yellow' ELSE 'red' END AS badge, count(*) AS n_boxes
            FROM ({d.select_sql(d.VISION_BOXES, 'lineitem')}) GROUP BY ALL""",
        "client_risk": with_(ACTIONS, rf"""SELECT payload_id, action_seq, CASE WHEN risk_tier IN ('safe', 'risky') THEN risk_tier
            WHEN regexp_matches(risk_tier, '^-?[0-9]+$') THEN CASE WHEN risk_tier IN ('1', '2') THEN 'risky' ELSE 'safe' END
            WHEN sensitivity_tier IN (1, 2) THEN 'risky' WHEN regexp_matches(lower(target_element_id), '{_TARGETS}') THEN 'risky'
            WHEN regexp_matches(value, '\[(CARD_NUMBER|PASSWORD|AADHAAR|OTP|EMAIL|PHONE|NAME|AMOUNT|IFSC)(?:_\d+)?(?:\?|: [^\]]+)?\]') THEN 'risky' ELSE 'safe' END AS client_risk FROM actions"""),
        "action_targets": with_(*ACT, "SELECT payload_id, action_seq, target_element_id, label_text, is_sensitive, found FROM targeted"),
        "policy_risk": with_(*ACT, f"""SELECT payload_id, action_seq, CASE WHEN coalesce(is_sensitive, false) THEN 'risky'
            WHEN type = 'click' AND regexp_matches(lower(concat(label_text, ' ', reasoning_short)), '{_WORDS}') THEN 'risky'
            WHEN type IN ('task_complete', 'task_failed') THEN 'safe' WHEN risk_tier IN ('safe', 'risky') THEN risk_tier ELSE 'risky' END AS policy_risk FROM targeted"""),
        "needs_confirmation": with_(*ACT, """SELECT payload_id, action_seq, coalesce(risk_tier = 'risky', false) OR (type = 'click' AND coalesce(target_element_id, '') <> ''
            AND (NOT found OR coalesce(input_type, '') = 'submit' OR regexp_matches(lower(coalesce(inner_text, '')), 'pay|submit|delete|confirm'))) AS needs_confirmation FROM targeted"""),
        "executability": with_(*ACT, "known AS (SELECT DISTINCT session_id, value FROM targeted WHERE value = '[EMAIL_7]' AND payload_id % 3 = 0)",
            """SELECT payload_id, action_seq, CASE WHEN type IN ('task_complete', 'task_failed', 'wait') THEN 'ok'
            WHEN NOT found AND type IN ('click', 'type', 'scroll') THEN 'target_element_not_found' WHEN found AND NOT interactable THEN 'element_not_interactable'
            WHEN type = 'type' AND value LIKE '[%' AND value LIKE '%]' AND k.session_id IS NULL THEN 'unresolvable_token'
            WHEN type IN ('click', 'type', 'scroll', 'ask_user_confirmation') THEN 'ok' ELSE 'unknown_action_type' END AS status
            FROM targeted t LEFT JOIN known k USING (session_id, value)"""),
        "hallucinated_targets": with_(*ACT, """SELECT payload_id, action_seq, target_element_id FROM actions a WHERE coalesce(target_element_id, '') <> ''
            AND NOT EXISTS (SELECT 1 FROM el WHERE el.payload_id = a.payload_id AND el.element_id = a.target_element_id)"""),
        "guarded_actions": with_(ACTIONS, f"""SELECT payload_id, action_seq, violated_type, 'Rejected: value field matched raw ' || violated_type || ' shape, not a valid token' AS reject_reason
            FROM (SELECT *, {GUARD.format(v='value')} AS violated_type FROM actions WHERE type = 'type') WHERE violated_type IS NOT NULL"""),
        "action_contract": with_(ACTIONS, f"""SELECT payload_id, action_seq, concat_ws(',',
            CASE WHEN type NOT IN ({_names(V.ACTION_TYPES)}) THEN 'type_value' END,
            CASE WHEN coalesce(risk_tier, '') NOT IN ('safe', 'risky') THEN 'risk_tier_value' END,
            CASE WHEN reasoning_short IS NULL THEN 'reasoning_missing' END,
            CASE WHEN type IN ('click', 'type') AND coalesce(target_element_id, '') = '' THEN 'target_missing' END,
            CASE WHEN type = 'type' AND value IS NULL THEN 'value_missing' END) AS reject_reasons FROM actions"""),
        "sensitive_without_token": with_(*EL, TOKENIZED, """SELECT payload_id, seq, sensitivity_type FROM tok
            WHERE is_sensitive AND has_value AND (payload_id % 7 = 0 OR coalesce(semantic_token, '') = '')"""),
        "payload_contract": with_(*EL, TOKENIZED, "per AS (SELECT payload_id, bool_or(is_sensitive AND has_value) AS holds FROM tok GROUP BY payload_id)",
            """SELECT payload_id, concat_ws(',', CASE WHEN k = 8 THEN 'session_id_missing' END,
            CASE WHEN k = 9 OR (k = 10 AND length(o_orderpriority) * 400 > 2000) THEN 'task_instruction_length' END,
            CASE WHEN k = 13 THEN 'dom_summary_missing' END, CASE WHEN k = 11 THEN 'last_action_error_length' END,
            CASE WHEN k = 6 THEN 'element_field_missing' END, CASE WHEN k = 3 THEN 'sensitivity_tier_value' END,
            CASE WHEN k = 4 THEN 'sensitivity_type_value' END, CASE WHEN k = 7 THEN 'confidence_range' END,
            CASE WHEN k = 14 THEN 'method_value' END, CASE WHEN k = 5 AND holds THEN 'sensitive_without_token' END) AS reject_reasons
            FROM (SELECT o_orderkey AS payload_id, o_orderkey % 17 AS k, o_orderpriority FROM orders) JOIN per USING (payload_id)"""),
    }
