"""The same queries in ANSI SQL. RE2 has no lookaround, so digit runs carry those rules."""

from __future__ import annotations

from veilgrid.functions import values as V
from veilgrid.plans import derived as d

KEY = "demo-key"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IFSC = r"\b[A-Za-z]{4}0[A-Za-z0-9]{6}\b"
RUN = r"[0-9](?:[ -]?[0-9])*"
DIGITS = r"[0-9]+"
ORD = "CASE type WHEN 'EMAIL' THEN 1 WHEN 'PHONE' THEN 2 WHEN 'CARD_NUMBER' THEN 3 WHEN 'AADHAAR' THEN 4 WHEN 'IFSC' THEN 5 ELSE 6 END"


def _names(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def tier(kind: str) -> str:
    return f"CASE WHEN {kind} IN ({_names(V.TIER_1_TYPES)}) THEN 1 WHEN {kind} IN ({_names(V.TIER_2_TYPES)}) THEN 2 ELSE 3 END"


def _find(name: str, source: str, key: str, text: str, pattern: str, guard: str) -> str:
    """CTE of all matches of a pattern: key, match, start_idx, end_idx, text."""
    return f"""{name} AS (
        SELECT {key}, text, m[i] AS match,
               CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)
                  + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start_idx
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT {key}, {text} AS text, regexp_extract_all({text}, '{pattern}') AS m,
                   string_split_regex({text}, '{pattern}') AS p FROM {source} WHERE {guard})))"""


def spans(source: str, key: str, text: str = "text", prefix: str = "") -> str:
    """CTEs that end in ``{prefix}spans``: key, type, match, start_idx, end_idx, ord."""
    x = prefix
    context = f"substr(text, greatest(start_idx - 30, 0) + 1, start_idx + length(match) + 30 - greatest(start_idx - 30, 0))"
    return ",\n".join((
        _find(f"{x}emails", source, key, text, EMAIL, f"contains({text}, '@')"),
        _find(f"{x}ifscs", source, key, text, IFSC, f"contains({text}, '0')"),
        _find(f"{x}digits", source, key, text, DIGITS, f"regexp_matches({text}, '[0-9]{{10}}')"),
        _find(f"{x}runs", source, key, text, RUN, f"regexp_matches({text}, '[0-9]')"),
        f"""{x}typed AS (
            SELECT {key}, 'EMAIL' AS type, match, start_idx FROM {x}emails
            UNION ALL SELECT {key}, 'PHONE', match, start_idx FROM {x}digits WHERE length(match) = 10 AND match >= '6'
            UNION ALL SELECT {key}, 'CARD_NUMBER', match, start_idx FROM {x}runs WHERE length(replace(replace(match, ' ', ''), '-', '')) = 16
            UNION ALL SELECT {key}, 'AADHAAR', match, start_idx FROM {x}runs WHERE length(replace(replace(match, ' ', ''), '-', '')) = 12
            UNION ALL SELECT {key}, 'IFSC', match, start_idx FROM {x}ifscs
            UNION ALL SELECT {key}, 'OTP', match, start_idx FROM {x}runs WHERE length(match) BETWEEN 4 AND 6
                AND regexp_matches(match, '^[0-9]+$') AND regexp_matches({context}, '(?i)\\b(otp|code|verification)\\b'))""",
        f"""{x}spans AS MATERIALIZED (SELECT {key}, type, match, start_idx, CAST(start_idx + length(match) AS INTEGER) AS end_idx,
            {ORD} AS ord, {tier('type')} AS tier FROM {x}typed)""",
    ))


def kept(key: str, prefix: str = "") -> str:
    """CTE ``{prefix}kept``: spans left after overlaps are resolved, numbered per text."""
    x = prefix
    return f"""{x}ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY start_idx, start_idx - end_idx, tier, ord) AS rn FROM {x}spans),
    {x}walk AS (
        SELECT *, end_idx AS last, true AS keep FROM {x}ranked WHERE rn = 1
        UNION ALL
        SELECT r.*, CASE WHEN r.start_idx >= w.last THEN r.end_idx ELSE w.last END, r.start_idx >= w.last
        FROM {x}walk w JOIN {x}ranked r ON r.rn = w.rn + 1 AND {' AND '.join(f'r.{k.strip()} = w.{k.strip()}' for k in key.split(','))}),
    {x}kept AS (SELECT *, lag(end_idx, 1, 0) OVER (PARTITION BY {key} ORDER BY rn) AS prev_end FROM {x}walk WHERE keep)"""


def suffix(session: str, value: str, letters: int = 24) -> str:
    inner = f"sha256('{KEY}|' || length({session}) || '|' || {session} || '|' || {value})"
    return f"translate(substr(sha256('{KEY}|' || {inner}), 1, {letters}), '0123456789', 'ghijklmnop')"


def token(session: str, value: str, kind: str, letters: int = 24) -> str:
    return f"('[' || {kind} || '_' || {suffix(session, value, letters)} || ']')"


def with_(*parts: str) -> str:
    """A select after its CTEs; the last part is the select."""
    return "WITH RECURSIVE " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


TEXTS = (
    "texts AS (SELECT doc_id, source AS session_id, text FROM documents UNION ALL "
    + d.select_sql(d.MESSAGES, "orders") + ")"
)
TEXT_SPANS = spans("texts", "doc_id, session_id")
TEXT_KEPT = kept("doc_id, session_id")
REDACTED = f"""pieces AS (SELECT doc_id, session_id, rn, prev_end, end_idx,
        substr(text, prev_end + 1, start_idx - prev_end) || {token('k.session_id', 'match', 'type')} AS piece
        FROM kept k JOIN texts USING (doc_id, session_id)),
    joined AS (SELECT doc_id, string_agg(piece, '' ORDER BY rn) AS head, max(end_idx) AS last, count(*) AS n FROM pieces GROUP BY doc_id),
    redacted AS (SELECT t.doc_id, t.session_id, coalesce(head || substr(text, last + 1), text) AS text,
        CAST(coalesce(n, 0) AS INTEGER) AS n_redacted FROM texts t LEFT JOIN joined j ON t.doc_id = j.doc_id)"""
INSTRUCTIONS = f"instructions AS ({d.select_sql(d.INSTRUCTIONS, 'customer')})"
_LEAD = r"\b(?:account|credentials|creds|login|log ?in)\b[,:]?\s+"
_GAP = r"\s*(?:/|,|\band\b)\s*"
_QUOTE = "[''\"]"
CREDENTIALS = rf"""found AS (SELECT *, regexp_matches(task_instruction, '(?i)\b(log\s*in|log\s*me\s*in|sign\s*in)\b') AS needs_credentials,
        nullif(regexp_extract(task_instruction, '(?i)username\s+{_QUOTE}([^''"]+){_QUOTE}', 1), '') AS u1,
        nullif(regexp_extract(task_instruction, '(?i)password\s+{_QUOTE}([^''"]+){_QUOTE}', 1), '') AS p1,
        nullif(regexp_extract(task_instruction, '(?i){_LEAD}([^\s,/]+){_GAP}([^\s,/.!?]+)', 1), '') AS u2,
        nullif(regexp_extract(task_instruction, '(?i){_LEAD}([^\s,/]+){_GAP}([^\s,/.!?]+)', 2), '') AS p2
        FROM instructions),
    credentials AS (SELECT instruction_id, session_id, task_instruction, needs_credentials,
        CASE WHEN u1 IS NOT NULL OR p1 IS NOT NULL THEN u1 WHEN needs_credentials THEN u2 END AS username,
        CASE WHEN u1 IS NOT NULL OR p1 IS NOT NULL THEN p1 WHEN needs_credentials THEN p2 END AS password,
        CASE WHEN u1 IS NOT NULL OR p1 IS NOT NULL THEN 'quoted' WHEN needs_credentials AND u2 IS NOT NULL THEN 'informal'
             WHEN needs_credentials THEN 'unresolved' ELSE 'none' END AS credential_source FROM found)"""
OCCURRENCES = """occurrences AS MATERIALIZED (
        SELECT session_id, match AS raw_value, type AS sensitivity_type, doc_id AS ord, start_idx AS pos FROM spans
        UNION ALL SELECT session_id, username, 'NAME', instruction_id, 0 FROM credentials WHERE username IS NOT NULL
        UNION ALL SELECT session_id, password, 'PASSWORD', instruction_id, 1 FROM credentials WHERE password IS NOT NULL)"""


def vault(letters: int = 24) -> str:
    return f"""vault AS MATERIALIZED (SELECT session_id, raw_value, sensitivity_type, {token('session_id', 'raw_value', 'sensitivity_type', letters)} AS token FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id, raw_value ORDER BY ord, pos, sensitivity_type) AS first FROM occurrences) WHERE first = 1)"""


VAULT = (TEXTS, TEXT_SPANS, INSTRUCTIONS, CREDENTIALS, OCCURRENCES, vault())
CLAIMED = """claimed AS (SELECT session_id, token, 'own' AS claim FROM vault
        UNION ALL SELECT session_id || 'x', token, 'other' FROM vault
        UNION ALL SELECT session_id, '[' || sensitivity_type || '_' || reverse(substr(sha256(raw_value), 1, 10)) || ']', 'forged' FROM vault)"""
ISSUED_SHAPE = r"^\[[A-Z_]+_[A-Za-z0-9]+(?:\?|: [^\]]+)?\]$"
STRICT_SHAPE = r"^\[[A-Z0-9_]+(?:\?|: [^\]]+)?\]$"
STATS_SHAPE = r"^\[([A-Z_]+)_[a-z0-9]+\]$"
ACTIONS = f"actions AS ({d.select_sql(d.ACTIONS, 'lineitem')})"
GUARD = r"""CASE WHEN {v} IS NULL OR {v} = '' OR regexp_matches({v}, '^\[[A-Za-z0-9_]+\]$') THEN NULL
    WHEN regexp_matches({v}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') THEN 'EMAIL'
    WHEN regexp_matches({v}, '(^|[^0-9])[6-9][0-9]{{9}}($|[^0-9])') THEN 'PHONE'
    WHEN regexp_matches({v}, '(^|[^0-9])(?:[0-9][ -]?){{15}}[0-9]($|[^0-9])') THEN 'CARD_NUMBER'
    WHEN regexp_matches({v}, '(^|[^0-9])(?:[0-9][ -]?){{11}}[0-9]($|[^0-9])') THEN 'AADHAAR'
    WHEN regexp_matches({v}, '\b[A-Za-z]{{4}}0[A-Za-z0-9]{{6}}\b') THEN 'IFSC' END"""


def text_queries() -> dict[str, str]:
    span_columns = "doc_id, session_id, type, match, start_idx, end_idx"
    queries = {
        f"{kind.lower()}_spans": with_(TEXTS, TEXT_SPANS, f"SELECT {span_columns} FROM spans WHERE type = '{kind}'")
        for kind in V.DETECTION_ORDER
    }
    queries |= {
        "pii_spans": with_(TEXTS, TEXT_SPANS, f"SELECT {span_columns} FROM spans"),
        "top_pii_type": with_(TEXTS, TEXT_SPANS, """SELECT doc_id, type AS top_type FROM (SELECT *,
            row_number() OVER (PARTITION BY doc_id ORDER BY tier, ord, start_idx) AS r FROM spans) WHERE r = 1"""),
        "value_guard": with_(TEXTS, f"""SELECT doc_id, violated_type FROM (SELECT doc_id, {GUARD.format(v='text')} AS violated_type
            FROM texts) WHERE violated_type IS NOT NULL"""),
        "redacted_text": with_(TEXTS, TEXT_SPANS, TEXT_KEPT, REDACTED,
            "SELECT doc_id, sha256(text) AS redacted_sha, n_redacted FROM redacted"),
        "residual_check": with_(TEXTS, TEXT_SPANS, TEXT_KEPT, REDACTED, spans("redacted", "doc_id", prefix="again_"),
            """SELECT outcome, count(*) AS n_docs FROM (SELECT CASE WHEN doc_id IN (SELECT doc_id FROM again_spans)
               AND n_redacted > 0 THEN 'held' ELSE 'clean' END AS outcome FROM redacted) GROUP BY outcome"""),
        "redaction_report": with_(spans("documents", "doc_id, source"), kept("doc_id, source"),
            """SELECT source, type, count(*) AS n_spans, count(DISTINCT doc_id) AS n_documents FROM kept GROUP BY source, type"""),
        "vault_tokens": with_(*VAULT, "SELECT session_id, raw_value, sensitivity_type, token FROM vault"),
        "vault_tokens_short": with_(*VAULT[:-1], vault(4), """SELECT session_id, raw_value, sensitivity_type,
            CASE WHEN r = 0 THEN token ELSE substr(token, 1, length(token) - 1) || translate(upper(to_hex(r)), '0123456789ABCDEF', 'ghijklmnopabcdef') || ']' END AS token
            FROM (SELECT *, row_number() OVER (PARTITION BY session_id, token ORDER BY raw_value) - 1 AS r FROM vault)"""),
        "token_join": with_(*VAULT, """SELECT session_id, ord, pos, o.sensitivity_type, token FROM occurrences o
            LEFT JOIN vault v USING (session_id, raw_value)"""),
        "redaction_round_trip": with_(TEXTS, TEXT_SPANS, TEXT_KEPT, """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id, session_id ORDER BY rn) - 1 AS INTEGER) AS pos,
            match AS raw_value FROM kept"""),
        "token_resolution": with_(*VAULT, CLAIMED, """SELECT session_id, token, claim, raw_value,
            CASE WHEN raw_value IS NULL THEN 'unresolvable_token' ELSE 'ok' END AS status FROM claimed LEFT JOIN vault USING (session_id, token)"""),
        "stable_tokens": with_(*VAULT, CLAIMED, "SELECT session_id, token, claim FROM claimed SEMI JOIN vault USING (session_id, token)"),
        "forged_tokens": with_(*VAULT, CLAIMED, f"""SELECT session_id, token, claim FROM claimed
            WHERE regexp_matches(token, '{ISSUED_SHAPE}') AND token NOT IN (SELECT token FROM vault)"""),
        "vault_stats": with_(*VAULT, f"""SELECT session_id, coalesce(token_type, 'ALL') AS token_type, count(*) AS n_tokens FROM (
            SELECT session_id, coalesce(nullif(regexp_extract(token, '{STATS_SHAPE}', 1), ''), 'UNKNOWN') AS token_type FROM vault)
            GROUP BY GROUPING SETS ((session_id, token_type), (session_id))"""),
        "token_uniqueness": with_(*VAULT, """SELECT session_id, count(*) AS n_issued, count(DISTINCT token) AS n_distinct,
            count(*) = count(DISTINCT token) AS is_unique FROM vault GROUP BY session_id"""),
        "quoted_credentials": with_(INSTRUCTIONS, CREDENTIALS, "SELECT instruction_id, username, password FROM credentials WHERE credential_source = 'quoted'"),
        "informal_credentials": with_(INSTRUCTIONS, CREDENTIALS, "SELECT instruction_id, username, password FROM credentials WHERE credential_source = 'informal'"),
        "credential_intent": with_(INSTRUCTIONS, r"""SELECT id, part, regexp_matches(text, '(?i)\b(log\s*in|log\s*me\s*in|sign\s*in)\b') AS needs_credentials
            FROM (SELECT conv_id AS id, turn AS part, text FROM conversations UNION ALL SELECT instruction_id, -1, task_instruction FROM instructions)"""),
        "token_shapes": with_(*VAULT, CLAIMED, ACTIONS, rf"""SELECT value, regexp_matches(value, '^\[[A-Za-z0-9_]+\]$') AS is_bracket,
            regexp_matches(value, '{ISSUED_SHAPE}') AS is_issued_shape, regexp_matches(value, '{STRICT_SHAPE}') AS is_strict_shape,
            coalesce(nullif(regexp_extract(value, '{STATS_SHAPE}', 1), ''), 'UNKNOWN') AS token_type
            FROM (SELECT token AS value FROM claimed UNION SELECT value FROM actions WHERE value IS NOT NULL)"""),
    }
    quoted = rf"""replaced AS (SELECT *, CASE credential_source WHEN 'none' THEN task_instruction
        WHEN 'quoted' THEN CASE WHEN username IS NULL THEN task_instruction ELSE regexp_replace(task_instruction, '(?i)username\s+{_QUOTE}([^''"]+){_QUOTE}', 'username ' || ut) END
        WHEN 'informal' THEN regexp_replace(task_instruction, '(?i)({_LEAD})([^\s,/]+)({_GAP})([^\s,/.!?]+)', '\1' || ut || '\3' || pt) END AS t1
        FROM (SELECT *, {token('session_id', 'username', "'NAME'")} AS ut,
            {token('session_id', 'password', "(CASE WHEN password = username THEN 'NAME' ELSE 'PASSWORD' END)")} AS pt FROM credentials)),
    replaced2 AS (SELECT *, CASE WHEN credential_source = 'quoted' AND password IS NOT NULL
        THEN regexp_replace(t1, '(?i)password\s+{_QUOTE}([^''"]+){_QUOTE}', 'password ' || pt) ELSE t1 END AS text FROM replaced)"""
    pieces = f"""pieces AS (SELECT instruction_id, rn, end_idx, substr(text, prev_end + 1, start_idx - prev_end)
            || {token('session_id', 'match', "(CASE WHEN match = username THEN 'NAME' WHEN match = password THEN 'PASSWORD' ELSE type END)")} AS piece
            FROM kept JOIN replaced2 USING (instruction_id)),
        joined AS (SELECT instruction_id, string_agg(piece, '' ORDER BY rn) AS head, max(end_idx) AS last FROM pieces GROUP BY instruction_id),
        outcome AS (SELECT instruction_id, task_instruction, credential_source, coalesce(head || substr(text, last + 1), text) AS clean
            FROM replaced2 LEFT JOIN joined USING (instruction_id))"""
    base = (INSTRUCTIONS, CREDENTIALS, quoted, spans("replaced2", "instruction_id"), kept("instruction_id"), pieces)
    queries["sanitized_instructions"] = with_(*base, """SELECT instruction_id, clean AS sanitized_instruction,
        CASE WHEN credential_source = 'unresolved' THEN 'unresolved_sensitive_reference' END AS reject_reason FROM outcome""")
    queries["unresolved_instructions"] = with_(*base, """SELECT instruction_id, task_instruction, 'unresolved_sensitive_reference' AS reject_reason
        FROM outcome WHERE credential_source = 'unresolved'""")
    return queries
