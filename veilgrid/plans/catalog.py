"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.functions import classify as C
from veilgrid.functions import detect as D
from veilgrid.functions import geometry as G
from veilgrid.functions import registry
from veilgrid.functions import tiers as T
from veilgrid.functions import tokens as K
from veilgrid.functions import values as V
from veilgrid.operators import audit as A
from veilgrid.operators import decisions as DC
from veilgrid.operators import elements as E
from veilgrid.operators import fusion as J
from veilgrid.operators import policy as P
from veilgrid.operators import relink as R
from veilgrid.operators import sessions as S
from veilgrid.operators import text as X
from veilgrid.operators import validate as W
from veilgrid.operators import vault as U
from veilgrid.plans import derived
from veilgrid.plans.derived import table
from veilgrid.session import cut_lineage, shared_folder
from veilgrid.sources import audit_log as audit_sources
from veilgrid.sources import html as html_sources
from veilgrid.sources import payloads as sources_payloads
from veilgrid.sources import vision as vision_sources
from veilgrid.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEY = "demo-key"  # queries must repeat; real jobs pass their own secret


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


# --- detection -----------------------------------------------------------------------


def _register_type(kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return X.pii_spans(derived.texts(spark, sf_dir), kind=kind)

    QUERIES[f"{kind.lower()}_spans"] = run


for _kind in V.DETECTION_ORDER:
    _register_type(_kind)


@query
def pii_spans(spark, sf_dir):
    return X.pii_spans(derived.texts(spark, sf_dir))


@query
def top_pii_type(spark, sf_dir):
    rows = D.computed_once(derived.texts(spark, sf_dir), {"spans": D.spans_sql("text")})
    return rows.select("doc_id", D.top_type("spans").alias("top_type")).where("top_type is not null")


@query
def value_guard(spark, sf_dir):
    rows = D.computed_once(derived.texts(spark, sf_dir), {"violated_type": D.value_guard_sql("text")})
    return rows.where("violated_type is not null").select("doc_id", "violated_type")


@query
def redacted_text(spark, sf_dir):
    return X.redact_text(derived.texts(spark, sf_dir), KEY).select(
        "doc_id", F.expr("sha2(redacted_text, 256)").alias("redacted_sha"), "n_redacted"
    )


@query
def residual_check(spark, sf_dir):
    clean, held = X.split_residual(X.redact_text(derived.texts(spark, sf_dir), KEY))
    sides = clean.select(F.lit("clean").alias("outcome")).unionAll(held.select(F.lit("held").alias("outcome")))
    return sides.groupBy("outcome").agg(F.count("*").alias("n_docs"))


@query
def redaction_report(spark, sf_dir):
    """Spans and documents per source and type; documents are counted from their span arrays."""
    docs = table(spark, sf_dir, "documents").select(
        "source", F.expr(D.resolved_spans_sql(D.spans_sql("text"))).alias("spans")
    )
    per_doc = docs.select(
        "source", F.explode_outer(F.expr("""transform(array_distinct(transform(spans, s -> s.type)),
            t -> struct(t as type, size(filter(spans, s -> s.type = t)) as n))""")).alias("t")
    ).where("t is not null")
    return per_doc.groupBy("source", F.col("t.type").alias("type")).agg(
        F.sum("t.n").cast("bigint").alias("n_spans"), F.count("*").alias("n_documents")
    )


# --- tokens and credentials ------------------------------------------------------------


def _occurrences(spark, sf_dir) -> DataFrame:
    """Detected values of all texts and credentials of all instructions."""
    spans = X.pii_spans(derived.texts(spark, sf_dir)).selectExpr(
        "session_id", "match as raw_value", "type as sensitivity_type", "doc_id as ord", "start_idx as pos"
    )
    named = X.extract_credentials(derived.instructions(spark, sf_dir))
    pairs = named.select("session_id", "instruction_id", F.expr(
        "stack(2, username, 'NAME', 0, password, 'PASSWORD', 1) as (raw_value, sensitivity_type, pos)"
    )).selectExpr("session_id", "raw_value", "sensitivity_type", "instruction_id as ord", "pos")
    return spans.unionByName(pairs)


def _vault(spark, sf_dir) -> DataFrame:
    return U.issue_vault(_occurrences(spark, sf_dir), KEY, ("ord", "pos"))


@query
def vault_tokens(spark, sf_dir):
    return _vault(spark, sf_dir)


@query
def vault_tokens_short(spark, sf_dir):
    return U.issue_vault(_occurrences(spark, sf_dir), KEY, ("ord", "pos"), letters=4)


@query
def token_join(spark, sf_dir):
    occ = _occurrences(spark, sf_dir).where("raw_value is not null")
    return U.with_tokens(occ, _vault(spark, sf_dir)).select("session_id", "ord", "pos", "sensitivity_type", "token")


@query
def redaction_round_trip(spark, sf_dir):
    """Every token of every redacted text, resolved back to its raw value."""
    redacted = X.redact_text(derived.texts(spark, sf_dir), KEY).select("doc_id", "session_id", "redacted_text")
    return U.restore_tokens(X.text_tokens(redacted), _vault(spark, sf_dir)).select("doc_id", "pos", "raw_value")


def _claimed_tokens(spark, sf_dir) -> DataFrame:
    """Token strings as a model might send them back: real, of another session, and invented."""
    vault = _vault(spark, sf_dir)
    return vault.selectExpr("""stack(3,
        session_id, token, 'own',
        concat(session_id, 'x'), token, 'other',
        session_id, concat('[', sensitivity_type, '_', reverse(substring(sha2(raw_value, 256), 1, 10)), ']'), 'forged')
        as (session_id, token, claim)""")


@query
def token_resolution(spark, sf_dir):
    return U.resolve_tokens(_claimed_tokens(spark, sf_dir), _vault(spark, sf_dir))


@query
def stable_tokens(spark, sf_dir):
    return U.has_token(_claimed_tokens(spark, sf_dir), _vault(spark, sf_dir))


@query
def forged_tokens(spark, sf_dir):
    return U.forged_tokens(_claimed_tokens(spark, sf_dir), _vault(spark, sf_dir))


@query
def vault_stats(spark, sf_dir):
    return U.vault_stats(_vault(spark, sf_dir))


@query
def token_uniqueness(spark, sf_dir):
    return U.token_uniqueness(_vault(spark, sf_dir))


@query
def quoted_credentials(spark, sf_dir):
    return X.extract_credentials(derived.instructions(spark, sf_dir)).where("credential_source = 'quoted'").select(
        "instruction_id", "username", "password"
    )


@query
def credential_intent(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").selectExpr("conv_id as id", "turn as part", "text")
    tasks = derived.instructions(spark, sf_dir).selectExpr(
        "instruction_id as id", "cast(-1 as bigint) as part", "task_instruction as text")
    return talk.unionByName(tasks).select("id", "part", F.expr(K.needs_credentials_sql("text")).alias("needs_credentials"))


@query
def informal_credentials(spark, sf_dir):
    return X.extract_credentials(derived.instructions(spark, sf_dir)).where("credential_source = 'informal'").select(
        "instruction_id", "username", "password"
    )


@query
def unresolved_instructions(spark, sf_dir):
    return X.sanitize_instructions(derived.instructions(spark, sf_dir), KEY).where("reject_reason is not null").select(
        "instruction_id", "task_instruction", "reject_reason"
    )


@query
def sanitized_instructions(spark, sf_dir):
    return X.sanitize_instructions(derived.instructions(spark, sf_dir), KEY).select(
        "instruction_id", "sanitized_instruction", "reject_reason"
    )


@query
def token_shapes(spark, sf_dir):
    claims = _claimed_tokens(spark, sf_dir).selectExpr("token as value").unionAll(
        derived.actions(spark, sf_dir).where("value is not null").select("value")
    ).distinct()
    return claims.select(
        "value",
        F.expr(K.is_bracket_token_sql("value")).alias("is_bracket"),
        F.expr(K.is_audit_token_sql("value")).alias("is_issued_shape"),
        F.expr(K.is_audit_token_sql("value", strict_reference=True)).alias("is_strict_shape"),
        F.expr(K.token_type_sql("value")).alias("token_type"),
    )


# --- elements --------------------------------------------------------------------------


def _elements(spark, sf_dir) -> DataFrame:
    """Classified elements; the session of an element is its payload's order number modulo 40."""
    rows = E.classify_elements(derived.raw_elements(spark, sf_dir))
    return rows.withColumn("session_id", F.expr("concat('pay', payload_id % 40)"))


WITH_TOKEN = "sensitivity_tier in (1, 2) and has_value"


KEPT = (
    "payload_id", "seq", "session_id", "element_id", "tag", "role", "label_text", "raw_value", "has_value", "is_sensitive", "sensitivity_tier",
    "sensitivity_type", "confidence", "method", "x", "y", "w", "h",
)


def _kept_elements(spark, sf_dir, *more: str) -> DataFrame:
    """The classified elements as a table of their own, so that payloads, vault and channels classify them once."""
    return cut_lineage(_elements(spark, sf_dir).select(*KEPT, *more), "elements")


def _element_vault(elements: DataFrame) -> DataFrame:
    return U.issue_vault(elements.where(WITH_TOKEN), KEY, ("payload_id", "seq"))


def _tokenized(elements: DataFrame) -> DataFrame:
    joined = U.attach_tokens(elements, KEY, ("payload_id", "seq"), WITH_TOKEN)
    return joined.withColumn("semantic_token", F.expr(
        T.token_decision_sql("sensitivity_tier", "sensitivity_type", "raw_value", "token", "null")))


@query
def element_labels(spark, sf_dir):
    raw = derived.raw_elements(spark, sf_dir)
    labels = raw.where("for_label is not null").selectExpr(
        "payload_id", "dom_id as for_id", "seq as label_seq", "for_label as label_text")
    return E.attach_for_labels(raw, labels).selectExpr("payload_id", "seq", f"{C.LABEL} as nearby_label")


@query
def element_roles(spark, sf_dir):
    return derived.raw_elements(spark, sf_dir).selectExpr("payload_id", "seq", f"{C.ROLE} as role")


@query
def button_labels(spark, sf_dir):
    return E.classify_dom(derived.raw_elements(spark, sf_dir)).where("is_button").select(
        "payload_id", "seq", "tag", "role", "label_text", "dom_type")


@query
def element_dom_types(spark, sf_dir):
    return E.classify_dom(derived.raw_elements(spark, sf_dir)).select(
        "payload_id", "seq", "tag", "role", "label_text", "dom_type")


@query
def element_ids(spark, sf_dir):
    return derived.raw_elements(spark, sf_dir).select(
        "payload_id", "seq", F.expr(C.element_id_sql("payload_id", "seq")).alias("element_id"))


@query
def element_values(spark, sf_dir):
    return E.classify_dom(derived.raw_elements(spark, sf_dir)).select("payload_id", "seq", "raw_value", "has_value")


@query
def deceptive_labels(spark, sf_dir):
    return E.deceptive_labels(derived.raw_elements(spark, sf_dir)).select("payload_id", "seq", "inner_text", "aria_label")


@query
def element_tiers(spark, sf_dir):
    return _elements(spark, sf_dir).groupBy("sensitivity_type", "sensitivity_tier").agg(F.count("*").alias("n_elements"))


@query
def type_fusion(spark, sf_dir):
    return _elements(spark, sf_dir).select(
        "payload_id", "seq", "dom_type", "pii_type", "sensitivity_type", "source", "type_mismatch")


@query
def element_reasons(spark, sf_dir):
    return _elements(spark, sf_dir).where("reason is not null").select("payload_id", "seq", "reason")


def _amounts(spark, sf_dir) -> DataFrame:
    rows = _elements(spark, sf_dir).where("sensitivity_type = 'AMOUNT' and coalesce(raw_value, '') <> ''")
    text = rows.withColumn("amount_text", F.expr(T.amount_text_sql("spans", "label_text", "raw_value")))
    return text.withColumn("number", F.expr(T.amount_number_sql("amount_text")))


@query
def amount_buckets(spark, sf_dir):
    return _amounts(spark, sf_dir).select(
        "payload_id", "seq", "number", F.expr(T.amount_bucket_sql("number")).alias("amount_token"))


@query
def token_decisions(spark, sf_dir):
    return _tokenized(_kept_elements(spark, sf_dir)).select("payload_id", "seq", "sensitivity_type", "semantic_token")


@query
def base_confidence(spark, sf_dir):
    return _elements(spark, sf_dir).select("payload_id", "seq", "confidence", "method")


@query
def confidence_gate(spark, sf_dir):
    rows = _tokenized(_kept_elements(spark, sf_dir)).withColumn("confidence", F.expr("cast(seq % 101 as double) / 100"))
    return rows.select(
        "payload_id", "seq", "sensitivity_tier",
        F.expr(T.gate_action_sql("sensitivity_tier", "confidence")).alias("action"),
        F.expr(T.gate_token_sql("sensitivity_tier", "sensitivity_type", "semantic_token", "confidence")).alias("gated_token"),
    )


@query
def confidence_badges(spark, sf_dir):
    return derived.vision_boxes(spark, sf_dir).groupBy(F.expr(T.badge_sql("confidence")).alias("badge")).agg(
        F.count("*").alias("n_boxes"))


# --- actions ---------------------------------------------------------------------------

_TARGET = ("label_text", "is_sensitive", "input_type", "text_content", "interactable")


def _targeted(spark, sf_dir) -> DataFrame:
    page = _elements(spark, sf_dir).withColumns({
        "input_type": F.expr("lower(type)"),
        "text_content": F.col("inner_text"),
        "interactable": F.expr("w > 0 and h > 0 and x < 760"),
    })
    acts = derived.actions(spark, sf_dir).withColumn("session_id", F.expr("concat('pay', payload_id % 40)"))
    return P.attach_targets(acts, page, _TARGET)


@query
def client_risk(spark, sf_dir):
    return P.client_risk(derived.actions(spark, sf_dir)).select("payload_id", "action_seq", "client_risk")


@query
def action_targets(spark, sf_dir):
    return _targeted(spark, sf_dir).select("payload_id", "action_seq", "target_element_id", "label_text", "is_sensitive", "found")


@query
def policy_risk(spark, sf_dir):
    return P.policy_risk(_targeted(spark, sf_dir)).select("payload_id", "action_seq", "policy_risk")


@query
def needs_confirmation(spark, sf_dir):
    return P.needs_confirmation(_targeted(spark, sf_dir)).select("payload_id", "action_seq", "needs_confirmation")


@query
def executability(spark, sf_dir):
    acts = _targeted(spark, sf_dir)
    known = acts.where("value = '[EMAIL_7]' and payload_id % 3 = 0").selectExpr("session_id", "value as token")
    return P.executability(acts, known).select("payload_id", "action_seq", "status")


@query
def hallucinated_targets(spark, sf_dir):
    ids = derived.raw_elements(spark, sf_dir).select("payload_id", F.expr(C.element_id_sql("payload_id", "seq")).alias("element_id"))
    return P.hallucinated_targets(derived.actions(spark, sf_dir), ids).select(
        "payload_id", "action_seq", "target_element_id")


@query
def guarded_actions(spark, sf_dir):
    return P.guarded_actions(derived.actions(spark, sf_dir)).select("payload_id", "action_seq", "violated_type", "reject_reason")


# --- contracts -------------------------------------------------------------------------


@query
def action_contract(spark, sf_dir):
    return W.check_actions(derived.actions(spark, sf_dir)).select(
        "payload_id", "action_seq", F.array_join("reject_reasons", ",").alias("reject_reasons"))


@query
def sensitive_without_token(spark, sf_dir):
    """Sensitive, filled elements whose token is missing: here where the vault skipped a session."""
    rows = _tokenized(_kept_elements(spark, sf_dir)).withColumn("semantic_token", F.expr("if(payload_id % 7 = 0, '', semantic_token)"))
    return W.check_sensitive_tokens(rows).select("payload_id", "seq", "sensitivity_type")


def _payloads(spark, sf_dir, elements: DataFrame | None = None) -> DataFrame:
    """Payload documents as a table of their own, the way an audit finds them."""
    return cut_lineage(_made_payloads(spark, sf_dir, elements), "payloads")


def _made_payloads(spark, sf_dir, elements: DataFrame | None = None) -> DataFrame:
    """Payload documents, one per order, with some broken in known ways."""
    elements = _tokenized(elements or _kept_elements(spark, sf_dir)).groupBy("payload_id").agg(F.sort_array(F.collect_list(F.expr(
        """named_struct('seq', seq, 'element_id', element_id, 'tag', tag, 'role', role,
            'label_text', if(payload_id % 6 = 1 and is_sensitive, concat_ws(' ', label_text, raw_value), label_text), 'is_sensitive', is_sensitive, 'sensitivity_tier', if(payload_id % 17 = 3, 4, sensitivity_tier),
            'sensitivity_type', if(payload_id % 17 = 4, 'SSN', sensitivity_type),
            'semantic_token', if(payload_id % 17 = 5, null, semantic_token), 'has_value', has_value,
            'bounding_box', if(payload_id % 17 = 6, null, named_struct('x', x, 'y', y, 'w', w, 'h', h)),
            'confidence', if(payload_id % 17 = 7, confidence + 1, confidence), 'method', method)"""))).alias("els"))
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey as payload_id", "o_orderpriority", "o_custkey")
    return orders.join(elements, "payload_id").selectExpr(
        "payload_id",
        "if(payload_id % 17 = 8, null, concat('cust', o_custkey)) as session_id",
        "case when payload_id % 17 = 9 then '' when payload_id % 17 = 10 then repeat(o_orderpriority, 400) else o_orderpriority end as task_instruction",
        "cast(1 as int) as step_number",
        "if(payload_id % 17 = 11, repeat('e', 1001), null) as last_action_error",
        "cast(if(payload_id % 17 = 12, repeat('i', 90), repeat('i', 120)) as string) as redacted_image_base64",
        "named_struct('url', if(payload_id % 17 = 13, null, 'https://shop.example.com'), 'elements', transform(els, e -> named_struct("
        "'element_id', e.element_id, 'tag', e.tag, 'role', e.role, 'label_text', e.label_text, 'is_sensitive', e.is_sensitive,"
        " 'sensitivity_tier', e.sensitivity_tier, 'sensitivity_type', e.sensitivity_type, 'semantic_token', e.semantic_token,"
        " 'has_value', e.has_value, 'bounding_box', e.bounding_box))) as dom_summary",
        "transform(els, e -> named_struct('element_id', e.element_id, 'confidence', e.confidence, 'method',"
        " if(payload_id % 17 = 14, 'guess', e.method))) as detection_confidence_notes",
        "transform(filter(els, e -> e.is_sensitive and (payload_id % 5 <> 2 or e.seq % 2 = 0)), e -> named_struct("
        "'element_id', e.element_id, 'sensitivity_tier', e.sensitivity_tier, 'semantic_token', e.semantic_token,"
        " 'bounding_box', if(payload_id % 9 = 4 and e.seq % 3 = 0, null, named_struct('x', e.bounding_box.x, 'y', e.bounding_box.y,"
        " 'w', if(payload_id % 9 = 5, null, e.bounding_box.w), 'h', e.bounding_box.h)))) as redacted_regions",
        "named_struct('otp_hint', case payload_id % 4 when 0 then els[0].semantic_token when 1 then '[PASSWORD_a83f]' when 2 then '' end) as extra",
    )


@query
def payload_contract(spark, sf_dir):
    return W.check_payloads(_payloads(spark, sf_dir)).select(
        "payload_id", F.array_join("reject_reasons", ",").alias("reject_reasons"))


# --- sessions --------------------------------------------------------------------------

NOW = "timestamp_ntz'2024-01-30 12:00:00'"


@query
def step_acceptance(spark, sf_dir):
    rows, _ = S.step_acceptance(derived.steps(spark, sf_dir), block=3)
    return rows.select("session_id", "arrival", "step_number", "accepted", "expected_step")


@query
def continuity_breaks(spark, sf_dir):
    rows, _ = S.step_acceptance(derived.steps(spark, sf_dir), block=3)
    return rows.where("continuity_break").select("session_id", "arrival", "step_number")


@query
def unchanged_frames(spark, sf_dir):
    return S.unchanged_frames(derived.events(spark, sf_dir, derived.FRAMES), order=("event_id",), unit="day").select("event_id", "session_id", "skipped")


def _epochs(spark, sf_dir) -> DataFrame:
    return S.expiry_epochs(derived.events(spark, sf_dir, derived.ACCESSES), order=("event_id",), unit="day")


@query
def session_expiry(spark, sf_dir):
    return _epochs(spark, sf_dir).select("event_id", "session_id", F.col("vault_epoch").cast("bigint").alias("vault_epoch"))


@query
def expired_sessions(spark, sf_dir):
    return S.expired_sessions(derived.events(spark, sf_dir, derived.ACCESSES), F.expr(NOW))


@query
def active_sessions(spark, sf_dir):
    return S.active_sessions(derived.events(spark, sf_dir, derived.ACCESSES), F.expr(NOW), warn_at=3)


@query
def session_concurrency(spark, sf_dir):
    return S.concurrency(_epochs(spark, sf_dir), warn_at=8).select(
        "session_id", "changed_at", "change", F.col("active").cast("bigint").alias("active"), "over_limit")


@query
def context_binding(spark, sf_dir):
    return S.context_binding(derived.events(spark, sf_dir, derived.BINDINGS), order=("event_id",), unit="day").select(
        "event_id", "session_id", "verdict")


@query
def rate_limit(spark, sf_dir):
    rows, _ = S.rate_limit(derived.requests(spark, sf_dir), "client", "at_us", ("event_id",), slice_width=150_000_000)
    return rows


def _analyzed(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.selectExpr(*derived.ASKED)
    limited, _ = S.rate_limit(asked.select("request_id", "client", "at_us"), "client", "at_us", ("request_id",), slice_width=300_000_000)
    requests = asked.join(limited.select("request_id", "allowed"), "request_id").withColumn(
        "reject_reason", F.expr("if(length(instruction) between 1 and 2000, null, 'task_instruction_length')"))
    answers = turns.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(2)))).selectExpr(*derived.ANSWERS)
    page = ", ".join(f"struct('{i}' as element_id, '{label}' as label_text, {secret} as is_sensitive, {seq} as seq)" for i, label, secret, seq in derived.ASKED_PAGES)
    elements = asked.selectExpr("request_id", f"inline(array({page}))")
    return DC.analyzed_requests(requests, answers, elements, block=4)


@query
def analyzed_requests(spark, sf_dir):
    """One verdict per request, the action that goes back, and its audit record."""
    return _analyzed(spark, sf_dir).select(
        "request_id", "verdict", "status_code", "in_history", "action.type", "action.target_element_id", "action.risk_tier",
        F.col("audit.instruction_hash").alias("instruction_hash"), F.col("audit.action.error").alias("error"),
        F.col("audit.action.value").alias("logged_value"), F.col("audit.confidence").alias("confidence"))


@query
def analyzed_audit_gaps(spark, sf_dir):
    """Handled requests and their audit events, and how many of either lack the other: none."""
    analyzed = cut_lineage(_analyzed(spark, sf_dir), "analyzed")
    handled = analyzed.where("verdict not in ('rate_limited', 'invalid_payload')").selectExpr("request_id as session_id", "step_number")
    events = DC.audit_events(analyzed).selectExpr("request_id as session_id", "step_number")
    rows = S.audit_gaps(handled, events).selectExpr("1 as gap", "0 as event").unionAll(events.selectExpr("0", "1"))
    return rows.agg(F.sum("gap").alias("n_gaps"), F.sum("event").alias("n_events"))


@query
def aligned_rate_limit(spark, sf_dir):
    rows = derived.requests(spark, sf_dir).withColumn("ts", F.expr(
        "timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(cast(at_us as decimal(18, 0)) / 1000000 as decimal(18, 6)))"))
    return S.aligned_rate_limit(rows, "client", "ts")


@query
def server_steps(spark, sf_dir):
    return S.server_steps(derived.events(spark, sf_dir, derived.ATTEMPTS), order=("event_id",), unit="day").select(
        "event_id", "session_id", F.col("request_step").cast("bigint").alias("request_step"))


@query
def previous_errors(spark, sf_dir):
    return S.previous_errors(derived.events(spark, sf_dir, derived.ATTEMPTS), order=("event_id",), unit="day").select(
        "event_id", "session_id", "last_action_error")


@query
def task_limits(spark, sf_dir):
    return S.task_limits(derived.events(spark, sf_dir, derived.ATTEMPTS))


@query
def task_outcomes(spark, sf_dir):
    return S.outcomes(derived.events(spark, sf_dir, derived.ENDS))


@query
def audit_completeness(spark, sf_dir):
    asked = derived.steps(spark, sf_dir).select("session_id", "step_number")
    logged = asked.where("(session_id + step_number) % 9 <> 0").unionAll(asked.where("session_id % 10 = 1"))
    return S.audit_gaps(asked, logged)


@query
def session_history(spark, sf_dir):
    rows, _ = S.step_acceptance(derived.steps(spark, sf_dir), block=3)
    return S.session_history(rows)


@query
def response_pairs(spark, sf_dir):
    asked = derived.steps(spark, sf_dir).select("session_id", "arrival", "step_number")
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr(
        "conv_id as session_id", "cast(turn + 2 as int) as step_number", "length(text) as n_chars")
    return W.pair_responses(asked, answers).select("session_id", "arrival", "step_number", "response_step", "n_chars", "paired")


@query
def response_contract(spark, sf_dir):
    answers = derived.actions(spark, sf_dir).selectExpr(
        "payload_id", "action_seq", "concat('s', payload_id) as expected_session", "1 as expected_step",
        "if(action_seq % 23 = 0, 's', concat('s', payload_id)) as session_id",
        "cast(if(action_seq % 19 = 0, 3, 2) as int) as step_number", "action_seq % 29 <> 0 as has_action",
        "action_seq % 31 <> 0 as has_response", "type", "risk_tier")
    return W.check_responses(answers).select("payload_id", "action_seq", "reject_reason")


@query
def purged_vault(spark, sf_dir):
    ended = table(spark, sf_dir, "customer").where("c_acctbal < 0").selectExpr("concat('cust', c_custkey % 40) as session_id")
    expired = table(spark, sf_dir, "nation").selectExpr("concat('src', n_nationkey) as session_id").where("session_id like 'src1%'")
    return U.purge_vault(_vault(spark, sf_dir), ended.where("session_id like 'cust2%'").unionAll(expired)).select(
        "session_id", "token")


# --- channels --------------------------------------------------------------------------


def _dom_boxes(spark, sf_dir) -> DataFrame:
    return derived.raw_elements(spark, sf_dir).select("payload_id", "seq", E.box().alias("box"))


def _vision(spark, sf_dir) -> DataFrame:
    return derived.vision_boxes(spark, sf_dir).withColumn("box", E.box())


@query
def box_iou(spark, sf_dir):
    page = derived.raw_elements(spark, sf_dir).select("payload_id", "seq", E.box().alias("a"))
    seen = _vision(spark, sf_dir).select("payload_id", "seq", F.col("box").alias("b"))
    return page.join(seen, ["payload_id", "seq"]).select("payload_id", "seq", F.expr(G.iou_sql("a", "b")).alias("iou"))


@query
def channel_mismatches(spark, sf_dir):
    return J.channel_mismatches(_elements(spark, sf_dir), derived.regions(spark, sf_dir))


@query
def channel_verdicts(spark, sf_dir):
    found = J.channel_mismatches(_elements(spark, sf_dir), derived.regions(spark, sf_dir), ignore_vision_only=True)
    return J.channel_verdicts(table(spark, sf_dir, "orders").selectExpr("o_orderkey as payload_id"), found)


@query
def channel_differences(spark, sf_dir):
    found = J.channel_mismatches(_elements(spark, sf_dir), derived.regions(spark, sf_dir), ignore_vision_only=True)
    return found.groupBy("issue").agg(F.count("*").alias("n_ids"))


@query
def region_matches(spark, sf_dir):
    return J.match_regions(_dom_boxes(spark, sf_dir), _vision(spark, sf_dir)).where("match_source = 'dom'").select(
        "payload_id", "seq", F.col("match_seq").alias("dom_seq"))


@query
def vision_collapse(spark, sf_dir):
    rows = J.match_regions(_dom_boxes(spark, sf_dir), _vision(spark, sf_dir))
    return rows.where("match_source is null or match_source = 'vision'").select(
        "payload_id", "seq", F.expr("match_seq is null").alias("added"), F.col("match_seq").alias("vision_seq"))


@query
def channel_union(spark, sf_dir):
    return J.merge_channels(_dom_boxes(spark, sf_dir), _vision(spark, sf_dir).select("payload_id", "seq", "box")).select(
        "payload_id", "source", "seq", "box.x", "box.y", "box.w", "box.h", "vision_confirmed")


def _fused(spark, sf_dir) -> DataFrame:
    boxes = _vision(spark, sf_dir)
    return J.fused_regions(
        _elements(spark, sf_dir), boxes.where("text is null"), boxes.where("text is not null"))


@query
def fused_regions(spark, sf_dir):
    return _fused(spark, sf_dir).select(
        "payload_id", "element_id", "sensitivity_type", "sensitivity_tier", "detection_source", "reason", "confidence",
        "vision_confirmed")


@query
def redaction_rects(spark, sf_dir):
    rows = _fused(spark, sf_dir).withColumn("render", F.expr("if(source = 'dom', 'pill', 'box')"))
    return J.redaction_rects(rows).select("payload_id", "element_id", "draw_x", "draw_y", "draw_w", "draw_h", "fully_covers")


# --- audit -----------------------------------------------------------------------------


@query
def string_leaves(spark, sf_dir):
    return A.string_leaves(_payloads(spark, sf_dir), ["payload_id"])


@query
def redaction_coverage(spark, sf_dir):
    return A.redaction_coverage(_payloads(spark, sf_dir))


def _violations(spark, sf_dir, strict_reference: bool = False) -> DataFrame:
    elements = _kept_elements(spark, sf_dir)
    return A.audit_violations(_payloads(spark, sf_dir, elements), _element_vault(elements), strict_reference)


@query
def audit_violations(spark, sf_dir):
    return _violations(spark, sf_dir)


@query
def audit_violations_strict(spark, sf_dir):
    """With the narrow token shape, issued tokens under a sensitive key are reported too."""
    found = _violations(spark, sf_dir, strict_reference=True)
    return found.groupBy("matched_type").agg(F.count("*").alias("n_violations"))


@query
def audit_verdicts(spark, sf_dir):
    return A.audit_verdicts(table(spark, sf_dir, "orders").selectExpr("o_orderkey as payload_id"), _violations(spark, sf_dir))


@query
def send_gate(spark, sf_dir):
    elements = _kept_elements(spark, sf_dir)
    payloads = _payloads(spark, sf_dir, elements)
    mismatches = J.channel_mismatches(elements, derived.regions(spark, sf_dir), ignore_vision_only=True)
    clean, held = A.send_gate(payloads, A.audit_violations(payloads, _element_vault(elements)), mismatches)
    return clean.select("payload_id", F.lit("send").alias("gate")).unionAll(held.select("payload_id", F.lit("hold").alias("gate")))


@query
def raw_value_leaks(spark, sf_dir):
    elements = _kept_elements(spark, sf_dir, "spans")
    sensitive = elements.where("sensitivity_tier in (1, 2)")
    raw = sensitive.select("payload_id", F.explode(F.expr("concat(array(raw_value), transform(spans, s -> s.match))")).alias("raw_value"))
    return A.raw_value_leaks(A.string_leaves(_payloads(spark, sf_dir, elements), ["payload_id"]), raw.where("raw_value is not null"))


def _decisions(spark, sf_dir) -> DataFrame:
    return derived.actions(spark, sf_dir).selectExpr(
        "concat('s', payload_id) as session_id", "cast(action_seq % 20 as int) as step_number", "reasoning_short as instruction",
        "named_struct('type', type, 'target_element_id', target_element_id, 'value', value, 'risk_tier', risk_tier) as action",
        "0.9D as confidence", "array(named_struct('element_id', target_element_id, 'confidence', 0.92D, 'method', 'dom_heuristic')) as payload_notes")


@query
def audit_records(spark, sf_dir):
    return A.audit_records(_decisions(spark, sf_dir)).select(
        "session_id", "step_number", "instruction_hash", "action.type", "action.target_element_id", "action.value",
        "action.risk_tier", "confidence")


@query
def region_rollup(spark, sf_dir):
    return A.region_rollup(_fused(spark, sf_dir))


@query
def region_types(spark, sf_dir):
    return A.region_types(_fused(spark, sf_dir))


@query
def risk_rollup(spark, sf_dir):
    return A.risk_rollup(derived.actions(spark, sf_dir))


@query
def latency_rollup(spark, sf_dir):
    metrics = table(spark, sf_dir, "events").selectExpr("event_type as name", "value as duration_ms")
    return A.latency_rollup(metrics)


@query
def newest_steps(spark, sf_dir):
    """The dashboard's top of the list: the 50 newest steps."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type").orderBy(
        F.desc("ts"), F.desc("event_id")).limit(50)


@query
def ordered_spans(spark, sf_dir):
    """Spans in splice order, last first, after overlaps are resolved."""
    rows = D.computed_once(derived.texts(spark, sf_dir), {"spans": f"reverse({D.resolved_spans_sql(D.spans_sql('text'))})"})
    return rows.select("doc_id", F.posexplode("spans").alias("pos", "s")).select("doc_id", "pos", "s.type", "s.start_idx", "s.end_idx")


# --- snapshots and origins ---------------------------------------------------------------


@query
def relinked_elements(spark, sf_dir):
    page = E.classify_dom(derived.raw_elements(spark, sf_dir)).selectExpr("payload_id", "element_id", "seq", "tag", "label_text as label")
    after = page.where("seq % 13 <> 0").selectExpr(
        "payload_id", "seq", "case seq % 5 when 0 then concat('new-', element_id) else element_id end as element_id",
        "if(seq % 7 = 0, 'span', tag) as tag", "if(seq % 7 < 2, concat(label, ' 2'), upper(label)) as label")
    return R.relink(page.drop("seq"), after)


def _by_origin(spark, sf_dir) -> DataFrame:
    return _elements(spark, sf_dir).withColumn("origin", F.expr("concat('https://shop', payload_id % 25, '.example.com')"))


def _confirmed(spark, sf_dir) -> DataFrame:
    # the order's own status stands for the user's answer: a finished one was approved
    answers = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey as payload_id")
    approved = derived.actions(spark, sf_dir).where("risk_tier = 'risky'").join(answers, "payload_id", "left_semi").selectExpr(
        "concat('https://shop', payload_id % 25, '.example.com') as origin", "payload_id", "target_element_id")
    return R.confirmed_labels(approved, _elements(spark, sf_dir))


@query
def confirmed_labels(spark, sf_dir):
    return _confirmed(spark, sf_dir)


@query
def origin_profiles(spark, sf_dir):
    return R.origin_profiles(_confirmed(spark, sf_dir)).select("origin", F.array_join("labels", "|").alias("labels"))


@query
def origin_boost(spark, sf_dir):
    return R.origin_boost(_by_origin(spark, sf_dir), _confirmed(spark, sf_dir)).select(
        "payload_id", "seq", "confidence", "origin_confirmed", "sensitivity_tier")


# --- sources and sinks -------------------------------------------------------------------


def _stored_payloads(spark, sf_dir) -> DataFrame:
    """Payload documents written as JSON lines and read back by the source."""
    path = shared_folder(spark, "payloads")
    _made_payloads(spark, sf_dir).write.json(path, compression="gzip")
    return sources_payloads.read_payloads(spark, path)


@query
def payload_elements(spark, sf_dir):
    tables = sources_payloads.payload_tables(_stored_payloads(spark, sf_dir))
    return tables["elements"].select(
        "payload_id", "pos", "element_id", "tag", "role", "is_sensitive", "semantic_token", "has_value",
        F.expr("bounding_box.x as x"), F.expr("bounding_box.h as h"))


@query
def payload_regions(spark, sf_dir):
    tables = sources_payloads.payload_tables(_stored_payloads(spark, sf_dir))
    return tables["regions"].select("payload_id", "pos", "element_id", "semantic_token")


@query
def audit_log(spark, sf_dir):
    """Audit records appended to the log in two batches and read back."""
    path = shared_folder(spark, "audit")
    records = A.audit_records(_decisions(spark, sf_dir))
    audit_sources.append_audit(records.where("step_number % 2 = 0"), path)
    audit_sources.append_audit(records.where("step_number % 2 = 1"), path)
    return audit_sources.read_audit(spark, path).groupBy("step_number", "action.type", "action.value").agg(
        F.count("*").alias("n_events"), F.count_distinct("instruction_hash").alias("n_instructions"))


@query
def audit_step_metrics(spark, sf_dir):
    """Dashboard step records written as JSON, read back, and taken apart into measures."""
    path = shared_folder(spark, "steps")
    table(spark, sf_dir, "events").selectExpr(
        "concat('s', user_id) as sessionId", "cast(event_id as int) as stepNumber", "unix_millis(cast(ts as timestamp)) as timestamp",
        "array(named_struct('name', 'agent:step:total', 'durationMs', value), named_struct('name', 'agent:step:vision-total', 'durationMs', value / 2)) as metrics",
        "array(named_struct('element_id', 'el', 'detection_source', if(event_id % 3 = 0, null, 'ocr_regex'))) as redactedRegions",
    ).write.json(path)
    steps = audit_sources.read_steps(spark, path)
    sources = audit_sources.step_regions(steps).groupBy("session_id").agg(
        F.count_if(F.col("detection_source") == "dom_heuristic").alias("n_dom"))
    metrics = audit_sources.step_metrics(steps).groupBy("session_id", "name").agg(
        F.count("*").alias("n"), F.max("duration_ms").alias("max_ms"))
    return metrics.join(sources, "session_id")


@query
def ocr_lines(spark, sf_dir):
    return vision_sources.ocr_lines(derived.ocr_pages(spark, sf_dir)).select(
        "payload_id", "seq", "pos", "text", "box.x", "box.y", "box.w", "box.h", "confidence")


@query
def face_rows(spark, sf_dir):
    return vision_sources.face_rows(table(spark, sf_dir, "lineitem").selectExpr(*derived.FACES)).select(
        "payload_id", "seq", "box.x", "box.y", "box.w", "box.h", "confidence")


@query
def html_elements(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr(*derived.FORM_PAGES)
    return E.classify_elements(html_sources.html_elements(pages)).select(
        "payload_id", "seq", "element_id", "tag", "label_text", "raw_value", "sensitivity_type")


@query
def page_failures(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr(*derived.NOTICE_PAGES)
    return html_sources.page_failures(pages).select("page_id", "verified", "failure_reason")


@query
def normalised_responses(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").selectExpr(*derived.RESPONSES)
    return sources_payloads.normalise_responses(raw).drop("raw_response")


# --- streams -----------------------------------------------------------------------------


def _unknown_fields(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Payload lines with fields that no schema knows, nested ones and broken lines, and what the audit finds in them."""
    path = shared_folder(spark, "unknown-fields")
    table(spark, sf_dir, "orders").selectExpr(f"({derived.UNKNOWN_LINES}) as value").write.text(path)
    # leaves, broken lines and both sides of the gate read them: they are parsed once
    lines = cut_lineage(sources_payloads.read_payloads(spark, path).select("payload_id", "line", "reject_reason"), "unknown-lines")
    leaves = A.string_leaves(lines.select("payload_id", "line"), ["payload_id"])
    none = spark.createDataFrame([], "token string")
    return lines, A.leaf_violations(leaves, none).unionByName(lines.where("reject_reason is not null").selectExpr(
        "payload_id", "'line' as path", "'broken' as reason", "reject_reason as matched_type"))


@query
def unknown_field_leaks(spark, sf_dir):
    _, found = _unknown_fields(spark, sf_dir)
    return found.groupBy("path", "matched_type").agg(F.count("*").alias("n_found"))


@query
def unknown_field_gate(spark, sf_dir):
    """Which of those lines may be sent; a broken one has a hash for an id, here -1."""
    lines, found = _unknown_fields(spark, sf_dir)
    clean, held = A.send_gate(lines.select("payload_id", "reject_reason"), found)
    shown = F.expr("if(reject_reason is null, payload_id, -1)").alias("payload_id")
    return clean.select(shown, F.lit("send").alias("gate")).unionAll(held.select(shown, F.lit("hold").alias("gate")))


def _finish(started, spark, folder: str, schema: str) -> DataFrame:
    started.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def _in_parts(spark, streams, columns: list[str], name: str, start: Callable, schema: str) -> DataFrame:
    """What a job with one checkpoint writes while its input arrives part by part."""
    folder = shared_folder(spark, name)
    for arriving in streams:
        rows = _finish(start(arriving.selectExpr(*columns), folder), spark, folder, schema)
    return rows


@query
def streamed_redaction(spark, sf_dir):
    folder = shared_folder(spark, "redaction")
    docs = derived.table_stream(spark, sf_dir, "documents").selectExpr("doc_id", "source as session_id", "text")
    rows = _finish(jobs.stream_redaction(docs, KEY, folder), spark, folder,
                   "doc_id bigint, redacted_text string, n_redacted int, residual int, outcome string")
    return rows.select("doc_id", F.sha2("redacted_text", 256).alias("redacted_sha"), "n_redacted", "outcome")


MICROS = "unix_micros(cast(ts as timestamp))"


@query
def streamed_rate_limit(spark, sf_dir):
    return _in_parts(
        spark, derived.arriving(spark, sf_dir, "events", MICROS), derived.REQUESTS, "rate",
        lambda asked, folder: jobs.stream_rate_limit(asked, "client", "at_us", folder, order=("event_id",), late="1 hour"),
        "event_id bigint, client string, at_us bigint, window_start bigint, request_no bigint, allowed boolean")


@query
def streamed_steps(spark, sf_dir):
    return _in_parts(
        spark, derived.arriving(spark, sf_dir, "conversations", "turn"), derived.STEPS, "steps", jobs.stream_steps,
        "session_id bigint, arrival bigint, step_number int, accepted boolean, expected_step int")


@query
def streamed_frames(spark, sf_dir):
    return _in_parts(
        spark, derived.arriving(spark, sf_dir, "events", MICROS), derived.FRAMES, "frames",
        lambda frames, folder: jobs.stream_frames(frames, folder, order=("event_id",)), "event_id bigint, session_id bigint, skipped boolean")


@query
def streamed_sessions(spark, sf_dir):
    """Vaults that expired within the log, and accesses behind the watermark; vaults still open at its end stay in state."""
    rows = _in_parts(
        spark, derived.arriving(spark, sf_dir, "events", MICROS, derived.DELAYED), derived.ACCESSES, "sessions",
        lambda accesses, folder: jobs.stream_sessions(accesses, folder, late="10 minutes"),
        "session_id bigint, opened bigint, last_access bigint, n_accesses bigint, outcome string")
    return rows.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("opened", "last_access")})


@query
def streamed_audit(spark, sf_dir):
    folder = shared_folder(spark, "audit-stream")
    decided = derived.table_stream(spark, sf_dir, "events").selectExpr(
        "concat('s', user_id) as session_id", "cast(event_id as int) as step_number", "event_type as instruction",
        "named_struct('type', 'type', 'value', props) as action", "0.9D as confidence", "cast(null as string) as payload_notes")
    jobs.stream_audit(A.audit_records(decided), folder).awaitTermination()
    return spark.read.schema("session_id string, step_number int, instruction_hash string, action struct<value:string>").json(
        f"{folder}/rows").select("session_id", "step_number", "instruction_hash", "action.value")


# --- SQL functions and detectors -----------------------------------------------------------


@query
def named_detectors(spark, sf_dir):
    """Two built-in detectors and one more pattern on the same texts."""
    registry.register_pattern("order_no", "ORDER_NO", r"(?<![A-Za-z0-9])[A-Z]{4}0[0-9]{6}(?![0-9])")
    return registry.detect_all(derived.texts(spark, sf_dir), ["EMAIL", "IFSC", "order_no"]).groupBy("detector", "type").agg(
        F.count("*").alias("n_spans"))


@query
def sql_functions(spark, sf_dir):
    registry.register_sql_functions(spark)
    derived.texts(spark, sf_dir).createOrReplaceTempView("veilgrid_texts")
    return spark.sql("""SELECT t.session_id, m.type, sensitivity_tier(m.type) AS tier, count(*) AS n_spans
        FROM veilgrid_texts t, LATERAL pii_matches(t.text) m GROUP BY t.session_id, m.type""")


@query
def tier_2_switch(spark, sf_dir):
    """Painted regions per tier with tier 2 redaction switched off."""
    rows = _fused(spark, sf_dir).withColumn("render", F.expr("if(source = 'dom', 'pill', 'box')"))
    return J.redaction_rects(rows, redact_tier_2=False).groupBy("sensitivity_tier").agg(F.count("*").alias("n_painted"))
