"""The decision chain of a request: limits, contract, continuity, the model's answers, risk, history and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import detect as D
from veilgrid.functions import tiers as T
from veilgrid.functions import values as V
from veilgrid.operators import folds
from veilgrid.operators.ordered import fold_by_bucket
from veilgrid.operators.policy import attach_targets
from veilgrid.operators.validate import check_actions
from veilgrid.session import cut_lineage

#: Verdicts, and what the audit says of a request that was handled without an answer.
ERRORS = {
    "continuity_broken": "Session continuity broken (fresh UUID mid-task)", "model_rate_limited": "Rate limit exceeded (429)",
    "api_failure": "API Failure", "no_valid_action": "Failed to generate valid action",
}


def judged_answers(answers: DataFrame, elements: DataFrame) -> DataFrame:
    """``status`` and ``policy_risk`` of each answer of a model.

    ``answers``: request_id, attempt, type, target_element_id, value, risk_tier, reasoning_short, error (``rate_limited``,
    ``api_failure`` or null). Status: the error; ``invalid`` for a broken contract or a target that the page does not
    have; ``raw_value`` with ``raw_type`` for a typed value that shows personal data; else ``ok``.
    """
    page = elements.withColumnRenamed("request_id", "payload_id")
    targeted = attach_targets(check_actions(answers.withColumnRenamed("request_id", "payload_id")), page, ("label_text", "is_sensitive"))
    guarded = D.computed_once(targeted, {"raw_type": f"case when type = 'type' then {D.value_guard_sql('value')} end"})
    return guarded.withColumnRenamed("payload_id", "request_id").withColumn("status", F.expr("""case
        when error = 'rate_limited' then 'model_rate_limited' when error is not null then 'api_failure'
        when size(reject_reasons) > 0 or (coalesce(target_element_id, '') <> '' and not found) then 'invalid'
        when raw_type is not null then 'raw_value' else 'ok' end""")).withColumn(
        "policy_risk", F.expr(T.policy_risk_sql("type", "risk_tier", "reasoning_short", "is_sensitive", "label_text")))


def analyzed_requests(
    requests: DataFrame, answers: DataFrame, elements: DataFrame, *, retries: int = V.MAX_RETRIES, block: int = 200_000,
) -> DataFrame:
    """``requests`` with ``verdict``, ``status_code``, the action that goes back, and the audit record of those that were handled.

    ``requests``: request_id, session_id, arrival, step_number, instruction, allowed (by the rate limit) and
    reject_reason (of the payload's contract, or null). A request goes through the checks in this order:

    1. Not allowed: ``rate_limited``; a broken contract: ``invalid_payload``. Neither is handled: no audit, no history.
    2. A later step of a session without history: ``continuity_broken``.
    3. Answers in the order of attempts, ``retries`` at most. Invalid ones are passed over, an error or a raw value ends the
       request. A valid one is taken if the step follows the last one of the history; otherwise the history refuses
       it, and the next answer is looked at. Without a taken one: ``no_valid_action``.
    4. The step enters the history only when its answer is taken, so ``in_history`` is true for ``ok`` alone.

    The answers of a request are settled by one aggregation; the history is one fold per session, cut into blocks of
    ``arrival``. Nothing of a session meets in one task but a block and its summaries.
    """
    judged = judged_answers(answers.where(F.col("attempt") < retries), elements).where("status <> 'invalid'")
    taken = F.struct("attempt", "type", "target_element_id", "value", "policy_risk", "reasoning_short")
    ended = F.struct("attempt", "status", "raw_type")
    settled = judged.groupBy("request_id").agg(
        F.min(F.when(F.col("status") == "ok", taken)).alias("_ok"), F.min(F.when(F.col("status") != "ok", ended)).alias("_end"))
    asked = requests.join(settled, "request_id", "left").withColumn("_handled", F.expr("allowed and reject_reason is null")).withColumn(
        "_answered", F.expr("_handled and _ok is not null and (_end is null or _ok.attempt < _end.attempt)"))
    asked = cut_lineage(asked.withColumn("_bucket", F.floor(F.col("arrival") / block).cast("bigint")), "asked")
    chained, _ = fold_by_bucket(
        asked, ["session_id"], "_bucket", ["arrival"], ["step_number", "_answered", "_handled"], folds.RequestChain(),
        "in_history boolean, continuity_break boolean")
    verdict = F.expr("""case when not allowed then 'rate_limited' when reject_reason is not null then 'invalid_payload'
        when continuity_break then 'continuity_broken' when in_history then 'ok' when _end is not null then _end.status else 'no_valid_action' end""")
    errors = "case verdict " + " ".join(f"when '{k}' then '{v}'" for k, v in ERRORS.items()) + """ when 'raw_value' then
        concat('Rejected: value field matched raw ', _end.raw_type, ' shape, not a valid token') end"""
    code = "case verdict when 'ok' then 200 when 'rate_limited' then 429 when 'model_rate_limited' then 429 when 'invalid_payload' then 422" \
           " when 'raw_value' then 422 when 'continuity_broken' then 400 else 500 end"
    out = chained.withColumn("verdict", verdict).withColumn("_said", F.expr("if(in_history, _ok, null)"))
    return out.select(
        *requests.columns, "verdict", "in_history", F.expr(code).alias("status_code"),
        F.expr("""if(in_history, named_struct('type', _said.type, 'target_element_id', _said.target_element_id, 'value', _said.value,
            'risk_tier', _said.policy_risk, 'reasoning_short', _said.reasoning_short), null)""").alias("action"),
        F.expr(f"""if(_handled, named_struct('session_id', session_id, 'step_number', step_number, 'instruction_hash', sha2(coalesce(instruction, ''), 256),
            'action', named_struct('type', _said.type, 'target_element_id', _said.target_element_id, 'value', if(in_history, '[REDACTED]', null),
            'risk_tier', _said.policy_risk, 'error', {errors}), 'confidence', if(in_history, 0.9D, 0D)), null)""").alias("audit"))


def audit_events(analyzed: DataFrame) -> DataFrame:
    """The audit rows of :func:`analyzed_requests`: one for each handled request."""
    return analyzed.where("audit is not null").select("request_id", "audit.*")
