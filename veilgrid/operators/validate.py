"""Contracts as predicates: every row gets the reasons for which it must be rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import values as V
from veilgrid.functions.detect import in_list


def _reasons(rules: dict[str, str]) -> Column:
    """Array of the names of all broken rules, in order."""
    whens = ", ".join(f"if({rule}, '{name}', null)" for name, rule in rules.items())
    return F.expr(f"array_compact(array({whens}))")


SENSITIVE_WITHOUT_TOKEN = (
    "coalesce({e}.is_sensitive, false) and coalesce({e}.has_value, false) and coalesce({e}.semantic_token, '') = ''"
)

PAYLOAD_RULES = {
    "session_id_missing": "session_id is null",
    "task_instruction_length": f"task_instruction is null or length(task_instruction) not between 1 and {V.MAX_INSTRUCTION}",
    "step_number_missing": "step_number is null",
    "dom_summary_missing": "dom_summary is null or dom_summary.url is null or dom_summary.elements is null",
    "too_many_elements": f"coalesce(size(dom_summary.elements), 0) > {V.MAX_ELEMENTS}",
    "image_too_large": f"coalesce(length(redacted_image_base64), 0) > {V.MAX_IMAGE}",
    "too_many_notes": f"coalesce(size(detection_confidence_notes), 0) > {V.MAX_NOTES}",
    "last_action_error_length": f"coalesce(length(last_action_error), 0) > {V.MAX_ERROR}",
    "element_field_missing": (
        "exists(dom_summary.elements, e -> coalesce(e.element_id is null or e.tag is null or e.role is null"
        " or e.is_sensitive is null or e.bounding_box is null or e.bounding_box.x is null or e.bounding_box.y is null"
        " or e.bounding_box.w is null or e.bounding_box.h is null, true))"
    ),
    "sensitivity_tier_value": "exists(dom_summary.elements, e -> coalesce(e.sensitivity_tier not in (1, 2, 3), false))",
    "sensitivity_type_value": (
        "exists(dom_summary.elements, e -> coalesce(not " + in_list("e.sensitivity_type", V.SENSITIVITY_TYPES) + ", false))"
    ),
    "confidence_range": (
        "exists(detection_confidence_notes, n -> coalesce(n.confidence is null or n.confidence < 0 or n.confidence > 1, true))"
    ),
    "note_without_element": "exists(detection_confidence_notes, n -> coalesce(n.element_id is null, true))",
    "method_value": (
        "exists(detection_confidence_notes, n -> not coalesce(" + in_list("n.method", V.DETECTION_METHODS) + ", false))"
    ),
    "sensitive_without_token": (
        "exists(dom_summary.elements, e -> " + SENSITIVE_WITHOUT_TOKEN.format(e="e") + ")"
    ),
}

ACTION_RULES = {
    "type_value": "not coalesce(" + in_list("type", V.ACTION_TYPES) + ", false)",
    "risk_tier_value": "not coalesce(" + in_list("risk_tier", V.RISK_TIERS) + ", false)",
    "reasoning_missing": "reasoning_short is null",
    "target_missing": "type in ('click', 'type') and coalesce(target_element_id, '') = ''",
    "value_missing": "type = 'type' and value is null",
}


def check_payloads(payloads: DataFrame) -> DataFrame:
    """Add ``reject_reasons``. Oversized payloads are rejected whole, never cut."""
    rules = {name: f"coalesce({rule}, false)" for name, rule in PAYLOAD_RULES.items()}
    return payloads.withColumn("reject_reasons", _reasons(rules))


def check_actions(actions: DataFrame) -> DataFrame:
    return actions.withColumn("reject_reasons", _reasons(ACTION_RULES))


def check_sensitive_tokens(elements: DataFrame) -> DataFrame:
    """Sensitive elements that hold a value but no token."""
    flat = elements.withColumn("_e", F.struct("is_sensitive", "has_value", "semantic_token"))
    return flat.where(SENSITIVE_WITHOUT_TOKEN.format(e="_e")).drop("_e")


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their reasons."""
    return (
        checked.where("size(reject_reasons) = 0").drop("reject_reasons"),
        checked.where("size(reject_reasons) > 0"),
    )


def pair_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Left join of requests to the response that carries the next step of their session.

    ``responses`` has session_id, step_number and columns of its own; a request without a
    partner keeps nulls and ``paired`` false.
    """
    numbered = (
        responses.withColumn("_step", F.col("step_number") - 1)
        .withColumnRenamed("step_number", "response_step").withColumn("_hit", F.lit(True))
    )
    asked = requests.withColumn("_step", F.col("step_number"))
    return (
        asked.join(numbered, ["session_id", "_step"], "left")
        .withColumn("paired", F.coalesce("_hit", F.lit(False))).drop("_step", "_hit")
    )


def check_responses(pairs: DataFrame) -> DataFrame:
    """First failing reason per response: ``expected_session``, ``expected_step`` against its own fields."""
    return pairs.withColumn("reject_reason", F.expr(
        "case when not coalesce(has_response, false) then 'Invalid response'"
        " when not (session_id <=> expected_session) then 'Session mismatch'"
        " when not (step_number <=> expected_step + 1) then 'Step mismatch'"
        " when not coalesce(has_action, false) then 'Missing action'"
        f" when not coalesce({in_list('type', V.ACTION_TYPES)}, false) then 'Invalid action type'"
        f" when not coalesce({in_list('risk_tier', V.RISK_TIERS)}, false) then 'Invalid risk tier' end"
    ))
