"""Agent actions: contracts, risk, confirmation and executability against page data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import detect as D
from veilgrid.functions import tiers as T


def unique_elements(elements: DataFrame, columns: tuple[str, ...], order: str = "seq") -> DataFrame:
    """One row per (payload_id, element_id): the first in order, as a lookup by id finds it."""
    return (
        elements.groupBy("payload_id", "element_id")
        .agg(F.min_by(F.struct(*columns), order).alias("_e"))
        .select("payload_id", "element_id", *[F.col(f"_e.{c}").alias(c) for c in columns])
    )


def attach_targets(actions: DataFrame, elements: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Left join of every action to its target element; ``found`` tells whether there is one."""
    targets = unique_elements(elements, columns).withColumnRenamed("element_id", "target_element_id")
    return (
        actions.join(targets.withColumn("_hit", F.lit(True)), ["payload_id", "target_element_id"], "left")
        .withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")
    )


def hallucinated_targets(actions: DataFrame, elements: DataFrame) -> DataFrame:
    """Actions on an element id that their payload does not have."""
    ids = elements.selectExpr("payload_id", "element_id as target_element_id")
    return actions.where("coalesce(target_element_id, '') <> ''").join(
        ids, ["payload_id", "target_element_id"], "left_anti"
    )


def policy_risk(targeted: DataFrame) -> DataFrame:
    """Replace the stated risk tier by the authoritative one (after :func:`attach_targets`)."""
    return targeted.withColumn("policy_risk", F.expr(
        T.policy_risk_sql("type", "risk_tier", "reasoning_short", "is_sensitive", "label_text")))


def client_risk(actions: DataFrame) -> DataFrame:
    return actions.withColumn("client_risk", F.expr(
        T.client_risk_sql("risk_tier", "sensitivity_tier", "target_element_id", "value")))


def needs_confirmation(targeted: DataFrame) -> DataFrame:
    return targeted.withColumn("needs_confirmation", F.expr(T.needs_confirmation_sql(
        "type", "risk_tier", "target_element_id", "found", "input_type", "text_content")))


def executability(targeted: DataFrame, vault: DataFrame, session: str = "session_id") -> DataFrame:
    """``status`` of each action: ok or the first reason it cannot be carried out."""
    tokens = vault.selectExpr(f"session_id as {session}", "token as value").distinct().withColumn("_known", F.lit(True))
    return targeted.join(tokens, [session, "value"], "left").withColumn("status", F.expr(
        T.executability_sql("type", "found", "interactable", "value", "coalesce(_known, false)"))).drop("_known")


def guarded_actions(actions: DataFrame) -> DataFrame:
    """Type actions whose value shows raw personal data, with the reject reason."""
    return D.computed_once(actions, {
        "violated_type": f"case when type = 'type' then {D.value_guard_sql('value')} end"
    }).where("violated_type is not null").withColumn("reject_reason", F.format_string(
        "Rejected: value field matched raw %s shape, not a valid token", F.col("violated_type")))
