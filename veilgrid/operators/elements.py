"""Element table operators: labels, classification, fusion with detected spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import classify as C
from veilgrid.functions import detect as D
from veilgrid.functions import tiers as T

RAW_TEXT_COLUMNS = (
    "dom_id", "ext_id", "tag", "type", "autocomplete", "placeholder", "aria_label", "role", "own_label",
    "for_label", "parent_label", "sibling_text", "inner_text", "text_content", "value",
)


def with_raw_columns(raw: DataFrame) -> DataFrame:
    """Add the raw columns that a source does not have, as nulls."""
    missing = {c: F.lit(None).cast("string") for c in RAW_TEXT_COLUMNS if c not in raw.columns}
    return raw.withColumns(missing) if missing else raw


def attach_for_labels(raw: DataFrame, labels: DataFrame) -> DataFrame:
    """Join the first label whose ``for_id`` names the element of the same payload.

    ``labels``: payload_id, for_id, label_seq, label_text. Labels are reduced to one row
    per target before the join, so that a repeated label cannot multiply elements.
    """
    first = (
        labels.where("coalesce(for_id, '') <> ''")
        .groupBy("payload_id", F.col("for_id").alias("dom_id"))
        .agg(F.min_by("label_text", "label_seq").alias("for_label"))
    )
    return raw.drop("for_label").join(first, ["payload_id", "dom_id"], "left")


def classify_dom(raw: DataFrame, identity: tuple[str, ...] = ("payload_id", "seq")) -> DataFrame:
    """Ids, labels, roles, values and the sensitivity type that attributes give."""
    # in steps of their own, so that no compiled method is too long for the JVM's own compiler
    named = D.computed_once(with_raw_columns(raw).withColumn("is_button", F.expr(C.IS_BUTTON)), {"nearby_label": C.LABEL})
    named = D.computed_once(named, {"element_id": C.element_id_sql(*identity), "raw_value": C.RAW_VALUE})
    typed = D.computed_once(named, {"dom_type": C.dom_type_sql("nearby_label", "is_button")})
    return typed.withColumns({
        "tag": F.expr("case when is_button then 'button' else lower(coalesce(tag, '')) end"),
        "role": F.expr(f"case when is_button then 'button' else {C.ROLE} end"),
        "label_text": F.expr(
            f"case when is_button then {C.BUTTON_LABEL} when dom_type = 'AMOUNT'"
            f" then coalesce(nearby_label, nullif({C.ELEMENT_TEXT}, '')) else nearby_label end"
        ),
        "has_value": F.expr(f"{C.nonblank_sql('raw_value')} is not null"),
    }).drop("nearby_label")


def classify_elements(raw: DataFrame, identity: tuple[str, ...] = ("payload_id", "seq")) -> DataFrame:
    """Full classification, row by row: no shuffle, no Python."""
    spans = D.computed_once(classify_dom(raw, identity), {"spans": D.spans_sql(C.SCAN_TEXT)})
    fused = D.computed_once(spans.withColumn("pii_type", D.top_type("spans")), {
        "sensitivity_type": T.fused_type_sql("dom_type", "pii_type"),
        "source": T.fused_source_sql("dom_type", "pii_type"),
    }).withColumns({
        "type_mismatch": F.expr(T.type_mismatch_sql("dom_type", "pii_type")),
        "confidence": F.expr(T.base_confidence_sql("dom_type", "spans")),
        "method": F.expr(T.method_sql("dom_type", "spans")),
        "sensitivity_tier": F.expr(D.tier_sql("sensitivity_type")),
    })
    return fused.withColumns({
        "is_sensitive": F.expr("sensitivity_tier <> 3"),
        "reason": F.expr(T.reason_sql("source", "sensitivity_type", "label_text")),
    })


def deceptive_labels(raw: DataFrame) -> DataFrame:
    """Elements whose accessible label names a dangerous action that the visible text hides."""
    return with_raw_columns(raw).where(C.DECEPTIVE_LABEL)


def box() -> Column:
    return F.struct("x", "y", "w", "h")
