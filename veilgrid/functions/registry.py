"""Named detectors, and the detection functions for SQL users."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.functions import detect as D
from veilgrid.functions import tiers as T
from veilgrid.functions import tokens as K

Detector = Callable[[str], Column]

_DETECTORS: dict[str, Detector] = {"builtin": D.detect}
_DETECTORS.update({kind: (lambda text, kind=kind: D.detect_type(text, kind)) for kind in D.SPANS_BY_TYPE})


def register_detector(name: str, detector: Detector) -> None:
    """Add a detector: a function from a text column's name to an array of span structs.

    It may build any Column, a pandas UDF included.
    """
    _DETECTORS[name] = detector


def register_pattern(name: str, kind: str, pattern: str) -> None:
    """Add a detector for one more pattern."""
    register_detector(name, lambda text: F.expr(D.pattern_spans_sql(text, kind, pattern, f"{text} is not null")))


def detector(name: str) -> Detector:
    return _DETECTORS[name]


def detect_all(rows: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """Spans of several detectors as rows: the other columns, detector, type, match, start_idx, end_idx."""
    keep = [c for c in rows.columns if c != text]
    runs = F.array(*[
        F.struct(F.lit(n).alias("detector"), _DETECTORS[n](text).cast(f"array<{D.SPAN_TYPE}>").alias("spans")) for n in names
    ])
    each = rows.select(*keep, F.explode(runs).alias("d"))
    return each.select(*keep, "d.detector", F.explode_outer("d.spans").alias("s")).where("s is not null").select(
        *keep, "detector", "s.*")


SQL_FUNCTIONS = {
    "pii_spans": ("text STRING", f"array<{D.SPAN_TYPE}>", D.spans_sql("text")),
    "pii_top_type": ("text STRING", "string", D.let("s", D.spans_sql("text"), D.top_type_sql("s"))),
    "pii_value_guard": ("value STRING", "string", D.value_guard_sql("value")),
    "sensitivity_tier": ("kind STRING", "int", D.tier_sql("kind")),
    "confidence_badge": ("confidence DOUBLE", "string", T.badge_sql("confidence")),
    "needs_credentials": ("text STRING", "boolean", K.needs_credentials_sql("text")),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Make the detection functions callable from SQL; ``pii_matches`` is a table function."""
    for name, (parameters, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION pii_matches(text STRING) RETURNS TABLE"
        "(type STRING, match STRING, start_idx INT, end_idx INT) RETURN"
        f" SELECT s.type, s.match, s.start_idx, s.end_idx FROM (SELECT explode({D.spans_sql('text')}) AS s)")
    return [*SQL_FUNCTIONS, "pii_matches"]
