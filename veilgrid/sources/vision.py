"""Detections of the vision channel as rows: recognised text lines and faces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.functions.classify import trim_sql

OCR_BLOCKS = (
    "array<struct<paragraphs:array<struct<lines:array<struct<text:string,"
    "bbox:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double>>>>>>"
)


def _pixel(expr: str) -> str:
    """Rounded half up and never below zero."""
    return f"cast(greatest(floor(coalesce({expr}, 0) + 0.5D), 0) as int)"


def ocr_lines(pages: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Lines of a block, paragraph, line hierarchy; blank lines are dropped.

    Keeps all other columns and adds pos, text, box and confidence (0 to 1).
    """
    nested = f"flatten(flatten(transform({blocks}, b -> transform(b.paragraphs, p -> coalesce(p.lines, array())))))"
    keep = [c for c in pages.columns if c != blocks]
    lines = pages.select(*keep, F.posexplode(F.expr(nested)).alias("pos", "l"))
    return lines.select(
        *keep, "pos", F.expr(trim_sql("l.text")).alias("text"),
        F.struct(
            F.expr(_pixel("l.bbox.x0")).alias("x"), F.expr(_pixel("l.bbox.y0")).alias("y"),
            F.expr(_pixel("l.bbox.x1 - l.bbox.x0")).alias("w"), F.expr(_pixel("l.bbox.y1 - l.bbox.y0")).alias("h"),
        ).alias("box"),
        F.expr("coalesce(l.confidence / 100, 0.5D)").alias("confidence"),
    ).where("text <> ''")


def face_rows(detections: DataFrame) -> DataFrame:
    """Faces with whole pixel boxes; a face without width or height is dropped.

    ``detections``: origin_x, origin_y, width, height, score and any other columns.
    """
    keep = [c for c in detections.columns if c not in ("origin_x", "origin_y", "width", "height", "score")]
    return detections.select(
        *keep,
        F.struct(
            F.expr(_pixel("origin_x")).alias("x"), F.expr(_pixel("origin_y")).alias("y"),
            F.expr("cast(floor(coalesce(width, 0) + 0.5D) as int)").alias("w"),
            F.expr("cast(floor(coalesce(height, 0) + 0.5D) as int)").alias("h"),
        ).alias("box"),
        F.coalesce("score", F.lit(0.0)).alias("confidence"),
    ).where("box.w > 0 and box.h > 0")
