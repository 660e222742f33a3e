"""Re-linking of snapshots and memory of confirmed labels per origin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.functions.classify import trim_sql


def relink(before: DataFrame, after: DataFrame, order: str = "seq") -> DataFrame:
    """Find each perceived element again: ``resolved_id`` and ``reindexed``.

    ``before`` and ``after``: payload_id, element_id, tag, label; ``after`` also has its
    document ``order``, by which the first of several equal ids is the direct hit. A direct hit holds unless
    both tag and label differ; then, or without a hit, a unique element with the wanted tag
    and label does. No match and several matches stay unresolved.
    """
    def norm(df: DataFrame) -> DataFrame:
        return df.withColumns({
            "_tag": F.lower(F.coalesce("tag", F.lit(""))), "_label": F.lower(F.expr(trim_sql("coalesce(label, '')")))})

    wanted, current = norm(before), norm(after)
    seen = F.struct(F.col("_tag").alias("_tag2"), F.col("_label").alias("_label2"))
    direct = current.groupBy("payload_id", "element_id").agg(F.min_by(seen, order).alias("_hit"))
    unique = current.groupBy("payload_id", "_tag", "_label").agg(
        F.min("element_id").alias("_other"), F.count("*").alias("_n")
    ).where("_n = 1 and _label <> ''").drop("_n")
    linked = wanted.join(direct, ["payload_id", "element_id"], "left").withColumn(
        "_ok", F.expr("_hit is not null and (_hit._tag2 = _tag or _hit._label2 = _label)"))
    return linked.join(unique, ["payload_id", "_tag", "_label"], "left").select(
        "payload_id", "element_id",
        F.expr("if(_ok, element_id, _other)").alias("resolved_id"),
        F.expr("not _ok and _other is not null").alias("reindexed"))


def confirmed_labels(approved: DataFrame, elements: DataFrame) -> DataFrame:
    """Labels of sensitive elements on which the user approved an action: ``origin, label``.

    ``approved``: origin, payload_id, target_element_id.
    """
    targets = elements.where("is_sensitive and coalesce(label_text, '') <> ''").selectExpr(
        "payload_id", "element_id as target_element_id", "label_text as label")
    return approved.join(targets, ["payload_id", "target_element_id"]).select("origin", "label").distinct()


def origin_profiles(labels: DataFrame) -> DataFrame:
    """Set of labels per origin; blank origins and labels are left out.

    Distinct pairs come first, so a hot origin sends each label once per task.
    """
    pairs = labels.where("coalesce(origin, '') <> '' and coalesce(label, '') <> ''").select("origin", "label").distinct()
    return pairs.groupBy("origin").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def origin_boost(elements: DataFrame, labels: DataFrame) -> DataFrame:
    """Raise the confidence of sensitive elements whose label the origin has confirmed.

    Nothing else changes: neither tier nor type nor sensitivity.
    """
    known = labels.selectExpr("origin", "label as label_text").distinct().withColumn("_known", F.lit(True))
    return elements.join(known, ["origin", "label_text"], "left").withColumn(
        "origin_confirmed", F.expr("is_sensitive and _known is not null")
    ).withColumn(
        "confidence", F.expr("if(origin_confirmed, least(confidence + 0.15D, 0.99D), confidence)")
    ).drop("_known")
