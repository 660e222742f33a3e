"""Leak audit of outgoing payloads, audit records and the audit roll-up."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgrid.functions import detect as D
from veilgrid.functions import tokens as K
from veilgrid.functions import values as V
from veilgrid.functions.classify import trim_sql
from veilgrid.functions.detect import raw
from veilgrid.session import cut_lineage

LEAF = "array<struct<path:string,value:string>>"
IMAGE_PATH = "redacted_image_base64"
VALUE_BLOCK = 200  # sensitive values of one payload that a single row may hold


Nested = tuple[str, T.DataType, str, str]  # a list or map: expression, type, path and whether a word is in the path


def _split_leaves(expr: str, kind: T.DataType, path: str, named: str, words: tuple[str, ...]) -> tuple[list[str], list[str], list[Nested]]:
    """What lies below ``expr``: leaves of its strings, arrays of leaves of its variants, and its lists and maps."""
    if isinstance(kind, T.StructType):
        found = [
            _split_leaves(f"{expr}.{_quoted(f.name)}", f.dataType, f"concat({path}, {_literal('.' + f.name)})", _named_below(named, f.name, words), words)
            for f in kind.fields]
        return sum((x[0] for x in found), []), sum((x[1] for x in found), []), sum((x[2] for x in found), [])
    _check_kind(kind)
    return (
        [f"named_struct('path', {path}, 'value', {expr}, 'named', {named})"] if isinstance(kind, T.StringType) else [],
        [_variant_leaves_sql(expr, path)] if isinstance(kind, T.VariantType) else [],
        [(expr, kind, path, named)] if isinstance(kind, (T.ArrayType, T.MapType)) else [])


def _named_sql(text: str, words: tuple[str, ...]) -> str:
    return "(" + (" or ".join(f"contains(lower({text}), {_literal(w)})" for w in words) or "false") + ")"


def _named_below(named: str, name: str, words: tuple[str, ...]) -> str:
    """``named`` once a field's name follows: no word goes over the mark between two names."""
    return "true" if any(w in name.lower() for w in words) else named


def _check_kind(kind: T.DataType) -> None:
    """Raises for a type, at any depth, that the audit does not know."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            _check_kind(f.dataType)
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        _check_kind(kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType)
    elif not isinstance(kind, (T.StringType, T.VariantType, T.NumericType, T.BooleanType, T.DatetimeType, T.NullType, T.BinaryType, T.AnsiIntervalType)):
        raise TypeError(f"the audit cannot look into {kind.simpleString()}")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _leaf_parts(rows: DataFrame, key: list[str], fields: list[Nested], words: tuple[str, ...]) -> list[DataFrame]:
    """Leaves of ``fields`` of ``rows``: those outside lists and maps, then a part for each list and map.

    Generators compile; a walk by functions of lists would be interpreted, leaf by leaf.
    """
    found = [_split_leaves(*f, words) for f in fields]
    strings, variants, nested = (sum((x[i] for x in found), []) for i in range(3))
    names, parts = [_quoted(k) for k in key], []
    if strings:
        parts.append(rows.selectExpr(*names, f"inline(array({', '.join(strings)})) as (path, value, named)").where("value is not null"))
    for leaves in variants:
        walked = rows.selectExpr(*names, f"inline({leaves}) as (path, value)").where("value is not null")
        parts.append(walked.selectExpr(*names, "path", "value", f"{_named_sql('path', words)} as named"))
    at, item, below, seen = (next(n for i in range(len(key) + 1) if (n := f"_{name}{i or ''}") not in key) for name in ("at", "item", "below", "seen"))
    for expr, kind, path, named in nested:
        if isinstance(kind, T.ArrayType):
            inner, opened, step, known = kind.elementType, "posexplode", f"concat({below}, '[', {at}, ']')", named
        else:
            inner, opened, step = kind.valueType, "explode", f"concat({below}, '.', cast({at} as string))"
            known = named if named == "true" else f"({seen} or {_named_sql(f'cast({at} as string)', words)})"
        rest = rows.selectExpr(*names, f"{path} as {below}", f"{named} as {seen}", f"{opened}({expr}) as ({at}, {item})")
        parts += _leaf_parts(rest, key, [(item, inner, step, known if known in ("true", "false") else known if known != named else seen)], words)
    return parts


def _variant_leaves_sql(expr: str, path: str) -> str:
    """Every string at any depth of a variant with its whole path, taken apart level by level, as deep as the row's own value is.

    What is neither object nor array is marked a leaf when it is first looked at, and not looked into again.
    """
    node = "named_struct('path', {}, 'v', {}, 'leaf', {})"
    entry, item = (node.format(f"concat(l.path, {at})", v, "false") for at, v in (("'.', e.key", "e.value"), ("'[', j, ']'", "x")))
    level = f"""flatten(transform(found, l -> if(l.leaf, array(l), coalesce(
        transform(map_entries(try_cast(l.v as map<string, variant>)), e -> {entry}),
        transform(try_cast(l.v as array<variant>), (x, j) -> {item}), array({node.format("l.path", "l.v", "true")})))))"""
    literal, other = raw(r'"(?:[^"\\]|\\.)*+"'), raw(r"[^\[\]{}]+")
    brackets = f"split(regexp_replace(regexp_replace(to_json({expr}), {literal}, ''), {other}, ''), '')"
    depth = f"""aggregate({brackets}, named_struct('now', 0, 'most', 0), (a, c) -> if(c in ('[', '{{'),
        named_struct('now', a.now + 1, 'most', greatest(a.most, a.now + 1)), named_struct('now', a.now - if(c = '', 0, 1), 'most', a.most)), a -> a.most)"""
    levels = D.let("deep", depth, "if(deep = 0, cast(array() as array<int>), sequence(1, deep))")
    walked = f"aggregate({levels}, array({node.format(path, expr, "false")}), (found, i) -> {level})"
    strings = f"filter({walked}, l -> schema_of_variant(l.v) = 'STRING')"
    leaves = f"transform({strings}, l -> named_struct('path', l.path, 'value', variant_get(l.v, '$', 'string')))"
    return f"if({expr} is null, cast(array() as {LEAF}), {leaves})"


def string_leaves(df: DataFrame, key: list[str], words: tuple[str, ...] = ()) -> DataFrame:
    """Every non-null string of every row with its path (``a.b[0].c``): key columns, path, value.

    With ``words`` (lower-case letters and ``_``) also ``named``: whether one of them stands in the path, in any case. Lists and maps are opened
    row by row, each in a part of its own, so ``df`` is read once for each of them: write what is dear to make.
    """
    fields = [(_quoted(f.name), f.dataType, _literal(f.name), _named_below("false", f.name, words)) for f in df.schema.fields if f.name not in key]
    parts = _leaf_parts(df, key, fields, words) or [
        df.selectExpr(*[_quoted(k) for k in key], f"inline(cast(array() as {LEAF})) as (path, value)").withColumn("named", F.lit(False))]
    leaves = functools.reduce(DataFrame.unionAll, parts)
    return leaves if words else leaves.drop("named")


REQUIRED = (
    "coalesce(size(filter(dom_summary.elements, e -> e.is_sensitive and e.sensitivity_tier in (1, 2))), 0)"
)


def redaction_coverage(payloads: DataFrame) -> DataFrame:
    """Sensitive tier 1 and 2 elements against regions, per payload."""
    return payloads.select(
        "payload_id", F.expr(REQUIRED).alias("n_required"),
        F.expr("coalesce(size(redacted_regions), 0)").alias("n_regions"),
    ).withColumn("redaction_missing", F.expr("n_required > 0 and n_regions < n_required"))


def _violation(path: str, reason: str, kind: str) -> str:
    return f"named_struct('path', {path}, 'reason', '{reason}', 'matched_type', {kind})"


def payload_violations(payloads: DataFrame) -> DataFrame:
    """Rules on the payload as a whole; they hold only where the image is present."""
    image = f"`{IMAGE_PATH}`"
    box = "r.bounding_box"
    invalid = f"r is null or {box} is null or {box}.x is null or {box}.y is null or {box}.w is null or {box}.h is null"
    short = _violation(f"'{IMAGE_PATH}'", "redacted_image_base64 is suspiciously short or malformed", "'IMAGE_DATA_WARNING'")
    missing = _violation(
        "'redacted_regions'", "redacted_regions count does not cover all tier 1/2 sensitive elements", "'REDACTION_MISSING'")
    bad = _violation("concat('redacted_regions[', i, ']')", "Invalid bounding_box in redacted_regions", "'INVALID_BOUNDING_BOX'")
    return payloads.where(f"{image} is not null").select("payload_id", F.expr(f"""inline(concat(
        if(length({image}) < {V.MIN_IMAGE}, array({short}), array()),
        if({REQUIRED} > 0 and {REQUIRED} > coalesce(size(redacted_regions), 0), array({missing}), array()),
        array_compact(transform(coalesce(redacted_regions, array()), (r, i) -> if({invalid}, {bad}, null)))))"""))


def leaf_violations(
    leaves: DataFrame, vault: DataFrame, strict_reference: bool = False, detector: Column | None = None
) -> DataFrame:
    """Personal data outside tokens, and unredacted text under a sensitive key.

    A leaf that is a token given out by a live vault is fine. Findings come first, row by
    row, and only they meet the vault: a finding that is no token gets a key of its own, so
    it matches nothing and does not gather on null. ``detector`` may replace the built-in
    one; it yields an array of structs with a ``type`` field from the column ``value``.
    A column ``named`` of the leaves, if there, tells that a sensitive word is in the path.
    """
    types = F.expr(D.span_types_sql("value")) if detector is None else F.transform(detector, lambda s: s["type"])
    pii = "raw PII value found outside semantic token"
    secret = "unredacted password or secret string found in sensitive field"
    named = "named" if "named" in leaves.columns else _named_sql("path", V.SENSITIVE_KEY_WORDS)
    sensitive = f"(value <> '' and {named})"
    keys = F.expr(f"if({sensitive}, array(named_struct('reason', '{secret}', 'matched_type', 'PASSWORD')), array())")
    hits = F.transform(types, lambda t: F.struct(F.lit(pii).alias("reason"), t.alias("matched_type")))
    read = leaves.where(f"path <> '{IMAGE_PATH}'")
    if detector is None:  # most leaves end here, without a list of their own
        read = read.where(f"{D.may_hold_sql('value')} or {sensitive}")
    found = read.select("payload_id", "path", "value", F.explode_outer(F.concat(hits, keys)).alias("_v")).where("_v.reason is not null")
    plain = "value" if strict_reference else K.plain_token_sql("value")
    keyed = found.withColumn("_token", F.expr(
        f"if({K.is_audit_token_sql('value', strict_reference)}, {plain}, concat('~', payload_id, '~', path))"))
    return keyed.join(vault.select(F.col("token").alias("_token")), "_token", "left_anti").select(
        "payload_id", "path", "_v.reason", "_v.matched_type")


def audit_violations(
    payloads: DataFrame, vault: DataFrame, strict_reference: bool = False, detector: Column | None = None
) -> DataFrame:
    """All violations of all payloads: ``payload_id, path, reason, matched_type``."""
    leaves = string_leaves(payloads, ["payload_id"], V.SENSITIVE_KEY_WORDS)
    return payload_violations(payloads).unionByName(leaf_violations(leaves, vault, strict_reference, detector))


def audit_verdicts(payloads: DataFrame, violations: DataFrame) -> DataFrame:
    """Violations per payload and whether it passed."""
    bad = violations.groupBy("payload_id").agg(F.count("*").alias("n_violations"))
    return payloads.select("payload_id").join(bad, "payload_id", "left").fillna(0, ["n_violations"]).withColumn(
        "passed", F.expr("n_violations = 0"))


def send_gate(payloads: DataFrame, *findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payloads that may be sent, and those held back: any finding holds a payload, and so does a missing id."""
    held_ids = findings[0].select("payload_id")
    for more in findings[1:]:
        held_ids = held_ids.unionByName(more.select("payload_id"))
    # both sides read them, and the findings are not looked for twice
    held_ids = cut_lineage(held_ids.where("payload_id is not null").distinct(), "held-payloads")
    known = payloads.where("payload_id is not null")
    held = known.join(held_ids, "payload_id", "left_semi").unionByName(payloads.where("payload_id is null"))
    return known.join(held_ids, "payload_id", "left_anti"), held


def raw_value_leaks(leaves: DataFrame, sensitive: DataFrame, block: int = VALUE_BLOCK) -> DataFrame:
    """Output strings of a payload that contain one of its sensitive values: ``payload_id, path, raw_value``.

    The values of a payload are packed into arrays of about ``block``, so no pair of text
    and value becomes a row unless it leaks, and a payload with very many values is spread
    over several rows.
    """
    values = sensitive.select("payload_id", F.expr(trim_sql("raw_value")).alias("raw_value")).where(
        f"length(raw_value) >= {V.MIN_LEAK_LENGTH}").distinct()
    sizes = values.groupBy("payload_id").agg(F.ceil(F.count("*") / block).alias("_blocks"))
    packed = values.join(sizes, "payload_id").groupBy(
        "payload_id", F.expr("pmod(xxhash64(raw_value), _blocks)").alias("_block")
    ).agg(F.collect_list("raw_value").alias("_values")).drop("_block")
    checked = leaves.where(f"path <> '{IMAGE_PATH}' and not startswith(value, '[')")
    return checked.join(packed, "payload_id").select(
        "payload_id", "path", F.explode(F.expr("filter(_values, v -> contains(value, v))")).alias("raw_value"))


def audit_records(decisions: DataFrame) -> DataFrame:
    """Audit rows without secrets: the typed value is masked, the instruction hashed.

    ``decisions``: session_id, step_number, instruction, action (struct with ``value``),
    confidence, payload_notes. A value field is masked even when it is null.
    """
    return decisions.select(
        "session_id", "step_number",
        F.sha2(F.coalesce("instruction", F.lit("")), 256).alias("instruction_hash"),
        F.col("action").withField("value", F.lit("[REDACTED]")).alias("action"),
        "confidence", "payload_notes")


def region_rollup(regions: DataFrame) -> DataFrame:
    """Regions per payload by detection source; regions of the page have none and count as the page's own."""
    found = regions.withColumn("detection_source", F.coalesce("detection_source", F.lit("dom_heuristic")))
    return found.groupBy("payload_id").pivot("detection_source", list(V.DETECTION_METHODS)).agg(
        F.count(F.lit(1))).fillna(0, list(V.DETECTION_METHODS))


def region_types(regions: DataFrame) -> DataFrame:
    """Regions per payload, detection source, sensitivity type and tier; regions of the page count as the page's own."""
    return regions.groupBy(
        "payload_id", F.coalesce("detection_source", F.lit("dom_heuristic")).alias("detection_source"), "sensitivity_type", "sensitivity_tier"
    ).agg(F.count(F.lit(1)).alias("n"))


def risk_rollup(actions: DataFrame) -> DataFrame:
    """Actions per payload and type by their risk tier; whatever is not ``risky``, null too, is shown as safe."""
    risky = F.coalesce(F.col("risk_tier") == "risky", F.lit(False))
    return actions.groupBy("payload_id", "type").agg(F.count_if(risky).alias("risky"), F.count_if(~risky).alias("safe"))


def latency_rollup(metrics: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Count, p50, p95 and maximum per measure, with bounded sketches for the percentiles."""
    return metrics.groupBy("name").agg(
        F.count("*").alias("n"), F.max("duration_ms").alias("max_ms"),
        F.percentile_approx("duration_ms", 0.5, accuracy).alias("p50_ms"),
        F.percentile_approx("duration_ms", 0.95, accuracy).alias("p95_ms"))
