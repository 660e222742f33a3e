"""Token vaults as tables: issue, resolve, check, count and purge.

A value that was seen under several types has one vault token, named by the first; a redacted text names the type of
its span. The suffix is the same, so tokens are looked up by it (``tokens.lookup_key_sql``) everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.functions import tokens as K
from veilgrid.session import cut_lineage


def issue_vault(
    occurrences: DataFrame, key: str, order: tuple[str, ...] = (), letters: int = K.SUFFIX_LETTERS
) -> DataFrame:
    """One row per distinct raw value of a session: ``session_id, raw_value, sensitivity_type, token``.

    ``occurrences`` has session_id, raw_value and sensitivity_type; the first type in
    ``order`` wins. Occurrences are combined before the shuffle, so a value that fills a
    third of all rows arrives as one row per input task. With a short suffix, values that
    meet on a token get extra letters by rank, which keeps the vault one to one.
    """
    first = F.struct(*order, F.upper(F.coalesce("sensitivity_type", F.lit("UNKNOWN"))).alias("_kind"))
    vault = (
        occurrences.where("raw_value is not null and raw_value <> ''")
        .groupBy("session_id", "raw_value")
        .agg(F.min(first)["_kind"].alias("sensitivity_type"))
        .withColumn("token", K.token("session_id", "raw_value", "sensitivity_type", key, letters))
    )
    if letters >= K.UNIQUE_LETTERS:
        return vault
    rank = F.row_number().over(Window.partitionBy("session_id", "token").orderBy("raw_value")) - 1
    extra = F.translate(F.hex(F.col("_rank")), "0123456789ABCDEF", "ghijklmnopabcdef")
    return (
        vault.withColumn("_rank", rank)
        .withColumn("token", F.when(F.col("_rank") == 0, F.col("token")).otherwise(
            F.concat(F.expr("substring(token, 1, length(token) - 1)"), extra, F.lit("]"))))
        .drop("_rank")
    )


def with_tokens(rows: DataFrame, vault: DataFrame, value: str = "raw_value") -> DataFrame:
    """Attach the vault token of every occurrence.

    The vault side has one row per key, so a hot value only widens one side, which
    adaptive execution splits; a small vault is broadcast by its measured size.
    """
    tokens = vault.select("session_id", F.col("raw_value").alias(value), "token")
    return rows.join(tokens, ["session_id", value], "left")


def attach_tokens(
    rows: DataFrame, key: str, order: tuple[str, ...], where: str = "raw_value is not null and raw_value <> ''", value: str = "raw_value",
) -> DataFrame:
    """``token`` of the rows that ``where`` picks, as the vault of these rows issues it; null for all others.

    A token is a hash of the row itself, only its type is the vault's: that of the value's first occurrence. So rows
    meet nothing but the values that occur under several types. These are written first, so that a small table of them
    is sent to the rows and the rows stay where they are; in a shuffle, rows without a value have keys of their own.
    """
    kind = F.upper(F.coalesce("sensitivity_type", F.lit("UNKNOWN")))
    kinds = cut_lineage(rows.where(where).groupBy("session_id", value).agg(
        F.min(F.struct(*order, kind.alias("_kind")))["_kind"].alias("_first"), F.min(kind).alias("_low"), F.max(kind).alias("_high"),
    ).where("_low <> _high").select(F.col("session_id").alias("_session"), F.col(value).alias("_value"), "_first"), "value-kinds")
    picked = F.coalesce(F.expr(where), F.lit(False))
    keyed = rows.withColumns({
        "_s": F.when(picked, F.col("session_id")), "_v": F.when(picked, F.col(value)).otherwise(F.concat(F.lit("~"), F.xxhash64(*order)))})
    met = keyed.join(kinds, (F.col("_s") == F.col("_session")) & (F.col("_v") == F.col("_value")), "left")
    typed = met.withColumn("_first", F.coalesce("_first", kind))
    return typed.withColumn("token", F.when(picked, K.token("session_id", value, "_first", key))).select(*rows.columns, "token")


def _keyed(tokens: DataFrame, token: str) -> DataFrame:
    return tokens.withColumn("_key", F.expr(K.lookup_key_sql(token)))


def restore_tokens(rows: DataFrame, vault: DataFrame, token: str = "token") -> DataFrame:
    """Attach ``raw_value``, null when the session's vault has no such token."""
    lookup = _keyed(vault, "token").select("session_id", "_key", "raw_value")
    return _keyed(rows, token).join(lookup, ["session_id", "_key"], "left").drop("_key")


def resolve_tokens(rows: DataFrame, vault: DataFrame, token: str = "token") -> DataFrame:
    """Attach ``raw_value``; null and ``unresolvable_token`` in ``status`` when not in the vault."""
    return restore_tokens(rows, vault, token).withColumn("status", F.expr("if(raw_value is null, 'unresolvable_token', 'ok')"))


def has_token(rows: DataFrame, vault: DataFrame, token: str = "token") -> DataFrame:
    """Rows whose token their own session issued."""
    issued = _keyed(vault, "token").select("session_id", "_key")
    return _keyed(rows, token).join(issued, ["session_id", "_key"], "left_semi").drop("_key")


def forged_tokens(rows: DataFrame, vault: DataFrame, token: str = "token") -> DataFrame:
    """Token-shaped strings that no live vault issued."""
    shaped = rows.where(K.is_audit_token_sql(token))
    plain = shaped.withColumn("_plain", F.expr(K.plain_token_sql(token)))
    return _keyed(plain, "_plain").join(_keyed(vault, "token").select("_key"), "_key", "left_anti").drop("_key", "_plain")


def vault_stats(vault: DataFrame) -> DataFrame:
    """Token counts per session and type with a total row (type ``ALL``); no raw values."""
    return (
        vault.withColumn("token_type", F.expr(K.token_type_sql("token")))
        .rollup("session_id", "token_type").agg(F.count("*").alias("n_tokens"))
        .where("session_id is not null").fillna("ALL", ["token_type"])
    )


def token_uniqueness(vault: DataFrame) -> DataFrame:
    """Issued against distinct tokens per session: equal when the vault is one to one."""
    pairs = vault.groupBy("session_id", "token").agg(F.count("*").alias("n"))
    return pairs.groupBy("session_id").agg(
        F.sum("n").alias("n_issued"), F.count("*").alias("n_distinct")
    ).withColumn("is_unique", F.expr("n_issued = n_distinct"))


def purge_vault(vault: DataFrame, closed_sessions: DataFrame) -> DataFrame:
    """The vault without sessions that ended or expired."""
    return vault.join(closed_sessions.select("session_id").distinct(), "session_id", "left_anti")
