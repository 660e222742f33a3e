"""Session-scoped tokens, token shapes and credential phrases as Catalyst expressions.

A token is a keyed hash of its session and raw value, so every task, retry and stream
gives the same token without any shared state. Its suffix has letters only, since
digits could look like personal data again. With the default 24 letters (96 bits) two
values of a session do not meet in practice and no lookup is needed to redact a text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilgrid.functions import values as V
from veilgrid.functions.detect import raw

SUFFIX_LETTERS = 24
#: Suffixes of so many letters do not meet.
UNIQUE_LETTERS = 20


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def suffix_sql(session: str, value: str, key: str, letters: int = SUFFIX_LETTERS) -> str:
    k = _literal(key)
    # the session's length tells where it ends, so no two pairs of session and value are one text
    inner = f"sha2(concat({k}, '|', length({session}), '|', {session}, '|', {value}), 256)"
    outer = f"sha2(concat({k}, '|', {inner}), 256)"
    return f"translate(substring({outer}, 1, {letters}), '0123456789', 'ghijklmnop')"


def token_sql(session: str, value: str, kind: str, key: str, letters: int = SUFFIX_LETTERS) -> str:
    """``[TYPE_suffix]``; null or empty values have no token."""
    token = f"concat('[', upper(coalesce({kind}, 'UNKNOWN')), '_', {suffix_sql(session, value, key, letters)}, ']')"
    return f"case when {value} is not null and {value} <> '' then {token} end"


def token(session: str, value: str, kind: str, key: str, letters: int = SUFFIX_LETTERS) -> Column:
    return F.expr(token_sql(session, value, kind, key, letters))


def is_bracket_token_sql(value: str) -> str:
    return f"coalesce(rlike({value}, {raw(V.BRACKET_TOKEN)}), false)"


def is_audit_token_sql(value: str, strict_reference: bool = False) -> str:
    """Token shape that a leak audit accepts; the strict form takes no lower-case suffix."""
    pattern = V.AUDIT_TOKEN if strict_reference else V.ISSUED_TOKEN
    return f"coalesce(rlike({value}, {raw(pattern)}), false)"


def token_type_sql(token: str) -> str:
    """Type named by an issued token, else UNKNOWN."""
    return f"coalesce(nullif(regexp_extract({token}, {raw(V.STATS_TOKEN)}, 1), ''), 'UNKNOWN')"


def token_suffix_sql(token: str) -> str:
    """The keyed suffix of a token, which alone identifies session and value; null for other texts."""
    return f"nullif(regexp_extract({token}, {raw(V.STATS_TOKEN.replace('([A-Z_]+)_[a-z0-9]+', '[A-Z_]+_([a-z0-9]+)'))}, 1), '')"


def lookup_key_sql(token: str) -> str:
    """What a token is looked up by: its suffix where that is unique, whatever type stands before it, else the whole token."""
    suffix = token_suffix_sql(token)
    return f"if(length({suffix}) >= {UNIQUE_LETTERS}, {suffix}, {token})"


def plain_token_sql(token: str) -> str:
    """A token without its uncertainty mark, as the vault holds it."""
    return f"regexp_replace({token}, {raw(chr(92) + '?' + chr(92) + ']$|: uncertain' + chr(92) + ']$')}, ']')"


def needs_credentials_sql(text: str) -> str:
    return f"coalesce(rlike({text}, {raw(V.CREDENTIAL_INTENT)}), false)"


def quoted_value_sql(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, {raw(pattern)}, 1), '')"


def informal_value_sql(text: str, group: int) -> str:
    return f"nullif(regexp_extract({text}, {raw(V.INFORMAL_PAIR)}, {group}), '')"
