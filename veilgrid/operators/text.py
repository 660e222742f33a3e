"""Text operators: span tables, redaction, residual checks and credentials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import detect as D
from veilgrid.functions import tokens as K
from veilgrid.functions import values as V
from veilgrid.functions.detect import raw


def pii_spans(rows: DataFrame, text: str = "text", kind: str | None = None) -> DataFrame:
    """One row per span in place of the text. Narrow: no shuffle.

    The outer explode keeps the optimizer from evaluating the detector a second time as
    an inferred filter.
    """
    spans = D.detect(text) if kind is None else D.detect_type(text, kind)
    keep = [c for c in rows.columns if c != text]
    return (
        rows.select(*keep, F.explode_outer(spans).alias("s"))
        .where("s.type is not null")
        .select(*keep, "s.type", "s.match", "s.start_idx", "s.end_idx")
    )


def redact_text(
    rows: DataFrame, key: str, text: str = "text", session: str = "session_id", kind: str = "s.type"
) -> DataFrame:
    """Add ``redacted_text``, ``n_redacted`` and ``residual`` (spans still found), row by row.

    A detected value's type follows from its own shape, so its token needs no vault lookup
    and whole texts never move between tasks.
    """
    token = K.token_sql(f"cast({session} as string)", "s.match", kind, key)
    kept = D.resolved_spans_sql(D.spans_sql(text))
    residual = f"if(size(hits) = 0, 0, size({D.spans_sql('clean')}))"
    result = f"named_struct('clean', clean, 'n', size(hits), 'residual', {residual})"
    spliced = D.let("hits", kept, D.let("clean", D.splice_sql(text, "hits", token), result))
    return D.computed_once(rows, {"_r": spliced}).withColumns({
        "redacted_text": F.col("_r.clean"), "n_redacted": F.col("_r.n"), "residual": F.col("_r.residual"),
    }).drop("_r")


def text_tokens(redacted: DataFrame, text: str = "redacted_text") -> DataFrame:
    """One row per token in a redacted text, in order: other columns, ``pos``, ``token``."""
    found = F.expr(f"regexp_extract_all({text}, {raw(V.TEXT_TOKEN)}, 0)")
    return redacted.select(*[c for c in redacted.columns if c != text], F.posexplode(found).alias("pos", "token"))


def split_residual(redacted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean rows, and rows to hold back because personal data is still in the text."""
    return redacted.where("residual = 0"), redacted.where("residual > 0")


def _match_start(text: str, pattern: str) -> str:
    """1-based position of the first match."""
    return f"(length(get(split({text}, {raw(pattern)}, 2), 0)) + 1)"


def _replace_first(text: str, pattern: str, label: str, token: str) -> str:
    """Replace the first quoted value after ``label`` by its token."""
    whole = f"regexp_extract({text}, {raw(pattern)}, 0)"
    start = _match_start(text, pattern)
    return (
        f"concat(substring({text}, 1, {start} - 1), '{label} ', {token},"
        f" substring({text}, {start} + length({whole})))"
    )


def extract_credentials(rows: DataFrame, text: str = "task_instruction") -> DataFrame:
    """Credential values named in an instruction: quoted first, else an informal pair.

    Adds ``needs_credentials, username, password, credential_source`` (quoted, informal,
    unresolved, none).
    """
    quoted = rows.withColumns({
        "needs_credentials": F.expr(K.needs_credentials_sql(text)),
        "_user": F.expr(K.quoted_value_sql(text, V.USERNAME_QUOTED)),
        "_pass": F.expr(K.quoted_value_sql(text, V.PASSWORD_QUOTED)),
    }).withColumn("_fast", F.expr("_user is not null or _pass is not null"))
    informal = quoted.withColumn("_informal", F.expr("needs_credentials and not _fast")).withColumns({
        "_u2": F.expr(f"if(_informal, {K.informal_value_sql(text, 1)}, null)"),
        "_p2": F.expr(f"if(_informal, {K.informal_value_sql(text, 2)}, null)"),
    })
    return informal.withColumns({
        "username": F.expr("coalesce(_user, _u2)"),
        "password": F.expr("coalesce(_pass, _p2)"),
        "credential_source": F.expr(
            "case when _fast then 'quoted' when _u2 is not null then 'informal'"
            " when _informal then 'unresolved' else 'none' end"
        ),
    }).drop("_user", "_pass", "_fast", "_informal", "_u2", "_p2")


def replace_credentials(rows: DataFrame, text: str, username_token: str, password_token: str) -> DataFrame:
    """Put tokens in place of the values that :func:`extract_credentials` found.

    Adds ``credential_text``; it is null for unresolved instructions, which must not pass.
    """
    quoted_user = _replace_first(text, V.USERNAME_QUOTED, "username", username_token)
    quoted_pass = _replace_first("_t", V.PASSWORD_QUOTED, "password", password_token)
    # An informal pair is spliced by position: the lead, the first value, the gap, the second.
    pair = f"regexp_extract({text}, {raw(V.INFORMAL_PAIR)}, 0)"
    gap = f"regexp_extract({text}, {raw(V.INFORMAL_GAP)}, 1)"
    start = _match_start(text, V.INFORMAL_PAIR)
    head = (
        f"substring({text}, 1, {start} - 1 + length({pair}) - length(password) - length({gap}) - length(username))"
    )
    tail = f"substring({text}, {start} + length({pair}))"
    informal = f"concat({head}, {username_token}, {gap}, {password_token}, {tail})"
    return (
        rows.withColumn("_t", F.expr(
            f"case credential_source when 'quoted' then if(username is null, {text}, {quoted_user})"
            f" when 'informal' then {informal} when 'none' then {text} end"))
        .withColumn("credential_text", F.expr(
            f"if(credential_source = 'quoted' and password is not null, {quoted_pass}, _t)"))
        .drop("_t")
    )


def sanitize_instructions(rows: DataFrame, key: str, text: str = "task_instruction") -> DataFrame:
    """Instructions safe to send, with a reject reason where they are not.

    Adds ``sanitized_instruction`` (null when rejected) and ``reject_reason``.
    """
    session = "cast(session_id as string)"
    user = K.token_sql(session, "username", "'NAME'", key)
    secret = K.token_sql(session, "password", "if(password = username, 'NAME', 'PASSWORD')", key)
    found = replace_credentials(extract_credentials(rows, text), text, user, secret)
    first_type = "case when s.match = username then 'NAME' when s.match = password then 'PASSWORD' else s.type end"
    redacted = redact_text(found, key, "credential_text", kind=first_type)
    return redacted.withColumn("reject_reason", F.expr(
        "case when credential_source = 'unresolved' then 'unresolved_sensitive_reference'"
        " when residual > 0 then 'instruction_leakage' end"
    )).withColumn(
        "sanitized_instruction", F.expr("if(reject_reason is null, redacted_text, null)")
    ).drop("credential_text", "redacted_text", "residual", "n_redacted")
