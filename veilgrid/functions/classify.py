"""Element classification: labels, roles, sensitivity types, ids and values.

All rules are SQL expressions over the columns of a raw element table: ``dom_id, ext_id,
tag, type, autocomplete, placeholder, aria_label, role, own_label, for_label,
parent_label, sibling_text, inner_text, text_content, value``.
"""

from __future__ import annotations

from veilgrid.functions import values as V
from veilgrid.functions.detect import raw

# White space that trimming removes.
WHITESPACE = " \t\n\x0b\x0c\r      　﻿" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)


def trim_sql(expr: str) -> str:
    return f"btrim({expr}, '{WHITESPACE}')"


def nonblank_sql(expr: str) -> str:
    """The trimmed text, or null when nothing is left."""
    return f"nullif({trim_sql(expr)}, '')"


LABEL = "coalesce({})".format(", ".join(
    nonblank_sql(c)
    for c in ("own_label", "for_label", "parent_label", "aria_label", "placeholder", "sibling_text")
))

_TYPE = "lower(coalesce(type, ''))"
_TAG = "lower(coalesce(tag, ''))"
DEFAULT_ROLE = (
    f"case when {_TAG} = 'button' or {_TYPE} in ('submit', 'button') then 'button'"
    f" when {_TAG} in ('input', 'textarea') then 'textbox' when {_TAG} = 'select' then 'combobox'"
    f" when {_TAG} = 'a' then 'link' else 'generic' end"
)
ROLE = f"coalesce(nullif(role, ''), {DEFAULT_ROLE})"
IS_BUTTON = f"({_TAG} = 'button' or {_TYPE} in ('submit', 'button') or coalesce(role, '') = 'button')"
VISIBLE_TEXT = "coalesce(nullif(inner_text, ''), nullif(text_content, ''))"
BUTTON_LABEL = f"coalesce({nonblank_sql('aria_label')}, {VISIBLE_TEXT})"

_AUTOCOMPLETE = "lower(coalesce(autocomplete, ''))"
_PLACEHOLDER = "coalesce(placeholder, '')"
ELEMENT_TEXT = f"coalesce({trim_sql(VISIBLE_TEXT)}, '')"


def dom_type_sql(label: str, is_button: str) -> str:
    """Sensitivity type from attributes and label; the first rule that holds wins."""
    return f"""case
        when {is_button} then null
        when {_TYPE} = 'password' then 'PASSWORD'
        when contains({_AUTOCOMPLETE}, 'cc-number') then 'CARD_NUMBER'
        when contains({_AUTOCOMPLETE}, 'email') or {_TYPE} = 'email' then 'EMAIL'
        when rlike(coalesce({label}, ''), {raw(V.AMOUNT_WORDS)}) or rlike({_PLACEHOLDER}, {raw(V.AMOUNT_WORDS)})
            or rlike({ELEMENT_TEXT}, {raw(V.AMOUNT_TEXT)}) then 'AMOUNT'
        when contains({_AUTOCOMPLETE}, 'tel') or {_TYPE} = 'tel'
            or rlike(coalesce({label}, ''), {raw(V.PHONE_WORDS)})
            or rlike({_PLACEHOLDER}, {raw(V.PHONE_WORDS)}) then 'PHONE'
        when contains({_AUTOCOMPLETE}, 'name') or rlike(coalesce({label}, ''), '(?i)name') then 'NAME'
        else 'UNKNOWN' end"""


def element_id_sql(*identity: str) -> str:
    """Own id, else the tagged id, else a hash of the ``identity`` columns."""
    return (
        f"case when {nonblank_sql('dom_id')} is not null then dom_id when ext_id is not null then ext_id"
        f" else concat('ext-el-', substring(sha2(concat_ws('|', {', '.join(identity)}), 256), 1, 16)) end"
    )


RAW_VALUE = (
    f"case when {nonblank_sql('value')} is not null then value else {nonblank_sql('inner_text')} end"
)
SCAN_TEXT = "coalesce(raw_value, text_content, '')"

DECEPTIVE_LABEL = (
    f"{nonblank_sql('aria_label')} is not null and {nonblank_sql('inner_text')} is not null"
    f" and {trim_sql('aria_label')} <> {trim_sql('inner_text')}"
    f" and rlike(lower(aria_label), '{'|'.join(V.DANGEROUS_KEYWORDS)}')"
)
