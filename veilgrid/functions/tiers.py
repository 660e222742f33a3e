"""Sensitivity tiers, type fusion, amounts, confidence and action risk as SQL expressions."""

from __future__ import annotations

from veilgrid.functions import values as V
from veilgrid.functions.detect import in_list, raw, tier_sql


def fused_type_sql(dom_type: str, pii_type: str) -> str:
    """The lower tier wins; on equal tiers the pattern type does."""
    return f"""case
        when coalesce({dom_type}, 'UNKNOWN') = 'UNKNOWN' then coalesce({pii_type}, 'UNKNOWN')
        when {pii_type} is null or {dom_type} = {pii_type} then {dom_type}
        when {tier_sql(dom_type)} < {tier_sql(pii_type)} then {dom_type} else {pii_type} end"""


def fused_source_sql(dom_type: str, pii_type: str) -> str:
    """Which signal decided the type: dom, pii or none."""
    return f"""case
        when coalesce({dom_type}, 'UNKNOWN') = 'UNKNOWN' then case when {pii_type} is not null then 'pii' end
        when {pii_type} is null or {dom_type} = {pii_type} then 'dom'
        when {tier_sql(dom_type)} < {tier_sql(pii_type)} then 'dom' else 'pii' end"""


def type_mismatch_sql(dom_type: str, pii_type: str) -> str:
    return f"coalesce({dom_type} not in ('UNKNOWN', {pii_type}), false)"


def reason_sql(source: str, kind: str, label: str) -> str:
    return f"""case
        when {source} = 'dom' and coalesce({label}, '') <> '' then concat('labelled \\'', {label}, '\\' by nearby DOM text')
        when {source} = 'dom' then concat('matched a DOM attribute for ', {kind})
        when {source} = 'pii' then concat('matched ', {kind}, ' pattern') end"""


def amount_number_sql(text: str, parse_thousands: bool = False) -> str:
    """First number of a text; thousands marks end it unless ``parse_thousands``."""
    source = f"regexp_replace({text}, r'(?<=[0-9]),(?=[0-9]{{3}}(?![0-9]))', '')" if parse_thousands else text
    return f"try_cast(nullif(regexp_extract({source}, {raw(V.NUMBER)}, 0), '') as double)"


def amount_bucket_sql(number: str) -> str:
    return f"""case when {number} is null or isnan({number}) then '[AMOUNT]'
        when {number} < 10 then '[AMOUNT: $<10]' when {number} <= 50 then '[AMOUNT: $10-50]'
        when {number} <= 100 then '[AMOUNT: $50-100]' when {number} <= 500 then '[AMOUNT: $100-500]'
        when {number} <= 1000 then '[AMOUNT: $500-1000]' else '[AMOUNT: $1000+]' end"""


def amount_text_sql(spans: str, label: str, value: str) -> str:
    """Where an amount is read from: the first match holding a digit, else label and value."""
    joined = f"concat_ws(' ', nullif({label}, ''), nullif({value}, ''))"
    return f"coalesce(get(filter({spans}, s -> rlike(s.match, '[0-9]')), 0).match, {joined})"


def token_decision_sql(tier: str, kind: str, value: str, token: str, amount: str, with_vault: bool = True) -> str:
    """Vault token for a filled tier 1 or 2 field; an amount without a vault gets its range."""
    if with_vault:
        return f"case when {tier} in (1, 2) and coalesce({value}, '') <> '' then {token} end"
    return f"case when {kind} = 'AMOUNT' and coalesce({value}, '') <> '' then {amount} end"


def base_confidence_sql(dom_type: str, spans: str) -> str:
    return f"case when coalesce({dom_type}, '') <> 'UNKNOWN' then 0.92D when size({spans}) > 0 then 0.6D else 0.92D end"


def method_sql(dom_type: str, spans: str) -> str:
    return (
        f"case when coalesce({dom_type}, '') = 'UNKNOWN' and size({spans}) > 0 then 'ocr_regex'"
        " else 'dom_heuristic' end"
    )


def gate_action_sql(tier: str, confidence: str) -> str:
    return (
        f"case when {tier} = 1 then 'hard_redact' when {tier} = 2 and {confidence} >= 0.6 then 'hard_redact'"
        f" when {tier} = 2 then 'soft_redact_flagged' else 'no_redact' end"
    )


def gate_token_sql(tier: str, kind: str, token: str, confidence: str) -> str:
    """Token with its uncertainty mark."""
    close = r"r'\]$'"
    return f"""case
        when {tier} = 1 and {confidence} < 0.75 then regexp_replace({token}, {close}, '?]')
        when {tier} = 2 and {confidence} < 0.6 then coalesce(
            regexp_replace(nullif({token}, ''), {close}, ': uncertain]'), concat('[', {kind}, ': uncertain]'))
        else {token} end"""


def badge_sql(confidence: str) -> str:
    return f"case when {confidence} >= 0.85 then 'green' when {confidence} >= 0.6 then 'yellow' else 'red' end"


def client_risk_sql(risk_tier: str, sensitivity_tier: str, target: str, value: str) -> str:
    """Risk by the action alone: stated, numeric, tier, target words, then tokens in the value."""
    words = "|".join(V.SENSITIVE_TARGET_WORDS)
    return f"""case
        when {in_list(risk_tier, V.RISK_TIERS)} then {risk_tier}
        when rlike({risk_tier}, r'^-?[0-9]+$') then case when {risk_tier} in ('1', '2') then 'risky' else 'safe' end
        when {sensitivity_tier} in (1, 2) then 'risky'
        when rlike(lower(coalesce({target}, '')), '{words}') then 'risky'
        when rlike(coalesce({value}, ''), {raw(V.VALUE_TOKEN)}) then 'risky' else 'safe' end"""


def policy_risk_sql(kind: str, risk_tier: str, reasoning: str, sensitive: str, label: str) -> str:
    """Authoritative risk, which never trusts the stated tier over page data."""
    text = f"lower(concat(coalesce({label}, ''), ' ', coalesce({reasoning}, '')))"
    return f"""case
        when coalesce({sensitive}, false) then 'risky'
        when {kind} = 'click' and rlike({text}, '{'|'.join(V.DANGEROUS_KEYWORDS)}') then 'risky'
        when {in_list(kind, V.TERMINAL_ACTIONS)} then 'safe'
        when {in_list(risk_tier, V.RISK_TIERS)} then {risk_tier} else 'risky' end"""


def needs_confirmation_sql(kind: str, risk_tier: str, target: str, found: str, input_type: str, text: str) -> str:
    return f"""(coalesce({risk_tier} = 'risky', false) or ({kind} = 'click' and coalesce({target}, '') <> '' and (
        not {found} or coalesce({input_type}, '') = 'submit'
        or rlike(lower(coalesce({text}, '')), '{'|'.join(V.CONFIRM_WORDS)}'))))"""


def executability_sql(kind: str, found: str, interactable: str, value: str, resolved: str) -> str:
    """ok, or why an action could not be carried out."""
    bracketed = f"(startswith(coalesce({value}, ''), '[') and endswith(coalesce({value}, ''), ']'))"
    return f"""case
        when {kind} in ('task_complete', 'task_failed', 'wait') then 'ok'
        when not {found} and {kind} in ('click', 'type', 'scroll') then 'target_element_not_found'
        when {found} and not {interactable} then 'element_not_interactable'
        when {kind} = 'type' and {bracketed} and not {resolved} then 'unresolvable_token'
        when {kind} in ('click', 'type', 'scroll', 'ask_user_confirmation') then 'ok'
        else 'unknown_action_type' end"""
