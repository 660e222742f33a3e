"""Personal-data detection as Catalyst expressions.

Every function here takes and returns SQL expression text, so that one definition
serves the DataFrame API (through ``F.expr``), SQL functions and streaming jobs.
Nothing leaves the JVM and no text is shuffled: a row's spans depend on that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import values as V

SPAN_TYPE = "struct<type:string,match:string,start_idx:int,end_idx:int>"
BLOCK = 128  # elements that one fold goes over
NO_SPANS = f"cast(array() as array<{SPAN_TYPE}>)"


def raw(pattern: str) -> str:
    """A pattern as a raw SQL string literal."""
    quote = '"' if "'" in pattern else "'"
    if quote in pattern:  # both quote kinds: escape instead
        return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"r{quote}{pattern}{quote}"


def let(name: str, value: str, body: str) -> str:
    """Bind ``value`` once so that ``body`` can use it several times."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def computed_once(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Add columns that later filters cannot be substituted into.

    The optimizer moves a filter below a projection by repeating the projected expression
    in it, which multiplies expensive detectors. A one-row generator is evaluated once.
    """
    fields = ", ".join(f"'{name}', {expr}" for name, expr in exprs.items())
    return df.selectExpr("*", f"inline_outer(array(named_struct({fields})))")


def prefix_sql(values: str, combine: str, zero: str) -> str:
    """Running results of ``combine`` (of ``{a}`` and ``{b}``) over an array, each with its own element.

    A fold copies its state at every step, so one over the whole array takes the square of its length. Blocks are
    folded by themselves here, then their ends, and both are put together.
    """
    step = lambda last, x: f"concat(acc, array({combine.format(a=last, b=x)}))"
    last = "element_at(acc, -1)"
    block = f"aggregate(slice(vs, b * {BLOCK} + 1, {BLOCK}), array({zero}), (acc, x) -> {step(last, 'x')})"
    blocks = f"transform(sequence(0, cast((size(vs) - 1) div {BLOCK} as int)), b -> {block})"
    bases = f"aggregate(bl, array({zero}), (acc, k) -> {step(last, 'element_at(k, -1)')})"
    whole = f"flatten(transform(bl, (k, b) -> transform(slice(k, 2, {BLOCK}), v -> {combine.format(a='get(ba, b)', b='v')})))"
    return let("vs", values, let("bl", blocks, let("ba", bases, whole)))


def fixed_width(text: str) -> str:
    """The text as four bytes per character, of which any part is found at once."""
    return f"encode({text}, 'UTF-32')"


def part_sql(wide: str, start: str, length: str) -> str:
    """Characters ``start`` (from 0) to ``start + length`` of a text in ``fixed_width``."""
    return f"decode(substring({wide}, 4 * ({start}) + 1, 4 * ({length})), 'UTF-32')"


def in_list(expr: str, names: tuple[str, ...]) -> str:
    return f"{expr} in ({', '.join(repr(n) for n in names)})"


def tier_sql(kind: str) -> str:
    return f"case when {in_list(kind, V.TIER_1_TYPES)} then 1 when {in_list(kind, V.TIER_2_TYPES)} then 2 else 3 end"


def pattern_spans_sql(text: str, kind: str, pattern: str, gate: str) -> str:
    """All matches of one pattern with character offsets.

    The offsets follow from the pieces between the matches, so the text is read twice
    by the regex engine and only where the cheap ``gate`` holds and something matched.
    """
    lengths = "transform(m, (h, i) -> length(get(p, i)) + length(h))"
    hits = (
        f"transform(m, (h, i) -> named_struct('type', '{kind}', 'match', h, 'start_idx', get(e, i) - length(h), 'end_idx', get(e, i)))"
    )
    fold = let("e", prefix_sql(lengths, "{a} + {b}", "0"), hits)
    found = let("p", f"split({text}, {raw(pattern)}, -1)", fold)
    # one match that the text holds in one place only lies there
    at = f"instr({text}, get(m, 0))"
    single = f"array(named_struct('type', '{kind}', 'match', get(m, 0), 'start_idx', {at} - 1, 'end_idx', {at} - 1 + length(get(m, 0))))"
    matched = let(
        "m", f"regexp_extract_all({text}, {raw(pattern)}, 0)",
        f"if(size(m) = 0, {NO_SPANS}, if(size(m) = 1 and locate(get(m, 0), {text}, {at} + 1) = 0, {single}, {found}))",
    )
    return f"if({gate}, {matched}, {NO_SPANS})"


def _runs_as(runs: str, kind: str, keep: str) -> str:
    return (
        f"transform(filter({runs}, r -> {keep}), r -> named_struct('type', '{kind}', 'match', r.match,"
        f" 'start_idx', r.start_idx, 'end_idx', r.end_idx))"
    )


def _digits(match: str) -> str:
    return f"length(translate({match}, ' -', ''))"


def email_spans_sql(text: str) -> str:
    return pattern_spans_sql(text, "EMAIL", V.EMAIL, f"contains({text}, '@')")


def phone_spans_sql(text: str) -> str:
    return pattern_spans_sql(text, "PHONE", V.PHONE, f"rlike({text}, {raw(V.TEN_DIGITS)})")


def ifsc_spans_sql(text: str) -> str:
    return pattern_spans_sql(text, "IFSC", V.IFSC, f"contains({text}, '0')")


def digit_runs_sql(text: str) -> str:
    """Maximal runs of 4 to 16 digits with single spaces or hyphens between."""
    return pattern_spans_sql(text, "DIGITS", V.DIGIT_RUN, f"rlike({text}, {raw(V.FOUR_DIGITS)})")


def card_from_runs(runs: str) -> str:
    return _runs_as(runs, "CARD_NUMBER", f"{_digits('r.match')} = 16")


def aadhaar_from_runs(runs: str) -> str:
    return _runs_as(runs, "AADHAAR", f"{_digits('r.match')} = 12")


def otp_from_runs(runs: str, text: str) -> str:
    n = V.OTP_CONTEXT_CHARS
    context = part_sql("wide", f"greatest(r.start_idx - {n}, 0)", f"r.end_idx + {n} - greatest(r.start_idx - {n}, 0)")
    short = f"filter({runs}, r -> length(r.match) between 4 and 6 and {_digits('r.match')} = length(r.match))"
    near = let("wide", fixed_width(text), _runs_as("short", "OTP", f"rlike({context}, {raw(V.OTP_CONTEXT)})"))
    return let("short", short, f"if(size(short) = 0, {NO_SPANS}, {near})")


def _joined(text: str) -> str:
    """The text without what may stand between digits."""
    return f"replace(replace({text}, '-', ''), ' ', '')"


def _may_hold_otp(text: str) -> str:
    """Digits and a word of context; each of the words has an ``o``."""
    return f"((contains({text}, 'o') or contains({text}, 'O')) and rlike({text}, '[0-9]{{4}}') and rlike({text}, {raw(V.OTP_WORDS)}))"


def may_hold_sql(text: str) -> str:
    """False only for texts without any span: each type needs an ``@``, ten digits in a run, four letters and a zero, or four
    digits and a word of context. Ids and labels with a few digits end here, before any list is made."""
    return (
        f"(rlike({text}, '[0-9@]') and (contains({text}, '@') or rlike({_joined(text)}, {raw(V.LONG_RUN_OR_IFSC)})"
        f" or {_may_hold_otp(text)}))"
    )


def span_types_sql(text: str) -> str:
    """The types of ``spans_sql``, one for each span, without places: counts of matches, which compile, where no one-time code may be."""
    def times(kind: str, pattern: str, gate: str) -> str:
        return f"if({gate}, array_repeat('{kind}', regexp_count({text}, {raw(pattern)})), cast(array() as array<string>))"

    long = f"rlike({_joined(text)}, '[0-9]{{12}}')"
    plain = ", ".join((
        times("EMAIL", V.EMAIL, f"contains({text}, '@')"), times("PHONE", V.PHONE, f"rlike({text}, {raw(V.TEN_DIGITS)})"),
        times("CARD_NUMBER", V.CARD_RUN, long), times("AADHAAR", V.AADHAAR_RUN, long), times("IFSC", V.IFSC, f"contains({text}, '0')")))
    return f"if({_may_hold_otp(text)}, transform({spans_sql(text)}, s -> s.type), concat({plain}))"


def spans_sql(text: str) -> str:
    """All spans of all types in detection order; overlaps are kept."""
    body = (
        f"concat({email_spans_sql('t')}, {phone_spans_sql('t')}, {card_from_runs('runs')},"
        f" {aadhaar_from_runs('runs')}, {ifsc_spans_sql('t')}, {otp_from_runs('runs', 't')})"
    )
    found = let("t", text, let("runs", digit_runs_sql("t"), body))
    return f"if({may_hold_sql(text)}, {found}, {NO_SPANS})"


SPANS_BY_TYPE = {
    "EMAIL": email_spans_sql,
    "PHONE": phone_spans_sql,
    "CARD_NUMBER": lambda t: card_from_runs(digit_runs_sql(t)),
    "AADHAAR": lambda t: aadhaar_from_runs(digit_runs_sql(t)),
    "IFSC": ifsc_spans_sql,
    "OTP": lambda t: otp_from_runs(digit_runs_sql(t), t),
}


def detect(text: str) -> Column:
    """``array<struct<type, match, start_idx, end_idx>>`` for a text column; empty for null."""
    return F.expr(spans_sql(text))


def detect_type(text: str, kind: str) -> Column:
    return F.expr(SPANS_BY_TYPE[kind](text))


def top_type_sql(spans: str) -> str:
    """First span type having the lowest tier number; null without spans."""
    return let("found", spans, f"coalesce(get(filter(found, s -> {tier_sql('s.type')} = 1), 0).type, get(found, 0).type)")


def top_type(spans: str) -> Column:
    return F.expr(top_type_sql(spans))


def value_guard_sql(value: str) -> str:
    """The raw personal-data type that a typed value shows, or null when it is harmless."""
    rules = (
        ("EMAIL", V.GUARD_EMAIL), ("PHONE", V.PHONE), ("CARD_NUMBER", V.GUARD_CARD),
        ("AADHAAR", V.GUARD_AADHAAR), ("IFSC", V.IFSC),
    )
    whens = " ".join(f"when rlike({value}, {raw(p)}) then '{kind}'" for kind, p in rules)
    return (
        f"case when {value} is null or {value} = '' then null"
        f" when rlike({value}, {raw(V.BRACKET_TOKEN)}) then null {whens} end"
    )


def value_guard(value: str) -> Column:
    return F.expr(value_guard_sql(value))


def resolved_spans_sql(spans: str) -> str:
    """Drop overlapping spans: earliest start, then longest, then lowest tier, then detection order."""
    order = "array_position(array({}), s.type)".format(", ".join(repr(t) for t in V.DETECTION_ORDER))
    ranked = (
        f"array_sort(transform({spans}, s -> named_struct('start_idx', s.start_idx,"
        f" 'neg_len', s.start_idx - s.end_idx, 'tier', {tier_sql('s.type')}, 'ord', {order},"
        f" 'type', s.type, 'match', s.match, 'end_idx', s.end_idx)))"
    )
    span = "named_struct('type', s.type, 'match', s.match, 'start_idx', s.start_idx, 'end_idx', s.end_idx)"
    # a span behind all ends so far starts a part of its own; only spans of one part can overlap
    ends = prefix_sql("transform(r, s -> s.end_idx)", "greatest({a}, {b})", "0")
    starts = "filter(sequence(0, size(r) - 1), i -> i = 0 or get(r, i).start_idx >= get(ends, i - 1))"
    chosen = f"""aggregate(slice(r, i + 1, coalesce(get(parts, k + 1), size(r)) - i), named_struct('last', 0, 'kept', {NO_SPANS}),
        (a, s) -> if(s.start_idx >= a.last, named_struct('last', s.end_idx, 'kept', concat(a.kept, array({span}))), a), a -> a.kept)"""
    resolved = let("ends", ends, let("parts", starts, f"flatten(transform(parts, (i, k) -> {chosen}))"))
    return let("r", ranked, f"if(size(r) = 0, {NO_SPANS}, {resolved})")


def splice_sql(text: str, spans: str, replacement: str) -> str:
    """Replace each of the ordered, non-overlapping ``spans``; ``replacement`` sees the span as ``s``."""
    previous_end = "if(i = 0, 0, get(kept, i - 1).end_idx)"
    between = part_sql("wide", previous_end, f"s.start_idx - {previous_end}")
    pieces = f"transform(kept, (s, i) -> concat({between}, {replacement}))"
    last = "get(kept, size(kept) - 1).end_idx"
    joined = let("wide", fixed_width(text), f"concat(array_join({pieces}, ''), {part_sql('wide', last, f'length({text}) - {last}')})")
    body = f"if(size(kept) = 0, {text}, {joined})"
    return let("kept", spans, body)
