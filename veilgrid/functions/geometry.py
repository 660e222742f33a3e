"""Box arithmetic as SQL expressions over x, y, w, h columns."""

from __future__ import annotations

BOX_PADDING = 4
PILL_HEIGHT = 24
PILL_WIDTHS = (80, 160, 260)


def _corners(box: str) -> tuple[str, str, str, str]:
    return f"{box}.x", f"{box}.y", f"({box}.x + {box}.w)", f"({box}.y + {box}.h)"


def iou_sql(a: str, b: str) -> str:
    """Intersection over union of two box structs; 0 for a missing or empty box."""
    ax, ay, ax2, ay2 = _corners(a)
    bx, by, bx2, by2 = _corners(b)
    inter = (
        f"(cast(greatest(0, least({ax2}, {bx2}) - greatest({ax}, {bx})) as double)"
        f" * greatest(0, least({ay2}, {by2}) - greatest({ay}, {by})))"
    )
    union = f"(cast({a}.w as double) * {a}.h + cast({b}.w as double) * {b}.h - {inter})"
    return f"case when {a} is null or {b} is null then 0D when {union} <= 0 then 0D else {inter} / {union} end"


def pill_width_sql(w: str, h: str) -> str:
    small, medium, large = PILL_WIDTHS
    return f"case when {w} <= {small} and {h} <= {PILL_HEIGHT} then {small} when {w} <= {medium} and {h} <= {PILL_HEIGHT} then {medium} else {large} end"


def redaction_rect_sql(box: str, tier: str, render: str, redact_tier_2: bool = True) -> str:
    """Painted rectangle of a region, or null when its tier is not painted."""
    drawn = f"({tier} = 1 or {tier} = 2)" if redact_tier_2 else f"{tier} = 1"
    width = pill_width_sql(f"{box}.w", f"{box}.h")
    p = BOX_PADDING
    return f"""case when {drawn} and {box} is not null then
        if({render} = 'box',
           named_struct('x', cast({box}.x - {p} as double), 'y', cast({box}.y - {p} as double),
                        'w', cast({box}.w + {2 * p} as double), 'h', cast({box}.h + {2 * p} as double)),
           named_struct('x', {box}.x + {box}.w / 2D - {width} / 2D, 'y', {box}.y + {box}.h / 2D - {PILL_HEIGHT} / 2D,
                        'w', cast({width} as double), 'h', cast({PILL_HEIGHT} as double))) end"""


def covers_sql(rect: str, box: str) -> str:
    """Whether a painted rectangle hides the whole box."""
    return (
        f"coalesce({rect}.x <= {box}.x and {rect}.y <= {box}.y and {rect}.x + {rect}.w >= {box}.x + {box}.w"
        f" and {rect}.y + {rect}.h >= {box}.y + {box}.h, false)"
    )
