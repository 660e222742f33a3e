"""Names, keywords, limits and patterns that results depend on."""

# Sensitivity types in detection order, and their tiers (1 is the most sensitive).
TIER_1_TYPES = ("PASSWORD", "CARD_NUMBER", "AADHAAR", "OTP")
TIER_2_TYPES = ("NAME", "AMOUNT", "EMAIL", "PHONE", "IFSC")
SENSITIVITY_TYPES = (
    "PASSWORD", "CARD_NUMBER", "EMAIL", "NAME", "AMOUNT", "PHONE", "AADHAAR", "OTP", "IFSC", "UNKNOWN",
)
DETECTION_ORDER = ("EMAIL", "PHONE", "CARD_NUMBER", "AADHAAR", "IFSC", "OTP")
DETECTION_METHODS = ("dom_heuristic", "vision_model", "ocr_regex")
ACTION_TYPES = ("click", "type", "scroll", "wait", "ask_user_confirmation", "task_complete", "task_failed")
TERMINAL_ACTIONS = ("task_complete", "task_failed")
RISK_TIERS = ("safe", "risky")
RESPONSE_WRAPPER_KEYS = ("actions", "action", "response", "result")

# Keywords.
DANGEROUS_KEYWORDS = (
    "pay", "purchase", "delete", "remove", "confirm", "submit", "transfer", "send", "checkout", "buy",
)
CONFIRM_WORDS = ("pay", "submit", "delete", "confirm")
SENSITIVE_TARGET_WORDS = (
    "card", "pwd", "password", "email", "phone", "ssn", "aadhaar", "otp", "cvv", "credit",
)
SENSITIVE_KEY_WORDS = ("password", "pwd", "secret", "credit_card", "cvv", "ssn", "aadhaar", "otp")
FAILURE_PHRASES = (
    "invalid username", "invalid password", "login failed", "incorrect password", "error", "try again",
    "access denied",
)

# Limits.
MAX_ELEMENTS = 500
MAX_NOTES = 500
MAX_INSTRUCTION = 2000
MAX_IMAGE = 8_000_000
MAX_ERROR = 1000
MIN_IMAGE = 100
RATE_LIMIT = 20
RATE_WINDOW_SECONDS = 60
SESSION_TTL_SECONDS = 30 * 60
SESSION_WARNING = 20
MAX_STEPS = 20
MAX_RETRIES = 3
IOU_THRESHOLD = 0.3
MIN_LEAK_LENGTH = 3

# Patterns, written for Java with ASCII classes. Every repetition of a group is
# bounded, so very long digit or word runs neither backtrack nor overflow the stack.
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
)
PHONE = r"(?<![0-9])[6-9][0-9]{9}(?![0-9])"
DIGIT_RUN = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){3,15}+(?![ -]?[0-9])"
FOUR_DIGITS = r"[0-9](?:[ -]?[0-9]){3}"
TEN_DIGITS = r"[0-9]{10}"
IFSC = WORD_START + r"[A-Za-z]{4}0[A-Za-z0-9]{6}" + WORD_END
OTP_CONTEXT = r"(?i)" + WORD_START + r"(otp|code|verification)" + WORD_END
OTP_CONTEXT_CHARS = 30
# What a text without these cannot hold: phone, card and Aadhaar numbers, IFSC codes; one-time codes.
LONG_RUN_OR_IFSC = r"[0-9]{10}|[A-Za-z]{4}0"  # once spaces and hyphens are out
OTP_WORDS = r"(?i)otp|code|verification"
# Runs of DIGIT_RUN that have exactly so many digits, written without groups, which Java's engine repeats slowly.
CARD_RUN, AADHAAR_RUN = ("[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])" + "[ -]?[0-9]" * (n - 1) + "(?![ -]?[0-9])" for n in (16, 12))
BRACKET_TOKEN = r"^\[[A-Za-z0-9_]+\]\z"
GUARD_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
GUARD_CARD = r"(?<![0-9])(?:[0-9][ -]?){15}[0-9](?![0-9])"
GUARD_AADHAAR = r"(?<![0-9])(?:[0-9][ -]?){11}[0-9](?![0-9])"
STATS_TOKEN = r"^\[([A-Z_]+)_[a-z0-9]+\]\z"
AUDIT_TOKEN = r"^\[[A-Z0-9_]+(?:\?|: [^\]]+)?\]\z"
ISSUED_TOKEN = r"^\[[A-Z_]+_[A-Za-z0-9]+(?:\?|: [^\]]+)?\]\z"
VALUE_TOKEN = (
    r"\[(CARD_NUMBER|PASSWORD|AADHAAR|OTP|EMAIL|PHONE|NAME|AMOUNT|IFSC)(?:_\d+)?(?:\?|: [^\]]+)?\]"
)
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
AMOUNT_WORDS = r"(?i)amount|price|total"
AMOUNT_TEXT = r"(?i)amount|price|total|\$[0-9]"
PHONE_WORDS = r"(?i)phone|mobile|contact number"
CREDENTIAL_INTENT = r"(?i)" + WORD_START + r"(log\s*in|log\s*me\s*in|sign\s*in)" + WORD_END
USERNAME_QUOTED = r"""(?i)username\s+['"]([^'"]+)['"]"""
PASSWORD_QUOTED = r"""(?i)password\s+['"]([^'"]+)['"]"""
_INFORMAL_LEAD = (
    r"(?i)" + WORD_START + r"(?:account|credentials|creds|login|log ?in)" + WORD_END + r"[,:]?\s+"
)
_INFORMAL_GAP = r"\s*(?:/|,|" + WORD_START + r"and" + WORD_END + r")\s*"
INFORMAL_PAIR = _INFORMAL_LEAD + r"([^\s,/]+)" + _INFORMAL_GAP + r"([^\s,/.!?]+)"
INFORMAL_GAP = _INFORMAL_LEAD + r"[^\s,/]+(" + _INFORMAL_GAP + r")[^\s,/.!?]+"

# Messages.
ISSUE_NOT_REDACTED = "structural redaction claimed but visual redaction missing"
ISSUE_NOT_SENSITIVE = (
    "visual redaction present but structural summary shows no sensitivity"
    " — possible over-redaction or stale data"
)
REASON_FACE = "detected as face by vision model"
REASON_ERROR_TEXT = "Visible error text detected on page"
REASON_ERROR_ELEMENT = "Element with error role/class detected"
NO_HISTORY = "No previous steps in this session."
HISTORY_HEADER = "Previous steps taken:\n"
TEXT_TOKEN = r"\[[A-Z_]+_[a-p]{24}\]"  # a token as redaction writes it into a text
