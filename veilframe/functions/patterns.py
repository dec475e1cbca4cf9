"""What is looked for in a text, in the order that breaks ties.

The patterns say the same as the specification's in Java's dialect: `(?U)` makes `\\b`, `\\d`, `\\s` and `\\w` those of
Unicode. The IPv6 pattern asks for two groups instead of two or more; what follows them may hold further ones, so it
accepts the same strings, and Java's matcher doesn't recurse by the length of the text. Where a run of characters could
be tried from each of its word boundaries, a lookbehind lets only the first be tried (all of a run succeed or fail
alike), and what can't be given back is possessive, so a hostile text takes time in proportion to its length; `plain` is
then the pattern as specified, which finds the same. A text with a match holds one of the detector's `needs`, plain strings in lower or upper case as given, or any digit, and passes its gate; both are cheap.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Detector:
    """A pattern, the kind and priority of what it finds, the group that is the span, and how a match is trimmed and checked."""

    order: int
    kind: str
    priority: int
    pattern: str
    needs: tuple[str, ...]
    gate: str
    group: int = 0
    trim: str = ""
    check: str = ""
    opt_in: bool = False
    plain: str = ""


#: Among needs: any digit, of any script; and strings that may stand in any case.
DIGIT, ANY_CASE = r"\d", "(?i)"

# Patterns, kinds and priorities.
DETECTORS = (
    Detector(1, "URL", 6, r"(?i)(?U)\b(?:https?://|www\.)[^\s<>\"'`]+", ("://", ANY_CASE + "www."), r"://|(?i)www\.", trim="url"),
    Detector(2, "EMAIL", 5, r"(?i)(?U)(?:\G|(?<!\b[A-Z0-9._%+\-]{1,64}))\b[A-Z0-9._%+\-]++@[A-Z0-9.\-]+\.[A-Z]{2,}\b", ("@",), r"@", plain=r"(?i)(?U)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"),
    Detector(3, "KEY", 5, r"(?U)(?<!\beyJ[A-Za-z0-9_-]{0,64})\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}\b", ("eyJ",), r"eyJ", plain=r"(?U)\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    Detector(4, "KEY", 5, r"(?:sk-(?:live|test)-[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16}|gh[op]_[A-Za-z0-9]{20,}|xox[bpas]-[A-Za-z0-9\-]{10,})", ("sk-", "AKIA", "gho_", "ghp_", "xox"), r"sk-|AKIA|gh[op]_|xox"),
    Detector(5, "KEY", 5, r"(?U)Bearer\s+([A-Za-z0-9\-._~+/=]{16,})", ("Bearer",), r"Bearer", group=1),
    Detector(6, "KEY", 5, r"(?i)(?U)api[_-]?key\s*[:=]\s*['\"]?([A-Za-z0-9\-_]{16,})['\"]?", (ANY_CASE + "api",), r"(?i)api[_-]?key", group=1),
    Detector(7, "UUID", 4, r"(?U)\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\b", ("-",), r"[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-"),
    Detector(8, "IBAN", 4, r"(?U)\b[A-Z]{2}\d{2}[A-Z0-9]{11,28}\b", (DIGIT,), r"(?U)[A-Z]{2}\d{2}[A-Z0-9]{11}", check="iban"),
    Detector(9, "CARD", 4, r"(?U)\b(?:\d[ \-]?){13,19}\b", (DIGIT,), r"(?U)\d[ \-]?\d[ \-]?\d[ \-]?\d[ \-]?\d[ \-]?\d[ \-]?\d", trim="card", check="luhn"),
    Detector(10, "IP", 3, r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b", (DIGIT,), r"(?U)\d\.\d{1,3}\.\d", check="ipv4"),
    Detector(11, "IP", 3, r"(?i)(?U)\b(?:[0-9A-F]{0,4}:){2}[0-9A-F:.]+\b", (":",), r":[0-9A-Fa-f]{0,4}:", trim="punct", check="ipv6"),
    Detector(12, "PHONE", 2, r"(?U)(?:\+\d[\d\s().\-]{6,18}\d|\(\d{3}\)\s?\d{3}[-.\s]?\d{4}|\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b|\b(?:91[6-9]\d{9}|0[6-9]\d{9}|[6-9]\d{9})\b)", (DIGIT,), r"(?U)\d[\d\s().\-]{5}", check="phone"),
    Detector(13, "MONEY", 1, r"(?U)[$€£₹]\s?\d[\d,]*+(?:\.\d{1,2})?|(?<!(?<!\.)\b\d[\d,]{0,64})\b\d[\d,]*+\.\d{2}\s?(?:USD|EUR|INR|GBP)\b", (DIGIT,), r"[$€£₹]|USD|EUR|INR|GBP", opt_in=True, plain=r"(?U)[$€£₹]\s?\d[\d,]*(?:\.\d{1,2})?|\b\d[\d,]*\.\d{2}\s?(?:USD|EUR|INR|GBP)\b"),
    Detector(14, "DATE", 1, r"(?U)\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", (DIGIT,), r"(?U)\d[/-]\d", check="date", opt_in=True),
)
# Text that looks like an alias; priorities; limits; names of kinds as they are shown.
ALIAS = r"(?i)(?U)\b[A-Z][A-Z_]*_\d+\b"
TERM_PRIORITY, TERM_ORDER = 7, 15
NAME_PRIORITY, NAME_ORDER = 3, 16
MAX_BYTES, MAX_LIVE, IDLE_SECONDS, MAX_UNKNOWN = 100_000, 10_000, 1_800, 20
KIND_NAMES = {
    "EMAIL": "Email", "PHONE": "Phone", "URL": "Link", "IP": "IP address", "CARD": "Payment card", "IBAN": "Bank account", "KEY": "Secret",
    "UUID": "ID", "PERSON": "Person", "ORG": "Organization", "LOC": "Location", "TERM": "Custom term", "MONEY": "Amount", "DATE": "Date",
}
BY_ORDER = {d.order: d for d in DETECTORS}
