"""Formats as regular expressions that Java's and Python's engines read alike. Unknown formats pass."""

from __future__ import annotations

import re

_DATE = r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
_CLOCK = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?"
_ZONE = r"(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"

#: Each is matched against the whole text.
FORMATS: dict[str, str] = {
    # An at sign that is neither first nor last, and a dot two places after it at the least.
    "email": r"(?s)[^@]+@[^.].*\..*",
    "date": _DATE,
    "date-time": f"{_DATE}T{_CLOCK}{_ZONE}",
    "time": rf"{_CLOCK}(?:Z|[+-][0-9]{{2}}:[0-9]{{2}})?",
    "duration": r"P(?!\z)(?:[0-9]+Y)?(?:[0-9]+M)?(?:[0-9]+W)?(?:[0-9]+D)?(?:T(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+(?:\.[0-9]+)?S)?)?",
    "uri": r"(?s)[a-zA-Z][a-zA-Z0-9+.-]*:.*",
    "uri-reference": r"[^\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+",
    "ipv4": rf"{_OCTET}(?:\.{_OCTET}){{3}}",
    "ipv6": r"[0-9a-fA-F]*(?::[0-9a-fA-F]*){2,7}",
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "hostname": rf"{_LABEL}(?:\.{_LABEL})*+",
}


def java(name: str) -> str:
    return rf"\A(?:{FORMATS[name]})\z"


def matches(name: str, text: str) -> bool:
    return re.search(r"\A(?:" + FORMATS[name].removeprefix("(?s)").replace(r"\z", r"\Z") + r")\Z", text, re.S if FORMATS[name].startswith("(?s)") else 0) is not None
