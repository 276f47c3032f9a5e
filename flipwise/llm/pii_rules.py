"""The base rules for personal data; every one is linear in the length of the text."""

from __future__ import annotations

import re

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the tagger: those of the base rules, and keys that open an account or a service.
LABELS = (*KINDS, "secret")

_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match begins at the first digit of a run: from a later digit the same rest would have to match.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# What stands behind = or : (and a quote) as one word of letters, digits and + / _ -, long and with digits and letters mixed.
_ASSIGNED = re.compile(r"(?<=[=:])[ ]?[\"']?([A-Za-z0-9+/_-]{20,200}+)(?![A-Za-z0-9+/_-])")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """An @ with the run of name characters before it and a dotted host after it; the run starts after the last match."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and _BEFORE_AT.match(text, begin - 1):
            begin -= 1
        host = _HOST.match(text, at + 1) if begin < at else None
        if host:
            out.append((begin, host.end()))
            end = host.end()
        at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


def assigned_keys(text: str) -> list[Span]:
    """Spans that label secrets for training: values that are assigned and look drawn at random.  No base kind."""
    return [m.span(1) for m in _ASSIGNED.finditer(text) if sum("0" <= c <= "9" for c in m[1]) >= 4 and sum(c.isalpha() for c in m[1]) >= 4]


def base_spans(text: str) -> list[list[Span]]:
    """The base spans (start, end in code points) of each kind, in the order of ``KINDS``."""
    return [emails(text), ips(text), cards(text), phones(text)]
