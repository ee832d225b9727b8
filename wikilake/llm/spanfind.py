"""Leftmost, non-overlapping spans of the fixed kinds of personal data and secrets, in linear time.

A failed start inside a run of digits or letters fails for every later start in that run,
so those are not tried.
Offsets are code points; ends are exclusive.
"""

from __future__ import annotations

import re

Span = tuple[int, int]

# The patterns of the contract.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ASSIGN = re.compile(r"(?ai)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"[0-9a-f]++")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}+")


def emails(text: str) -> list[Span]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if local else None
        if m:
            out.append((at - local, m.end()))
            free = m.end()
        else:
            free = at + 1  # no local part holds an @
        at = text.find("@", free)
    return out


def _number(digits: str) -> bool:
    return len(digits.lstrip("0")) <= 3 and int(digits.lstrip("0") or 0) <= 255


def ips(text: str) -> list[Span]:
    out = []
    for m in _DOTTED.finditer(text):  # a dotted run holds one match in each four parts
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_number, four)):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []


def assigns(text: str) -> list[Span]:
    return [m.span() for m in _ASSIGN.finditer(text) if len(m[1]) >= 6] if "=" in text or ":" in text else []


def accesses(text: str) -> list[Span]:
    return [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []


def hexes(text: str) -> list[Span]:
    return [m.span() for m in _LONG_HEX.finditer(text)]


PERSONAL = (("email", emails), ("ip", ips), ("card", cards), ("phone", phones))
SECRET = (("assign", assigns), ("access", accesses), ("hex", hexes))


def find(text: str, kinds) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), by start, then kind."""
    return sorted((s, k, e) for k, (_, f) in enumerate(kinds) for s, e in f(text))
