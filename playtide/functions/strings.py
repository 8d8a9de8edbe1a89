"""Scalar text functions of the data model, as plain Python.

Comparison keys need Unicode normal forms, which Spark has no built-in for; these functions run
inside Arrow batches over distinct strings (see keys.py).  White space, apostrophes and word
boundaries are spelled out, since Java, Python and RE2 each mean something else by them.
"""

from __future__ import annotations

import difflib
import unicodedata
from functools import lru_cache

import regex

# Fixed values.
SPACE = "\t\n\x0b\x0c\r \xa0  -     　﻿"  # as a character class
APOSTROPHES = "‘’ʼ`´"
NO_ALBUM = "(no album)"
SEPARATOR = "␟"

_SPACES = regex.compile(f"[{SPACE}]+")
EDGE = SPACE.replace(" - ", "".join(map(chr, range(0x2000, 0x200B))))
_APOSTROPHES = str.maketrans(dict.fromkeys(APOSTROPHES, "'"))
_MARKS = regex.compile(r"\p{M}+")
_OTHER = regex.compile(rf"[^\p{{L}}\p{{N}}{SPACE}']")
_OTHER_BUT_MARKS = regex.compile(rf"[^\p{{L}}\p{{N}}\p{{M}}{SPACE}']")
_OTHER_NO_QUOTE = regex.compile(rf"[^\p{{L}}\p{{N}}{SPACE}]")
_AROUND = regex.compile(rf"[{SPACE}]*([^\p{{L}}\p{{N}}\p{{M}}{SPACE}'])[{SPACE}]*")
_DIGITS = regex.compile("[0-9]+")


def squeeze(text: str) -> str:
    """White-space runs become one space; none at the ends."""
    return _SPACES.sub(" ", text).strip(" ")


def trim(text: str) -> str:
    return text.strip(EDGE)


@lru_cache(maxsize=65536)
def norm(text: str | None) -> str:
    """Loose key: compatibility form, no marks, letters, digits and apostrophes only, lower case."""
    if not text:
        return ""
    folded = unicodedata.normalize("NFKD", text).translate(_APOSTROPHES)
    return squeeze(_OTHER.sub(" ", _MARKS.sub("", folded)).lower())


def norm_artist(text: str | None) -> str:
    """norm() without a leading article."""
    return norm(text).removeprefix("the ")


@lru_cache(maxsize=65536)
def norm_title(text: str | None) -> str:
    """Key of a title: like norm() but composed, with marks kept."""
    if not text:
        return ""
    return squeeze(_OTHER_BUT_MARKS.sub(" ", unicodedata.normalize("NFC", text).translate(_APOSTROPHES)).lower())


@lru_cache(maxsize=65536)
def track_identity(text: str | None) -> str:
    """Key of a track: symbols kept, the white space around them not."""
    if not text:
        return ""
    return _AROUND.sub(r"\1", squeeze(unicodedata.normalize("NFC", text).translate(_APOSTROPHES).lower()))


def norm_release(text: str | None) -> str:
    """Key of release services: like norm(), apostrophes dropped too."""
    folded = unicodedata.normalize("NFKD", (text or "").lower())
    return squeeze(_OTHER_NO_QUOTE.sub(" ", _MARKS.sub("", folded)))


def units(text: str) -> str:
    """The text as UTF-16 code units, one character each."""
    if text.isascii() or max(text) <= "￿":
        return text
    raw = text.encode("utf-16-le", "surrogatepass")
    return "".join(chr(raw[i] | raw[i + 1] << 8) for i in range(0, len(raw), 2))


def similar(a: str, b: str) -> float:
    """Twice the matching characters over all; the longest common run first, then both sides.

    Not symmetric: on equal runs the first in a, then in b, is taken.
    """
    a, b = units(a), units(b)
    if not a and not b:
        return 1.0
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def typo_budget(a: str, b: str) -> int:
    """One edit for each ten characters of the longer name, at least one."""
    return max(1, max(len(units(a)), len(units(b))) // 10)


def edit_distance(a: str, b: str, limit: int = 2) -> int:
    """Edits between a and b, or limit + 1 if there are more."""
    a, b = units(a), units(b)
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row[-1], limit + 1)


def digits_only_differ(a: str | None, b: str | None) -> bool:
    """Whether two names are the same but for their numbers."""
    x, y = norm(a), norm(b)
    if x == y or squeeze(_DIGITS.sub("#", x)) != squeeze(_DIGITS.sub("#", y)):
        return False
    return _DIGITS.findall(x) != _DIGITS.findall(y)


def case_only(a: str | None, b: str | None) -> bool:
    return unicodedata.normalize("NFC", a or "").lower() == unicodedata.normalize("NFC", b or "").lower()


def last_word(text: str) -> tuple[str, str]:
    """(what comes before, last word), white space squeezed."""
    before, _, last = squeeze(text).rpartition(" ")
    return before, last


def redact(text: str) -> str:
    """Keys and tokens out of a message, which is then cut."""
    text = regex.sub(r"[a-fA-F0-9]{32}", "[redacted-key]", text)
    text = regex.sub(rf"(?i)Bearer[{SPACE}]+[A-Za-z0-9_.-]+", "Bearer [redacted]", text)
    return regex.sub(r"[A-Za-z0-9_-]{40,}", "[redacted-token]", text)[:300]


def human_bytes(n: float | None) -> str:
    if n is None:
        return "unknown"
    unit = 0
    while n >= 1024 and unit < 3:
        n, unit = n / 1024, unit + 1
    return f"{n:.{1 if n < 10 and unit else 0}f} {('B', 'KB', 'MB', 'GB')[unit]}"
