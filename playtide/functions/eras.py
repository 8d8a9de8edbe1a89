"""How listeners tag unreleased material: markers and era names in album titles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import regex

from playtide.functions.strings import SPACE, last_word, squeeze, trim

_S = f"[{SPACE}]"
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# The words that mark unreleased material, and those that qualify an era.
STRONG = rf"{_B}(?:unreleased|unrelased|OG{_S}*files?|ref(?:erence)?{_S}*tracks?|CDQ){_E}"
WEAK = rf"{_B}(?:leak(?:s|ed)?|snippets?|outtakes?|leftovers?){_E}"
QUALIFIERS = frozenset({"era", "session", "sessions", "sesh"})

_STRONG = regex.compile(STRONG, regex.IGNORECASE)
_WEAK = regex.compile(WEAK, regex.IGNORECASE)
_MARK = regex.compile(f"{STRONG}|{WEAK}", regex.IGNORECASE)
_OPENER = regex.compile(r"[(\[]")
_CLOSER = regex.compile(r"[)\]]")


@dataclass(frozen=True)
class Era:
    explicit: bool = False
    weak: bool = False
    ambiguous: bool = False
    name: str | None = None

    @property
    def tagged(self) -> bool:
        return self.explicit or self.weak or self.ambiguous

    @property
    def undifferentiated(self) -> bool:
        return (self.explicit or self.weak) and not self.name


def _brackets(album: str) -> Iterator[tuple[int, int]]:
    """(begin, end) of each bracket, from an opener to the next closer."""
    end = 0
    while (opened := _OPENER.search(album, end)) and (closed := _CLOSER.search(album, opened.end())):
        end = closed.end()
        yield opened.start(), end


def _in_brackets(album: str) -> str | None:
    """Name before the qualifier in the first bracket that ends in one; "" if none is to be had."""
    for begin, end in _brackets(album):
        before, last = last_word(album[begin + 1 : end - 1])
        if last.lower() not in QUALIFIERS:
            continue
        if before or trim(album[end:]):
            return before
        return squeeze(_MARK.sub(" ", album[:begin], count=1))
    return None


def _bare(album: str) -> str | None:
    before, last = last_word(album)
    return before if before and last.lower() in QUALIFIERS else None


@lru_cache(maxsize=65536)
def parse(album: str | None) -> Era:
    """All that an album title says about its era."""
    if not album:
        return Era()
    bracketed = _in_brackets(album)
    explicit = bracketed is not None or bool(_STRONG.search(album))
    weak = not explicit and bool(_WEAK.search(album))
    ambiguous = not explicit and _bare(album) is not None
    name = bracketed or _bare(_MARK.sub(" ", album, count=1))
    if not name and bracketed is None and _MARK.search(album):
        name = next((t for begin, end in _brackets(album) if (t := squeeze(album[begin + 1 : end - 1]))), None)
    return Era(explicit, weak, ambiguous, name or None)
