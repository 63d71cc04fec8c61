"""Splitting texts by the byte-level pattern, fast where the characters allow."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

#: The pattern of byte-level pre-tokenizers with use_regex (a fixed value).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that have had the same classes in all Unicode versions that libraries use today.
STABLE = ((0, 0x24F), (0x391, 0x3A1), (0x3A3, 0x3FF), (0x400, 0x45F), (0x2010, 0x2027), (0x2030, 0x203A))


@functools.cache
def stable_splitter() -> tuple[Callable, Callable]:
    """(does a text hold STABLE characters only, its matches of BYTE_LEVEL): the classes written out for Python's re."""
    import regex

    def members(pattern: str) -> str:
        match = regex.compile(pattern).fullmatch
        return "".join(re.escape(chr(c)) for a, b in STABLE for c in range(a, b + 1) if match(chr(c)))

    letter, number, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    split = rf"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    every = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in STABLE)
    return re.compile(f"[{every}]*").fullmatch, re.compile(split).findall


@functools.lru_cache(4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a text."""
    import regex

    general = regex.compile(pattern).findall
    if pattern != BYTE_LEVEL:
        return general
    stable, fast = stable_splitter()
    return lambda text: fast(text) if stable(text) else general(text)
