"""Cutting texts at places where byte-level BPE always starts a new piece.

A space that is followed by a character that isn't white space starts a piece of PATTERN whatever stands around
it: the alternatives that could hold the space further inside match white space only, and leave the last white
space before other characters. So a text's ids are the ids of its first segment and of " " + each later segment,
one after the other. Most segments are words that come again and again, and their ids are kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Python's \s holds all white space of the pattern (and a few characters more, at which nothing is cut).
_UNSAFE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")
#: Longer segments are encoded each time; the two generations hold up to 2 * CACHED segments.
LONGEST, CACHED = 48, 400_000


def segments(text: str) -> list[str]:
    """The text cut at each single space that precedes other than white space; these spaces are left out."""
    return text.split(" ") if _UNSAFE.search(text) is None else _CUT.split(text)


class SegmentCache:
    """Ids of segments as little-endian bytes, for one worker; encode gets a list of distinct strings at a time."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], cached: int = CACHED):
        self.encode, self.cached = encode, cached
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; empty texts have none."""
        parts = [segments(t) for t in texts]
        need: set[str] = set()
        for p in parts:
            need.update(p)
        young, old = self.young, self.old
        need.difference_update(young)
        again = need.intersection(old) if old else ()
        for s in again:
            young[s] = old[s]
        need.difference_update(again)
        first = list({p[0] for p in parts})
        long = [s for s in need if len(s) > LONGEST]
        short = [s for s in need if len(s) <= LONGEST]
        got = self.encode([" " + s for s in short] + [" " + s for s in long] + first)
        young.update(zip(short, got))
        now = dict(zip(long, got[len(short):]))
        head = dict(zip(first, got[len(short) + len(long):]))
        find = young.__getitem__ if not now else (lambda s: now[s] if s in now else young[s])
        out = [b"".join([head[p[0]], *map(find, p[1:])]) for p in parts]
        if len(young) > self.cached:
            self.old, self.young = young, {}
        return out
