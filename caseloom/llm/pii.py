"""Format-preserving pseudonyms of personal data by keyed Feistel permutations.

Found values are validated (Luhn, calendar, octets, number plan), mapped to an integer of their format's domain,
permuted by a Feistel network keyed by BLAKE2b over that domain (cycle walking keeps it inside), and written back in
the same format. Equal values get equal pseudonyms in all documents, which `restore` takes back with the key.

Kinds: card (Luhn-valid, 13 to 19 digits; the check digit is made anew), phone (+country and 7 to 14 digits, North
American ones by their plan), email (letters and digits of the local part), ip (four octets), ssn, iban (mod 97), date
(ISO or d/m/y between 1900 and 2099: its day), secret (AKIA keys, values of six or more characters after a key such as
`password=` in either case, and 32 or more hex digits of one case). Local parts, secrets and hex strings have no upper
length. A letter or digit is permuted among those of its category in its aligned block of 64 code points (a to z, A to
Z, 0 to 9 in ASCII); all other characters stay.

Runs of digit groups are read as cards in their usual groups first (so an expiry, CVV or number beside a card is not
taken for a part of it), then in any groups; an IBAN or phone that fails whole is read up to an earlier group. Where
nothing at a place is valid as one kind, the other kinds and then the next places are tried.

Cases: null stays null, empty stays empty; values that fail validation or have other digits than 0 to 9 are left alone; repeated rows are treated
alike; an empty table gives an empty table; all other columns are kept by `pseudonymised`. Whole texts are searched.
Where groups can be read in several ways, or a find touches other characters of such formats, a pseudonym that would be
read in another way is permuted once more, so that `restore` finds it; there alone equal values may get other
pseudonyms. Only the cell around such a find is read again: a text is cut wherever no find can reach across, whatever
the pseudonyms (at most white space and punctuation, and between groups of digits that no valid card spans), so time is
in proportion to a text's length, however many finds it has; in one cell it grows with finds times its length.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
_MARK = re.compile(r"[0-9@]|AKIA|[=:]")
_KEY = r"""(?i:password|passwd|pwd|secret|token|api[_-]?key)["']?\s?[=:]\s?["']?"""
#: Where the kinds may be; each find is validated. E-mail addresses are found from their @ back.
_KINDS = {
    "password": r"(?<![A-Za-z0-9])" + _KEY + r"""[^\s"'<>]{6,}""",
    "aws": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "iso": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "dmy": r"(?<![\d/])\d{1,2}/\d{1,2}/\d{4}(?![\d/])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d+])\d(?:[ -]?\d){12,18}(?![\d])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
}
_DOMAIN = re.compile(r"@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}")
_LOCAL = re.compile("[A-Za-z0-9._%+\u00c0-\u024f\u0370-\u052f-]*")
_ORDER = list(_KINDS)
_ONE = {k: re.compile(p) for k, p in _KINDS.items()}
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS.items()))
_REST = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS.items() if k != "card"))
#: Groups of digits; after a space, what has the form of a date, ssn or phone number begins another run.
_RUN = re.compile(r"\d+(?:(?:-| (?!(?:\d{4}-\d\d-\d\d|\d{3}-\d\d-\d{4}|\d{3}-\d{3}-\d{4})(?![\d-])))\d+)*")
_GROUP = re.compile(r"\d+")
#: Groups of digits as cards are written; the first that holds wins.
_SHAPES = [(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)]
PIECE = 64
#: Where texts may be cut, a value after = or : (in which punctuation is no cut), and what may begin finds with spaces.
_CUT = re.compile(r"""[<>]|(?<![=:])(?<![=:].)[\s"'](?![=:]|.[=:])|[,;|!?#&*\[\]{}]""", re.S)
_VALUE = re.compile(r"""(?:[=:]\s?["']?[^\s"'<>=:]*)+""")
_NUMBERS = re.compile(r"\d \d")
_SPACED, _ENDS, _BEGINS = re.compile(r"[+(A-Z]"), re.compile(r"[A-Z\d)]"), re.compile(r"[A-Z\d(]")
#: Characters that a card can reach: 19 digits and what stands between them.
REACH = 40
#: What may stand beside a find and be read with its pseudonym.
_GLUED, _BEFORE = re.compile(r"[\w/@-]|\.\w"), frozenset("_.+/@-")
_FIRST, _DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal() - dt.date(1900, 1, 1).toordinal() + 1


def feistel(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0..size-1."""
    if size < 2:
        return x
    a = int(size**0.5) if size < 2**52 else 1 << (size.bit_length() // 2)
    a = max(a, 2)
    b = -(-size // a)

    def pseudo(n: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{size}|{n}|{half}".encode(), key=key[:64], digest_size=16 + size.bit_length() // 16).digest(), "big")

    while True:
        left, right = divmod(x, b)
        for n in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if n % 2:
                right = (right + sign * pseudo(n, left)) % b
            else:
                left = (left + sign * pseudo(n, right)) % a
        x = left * b + right
        if x < size:
            return x


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


@lru_cache(4096)
def _like(c: str) -> str:
    """The characters that c may become."""
    kind, low = unicodedata.category(c), ord(c) & ~63
    return "".join(x for x in map(chr, range(low, low + 64)) if unicodedata.category(x) == kind) if kind[0] == "L" or kind == "Nd" else c


def _hex_digits(value: str) -> str | None:
    """The digits of a string of 12 or more hex digits of one case."""
    if len(value) < 12:
        return None
    return next((d for d in ("0123456789abcdef", "0123456789ABCDEF") if not value.strip(d)), None) if value.isascii() and value.isalnum() and not re.search(r"[g-zG-Z]", value) else None


def _pieces(value: str, key: bytes, tweak: str, back: bool, hexed: str | None) -> str:
    """One permutation of the strings with value's classes of characters. Long ones go piece by piece, each under the
    digest of the new pieces before it."""
    if len(value) > PIECE:
        seen, done = hashlib.blake2b(f"{tweak}|{len(value)}".encode(), key=key[:64], digest_size=16), []
        for i in range(0, len(value), PIECE):
            done.append(_pieces(value[i:i + PIECE], key, tweak + seen.hexdigest(), back, hexed))
            seen.update((value[i:i + PIECE] if back else done[-1]).encode("utf-8", "replace"))
        return "".join(done)
    sets = [hexed or _like(c) for c in value]
    size, x = 1, 0
    for c, s in zip(value, sets):
        x, size = x * len(s) + s.index(c), size * len(s)
    x = feistel(x, size, key, tweak + "|" + "".join(s[0] for s in sets), back)
    out = []
    for s in reversed(sets):
        x, i = divmod(x, len(s))
        out.append(s[i])
    return "".join(reversed(out))


def _mixed(value: str) -> bool:
    return not value.isdigit() and any(c.isdigit() for c in value)


def _by_class(value: str, key: bytes, tweak: str, back: bool) -> str:
    """Permute a string among those with the same classes of characters at the same places. Hex secrets stay hex, and
    others don't become hex: what would is permuted again. So are hex strings that would lose all letters or digits."""
    secret = tweak in ("secret", "hex")
    hexed = _hex_digits(value) if secret else None
    while True:
        value = _pieces(value, key, tweak, back, hexed)
        if not secret or (_hex_digits(value) == hexed and (tweak == "secret" or _mixed(value))):
            return value


def _form(day: str, month: str) -> str:
    """How a day and its month are written: with two digits each, without zeros in front, or one of both ways."""
    if len(day) == len(month) == 2:
        return "wide"
    return "day" if day[0] == "0" else "month" if month[0] == "0" else "narrow"


def _date(day: str, month: str, year: str, key: bytes, back: bool) -> dt.date | None:
    try:
        at = dt.date(int(year), int(month), int(day)).toordinal() - _FIRST
    except ValueError:
        return None
    return dt.date.fromordinal(_FIRST + feistel(at, _DAYS, key, "date", back)) if 0 <= at < _DAYS else None


def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> tuple[str, str] | None:
    """(kind, pseudonym) of a found value, or None if it fails validation."""
    if kind not in ("password", "email") and not value.isascii():
        return None  # other digits than 0 to 9
    digits = re.sub(r"\D", "", value)
    if kind == "email":
        local, _, domain = value.partition("@")
        return "email", _by_class(local, key, "email", back) + "@" + domain
    if kind == "password":
        head = re.match(_KEY, value)[0]
        new = _by_class(value[len(head):], key, "secret", back)
        return ("secret", head + new) if any(len(_like(c)) > 1 for c in new) else None
    if kind == "aws":
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        x = feistel(sum(alphabet.index(c) * 36**i for i, c in enumerate(value[4:])), 36**16, key, "aws", back)
        return "secret", "AKIA" + "".join(alphabet[x // 36**i % 36] for i in range(16))
    if kind == "hex":
        return ("secret", _by_class(value, key, "hex", back)) if _mixed(value) else None
    if kind == "iban":
        plain = value.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = _by_class(plain[4:], key, "iban" + plain[:2], back)
        whole = plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body
        it = iter(whole)
        return "iban", "".join(c if c == " " else next(it) for c in value)
    if kind == "ip":
        octets = value.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        sizes, low = {1: 10, 2: 90, 3: 156}, {1: 0, 2: 10, 3: 100}  # octets keep their number of digits
        x, size = 0, 1
        for o in octets:
            x, size = x * sizes[len(o)] + int(o) - low[len(o)], size * sizes[len(o)]
        x = feistel(x, size, key, "ip" + "".join(str(len(o)) for o in octets), back)
        out = []
        for o in reversed(octets):
            x, d = divmod(x, sizes[len(o)])
            out.append(str(d + low[len(o)]))
        return "ip", ".".join(reversed(out))
    if kind == "iso":
        new = _date(value[8:], value[5:7], value[:4], key, back)
        return new and ("date", new.isoformat())
    if kind == "dmy":
        d, m, y = value.split("/")
        form, wide = _form(d, m), _form(d, m) == "wide"
        zeros = [2 if wide or x[0] == "0" else 1 for x in (d, m)]
        while new := _date(d, m, y, key, back):  # days that are written otherwise are permuted again
            d, m, y = f"{new.day:0{zeros[0]}d}", f"{new.month:0{zeros[1]}d}", str(new.year)
            if _form(d, m) == form:
                return "date", f"{d}/{m}/{y}"
        return None
    if kind == "ssn":
        area, group, serial = (int(x) for x in value.split("-"))
        valid = lambda a: a not in (0, 666) and a < 900
        if not valid(area) or not group or not serial:
            return None
        areas = [a for a in range(1, 900) if a != 666]
        x = feistel((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, key, "ssn", back)
        return "ssn", f"{areas[x // 9999 // 99]:03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"
    if kind == "card":
        if _luhn(digits) or len(set(digits)) == 1:
            return None
        body = f"{feistel(int(digits[:-1]), 10 ** (len(digits) - 1), key, 'card', back):0{len(digits) - 1}d}"
        if len(set(body)) == 1:
            return None
        return "card", _refill(value, body + str(-_luhn(body + "0") % 10))
    if kind == "phone":
        country = re.match(r"\+\d{1,3}(?=[ .-]|\()", value)
        head = re.sub(r"\D", "", country[0]) if country else ("1" if value[:2] == "+1" and len(digits) == 11 else "")
        rest = digits[len(head):]
        if not 7 <= len(rest) <= 14 and not (not head and len(rest) == 10):
            return None
        if len(rest) == 10 and head in ("", "1") and rest[0] in "23456789" and rest[3] in "23456789":
            x = ((int(rest[:3]) - 200) * 800 + int(rest[3:6]) - 200) * 10_000 + int(rest[6:])
            x = feistel(x, 800 * 800 * 10_000, key, "nanp", back)
            rest = f"{x // 10_000 // 800 + 200}{x // 10_000 % 800 + 200}{x % 10_000:04d}"
        elif value[0] == "+":
            rest = f"{feistel(int(rest), 10 ** len(rest), key, 'phone' + head, back):0{len(rest)}d}"
        else:
            return None
        return "phone", _refill(value, head + rest)
    raise ValueError(kind)


def valid(kind: str, value: str) -> bool:
    """Whether a find's digits, dates and check sums hold."""
    if kind in ("iban", "card") and not value.isascii():
        return False
    if kind == "iban":
        plain = value.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        return not _luhn(digits) and len(set(digits)) > 1
    return kind in ("email", "aws") or pseudonym(kind, value, b"0" * 32) is not None


def _readings(groups: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """First and last of neighbouring groups that have as many digits as a card, and how many."""
    for i in range(len(groups)):
        n = 0
        for j in range(i, len(groups)):
            n += groups[j][1] - groups[j][0]
            if n > 19:
                break
            if n >= 13:
                yield i, j, n


def _cards(text: str, start: int) -> tuple[list[tuple[int, int]], int, bool]:
    """The cards in the run of digit groups at start, the run's end, and whether it can be read in several ways."""
    run = _RUN.match(text, start)
    groups = [g.span() for g in _GROUP.finditer(text, start, run.end())]
    tried = []
    for i, j, n in _readings(groups):
        shape = tuple(b - a for a, b in groups[i:j + 1])
        rank = _SHAPES.index(shape) if shape in _SHAPES else len(_SHAPES) + (len(shape) > 1)
        tried.append((rank, i, -n, j))
    taken, out = set(), []
    for _, i, _, j in sorted(tried):
        at = groups[i][0], groups[j][1]
        if taken.isdisjoint(range(i, j + 1)) and valid("card", text[at[0]:at[1]]):
            taken.update(range(i, j + 1))
            out.append(at)
    return sorted(out), run.end(), len(tried) > 1 or (len(tried) == 1 and len(groups) > tried[0][3] - tried[0][1] + 1)


def _email(text: str, at: int, end: int) -> tuple[int, int, int] | None:
    """(start, place of @, end) of what first has the form of an e-mail address; its local part reaches back to at."""
    for m in _DOMAIN.finditer(text, at, end):
        n = _LOCAL.match(text[at:m.start()][::-1]).end()
        if n:
            return m.start() - n, m.start(), m.end()
        at = m.start() + 1
    return None


def finds(text: str, at: int = 0, end: int | None = None, cards: bool = True) -> tuple[list[tuple[str, int, int]], bool]:
    """(kind, start, end) of the valid values in order, and whether some groups can be read in several ways."""
    end, out, several, none_before = len(text) if end is None else end, [], False, 0
    mail = _email(text, at, end)
    while True:
        m = (_FIND if cards else _REST).search(text, at, end)
        if mail and mail[1] <= at:
            mail = _email(text, at, end)
        if mail and (m is None or mail[0] <= m.start()):
            out.append(("email", max(at, mail[0]), mail[2]))
            at = mail[2]
            continue
        if m is None:
            return out, several
        start, first, here = m.start(), m.lastgroup, []
        for kind in _ORDER[_ORDER.index(first):]:
            if kind == "card" and (not cards or start < none_before):
                continue
            f = m if kind == first else _ONE[kind].match(text, start, end)
            if f is None:
                continue
            if kind == "card":
                found, stop, more = _cards(text, start)
                several |= more
                for a, b in found:
                    here += finds(text, here[-1][2] if here else start, a, False)[0] + [("card", a, b)]
                none_before = 0 if here else stop
            elif kind in ("iban", "phone"):
                ends = [f.end()] + [f.start() + c.start() for c in reversed(list(re.finditer(r"[ .-](?=\w)", f[0])))]
                ends = [e for e in ends if e == f.end() or _ONE[kind].fullmatch(text, start, e)]
                several |= len(ends) > 1 and kind == "iban"
                good = [e for e in ends if valid(kind, text[start:e])]
                if kind == "phone" and good and good[0] != ends[0] and text[start:start + 2] == "+1":
                    good.sort(key=lambda e: sum(c.isdigit() for c in text[start:e]) != 11)  # the number plan's length
                here = [(kind, start, good[0])] if good else []
            elif valid(kind, f[0]):
                here = [(kind, start, f.end())]
            if here:
                break
        out += here
        at = here[-1][2] if here else start + 1


def _crossed(text: str, at: int = 0, end: int | None = None) -> set[int]:
    """Places between groups of digits that a valid card, as some reading has it, spans."""
    out: set[int] = set()
    for run in _RUN.finditer(text, at, len(text) if end is None else end):
        groups = [g.span() for g in _GROUP.finditer(text, run.start(), run.end())]
        for i, j, _ in _readings(groups):
            if j > i and valid("card", text[groups[i][0]:groups[j][1]]):
                out.update(b for _, b in groups[i:j])
    return out


def _cells(text: str) -> list[int]:
    """The places where the text is cut, from 0 to its end. Neither a find nor what it depends on reaches across one."""
    cuts, values, hard, spaces = [], iter(_VALUE.finditer(text)), 0, []
    value = next(values, None)

    def close(end: int) -> None:
        """Between groups of digits, up to the next cut, where nothing with spaces but a card may stand."""
        if spaces:
            other, crossed = _SPACED.search(text, hard, end), _crossed(text, hard, end)
            cuts.extend(p for p in spaces if (other is None or p < other.start()) and p not in crossed)
            spaces.clear()

    for m in _CUT.finditer(text):
        p = m.start()
        if text[p] == " " and p and _ENDS.match(text, p - 1) and _BEGINS.match(text, p + 1):
            if text[p - 1].isdecimal() and text[p + 1].isdecimal():
                spaces.append(p)
            continue
        if text[p] not in "<>\"'" and not text[p].isspace():
            while value and value.end() <= p:
                value = next(values, None)
            if value and value.start() < p:
                continue
        close(p)
        cuts.append(p)
        hard = p
    close(len(text))
    return [0] * (not cuts or cuts[0] > 0) + cuts + [len(text)]


def _walked(text: str, found: list[tuple[str, int, int]], key: bytes, back: bool, left: str, right: str) -> tuple[str, list[tuple[str, int, int]]]:
    """A cell between left and right, with pseudonyms that are read at the same places and leave its cuts where they
    are, one after the other (or back from the last)."""
    for i in reversed(range(len(found))) if back else range(len(found)):
        kind, start, end = found[i]
        x, n = text[start:end], len(left)
        spans = {p for p in _crossed(left + text + right) if n <= p <= n + len(text)}
        while got := pseudonym(kind, x, key, back):
            x = got[1]
            shift = len(x) - (end - start)
            new = text[:start] + x + text[end:]
            moved = found[:i] + [(kind, start, end + shift)] + [(k, a + shift, b + shift) for k, a, b in found[i + 1:]]
            crossed = {p - shift * (p >= n + end + shift) for p in _crossed(left + new + right) if n <= p <= n + len(new)}
            if crossed == spans and finds(new)[0] == moved:
                text, found = new, moved
                break
    return text, found


def _touched(text: str, found: list[tuple[str, int, int]]) -> bool:
    return any(_GLUED.match(text, e) or (a and text[a - 1] in _BEFORE or text[a - 1:a].isalnum()) for _, a, e in found)


#: The kinds as the spans name them.
_NAMES = {"password": "secret", "aws": "secret", "hex": "secret", "iso": "date", "dmy": "date"}


def replaced(text: str | None, key: bytes, back: bool = False, known: dict | None = None) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of each in the new text."""
    if not text or _MARK.search(text) is None:
        return text, []
    known = {} if known is None else known
    found, several = finds(text)
    if not found or not (several or _touched(text, found) or _NUMBERS.search(text)):
        return _plain(text, found, key, back, known)
    cuts, done, at = _cells(text), [], 0
    holding = []  # the cells with finds
    for lo, hi in zip(cuts, cuts[1:]):
        if at < len(found) and found[at][1] < hi:
            holding.append((lo, hi))
            while at < len(found) and found[at][1] < hi:
                at += 1
    beside, last = "", len(text) if back else 0  # what the cell before (or after, on the way back) has become
    for lo, hi in reversed(holding) if back else holding:
        beside = (text[hi:min(last, hi + REACH)] + beside)[:REACH] if back else (beside + text[max(last, lo - REACH):lo])[-REACH:]
        cell = text[lo:hi]
        own, several = finds(cell)
        if several or _touched(cell, own) or _NUMBERS.search(text, max(0, lo - 1), hi + 2):
            left, right = (text[max(0, lo - REACH):lo], beside) if back else (beside, text[hi:hi + REACH])
            new, own = _walked(cell, own, key, back, left, right)
            spans = [(_NAMES.get(k, k), a, b - a) for k, a, b in own]
        else:
            new, spans = _plain(cell, own, key, back, known)
        done.append((lo, hi, new, spans))
        beside, last = (new + beside, lo) if back else (beside + new, hi)
    parts, out, size, at = [], [], 0, 0
    for lo, hi, new, spans in reversed(done) if back else done:
        parts += [text[at:lo], new]
        size += lo - at
        out += [(kind, size + start, n) for kind, start, n in spans]
        size += len(new)
        at = hi
    return "".join(parts) + text[at:], out


def _plain(text: str, found: list[tuple[str, int, int]], key: bytes, back: bool, known: dict) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with each find's first pseudonym, and (kind, start, length) of each."""
    parts, spans, at, size = [], [], 0, 0
    for kind, start, end in found:
        value = text[start:end]
        got = known.get((kind, value), False)
        if got is False:
            if len(known) > 50_000:
                known.clear()
            got = known[kind, value] = pseudonym(kind, value, key, back)
        if got is None:
            continue
        parts += [text[at:start], got[1]]
        size += start - at
        spans.append((got[0], size, len(got[1])))
        size += len(got[1])
        at = end
    return ("".join(parts) + text[at:] if parts else text), spans


def pseudonymised(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str | None = "pii", back: bool = False) -> DataFrame:
    """docs with text_col replaced; spans_col, unless None, gets array<struct<kind,start,length>> of the pseudonyms."""

    @F.pandas_udf("text string, spans array<struct<kind:string,start:int,length:int>>")
    def run(col: pd.Series) -> pd.DataFrame:
        known: dict = {}
        got = [replaced(t, key, back, known) for t in col]
        return pd.DataFrame({"text": pd.Series([g[0] for g in got], dtype=object), "spans": pd.Series([[{"kind": k, "start": s, "length": n} for k, s, n in g[1]] for g in got], dtype=object)})

    @F.pandas_udf("string")
    def only(col: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([replaced(t, key, back, known)[0] for t in col], dtype=object)

    if spans_col is None:
        return docs.withColumn(text_col, only(F.col(text_col)))
    at = "_pseudonyms"
    while at in docs.columns:
        at += "_"
    done = docs.withColumn(at, run(F.col(text_col)))
    return done.withColumns({text_col: F.col(f"{at}.text"), spans_col: F.col(f"{at}.spans")}).drop(at)


def restore(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Take the pseudonyms back; every kind's format is found again, as its pseudonyms are valid values."""
    return pseudonymised(docs, key, text_col, None, back=True)
