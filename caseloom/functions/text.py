"""Column functions over text: stable ids, spans with exact character offsets, normal forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN, _CLOSE = "\u0001", "\u0002"


def stable_id(prefix: str, *parts: Column | str, size: int = 24) -> Column:
    """prefix and the first hex digits of SHA-256 over the parts joined by colons."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, size))


def name_uuid(name: Column) -> Column:
    """The version 5 UUID of a name in the URL name space."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def folded(text: Column) -> Column:
    """Lower case for comparison, with the German sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normal(text: Column) -> Column:
    """White space collapsed, marks at both ends taken off, folded."""
    return folded(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[ ,.;:-]+|[ ,.;:-]+$", ""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row. Inside a lambda, an expression is computed again for each element, and
    the optimizer puts columns back in the place where they are used; a lambda's own variable stays as it is."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column, run: int = 256) -> Column:
    """The sums of all values before each one, for an array of int: within runs of bounded length first, since appending
    copies an array, then over the runs."""

    def sums(a: Column) -> Column:
        return F.aggregate(a, F.array().cast("array<int>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.get(s, F.size(s) - 1), F.lit(0)) + x)))

    def joined(a: Column) -> Column:
        ends = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(a) - 1) / run), F.lit(0)).cast("int")), lambda k: sums(F.slice(a, k * run + 1, run)))
        return let(ends, lambda e: let(sums(F.transform(e, lambda r: F.coalesce(F.get(r, F.size(r) - 1), F.lit(0)))), lambda whole: F.flatten(F.transform(e, lambda r, k: F.transform(r, lambda x: x + F.coalesce(F.get(whole, k - 1), F.lit(0)))))))

    return let(values, lambda v: let(joined(v), lambda ends: F.zip_with(ends, v, lambda e, x: e - x)))


def spans(text: Column, pattern: str, replacement: str = _OPEN + "$0" + _CLOSE) -> Column:
    """array<struct<start,end,quote,before>>: matches with offsets in code points. A replacement that puts the marks
    round one group narrows the spans to it; before is the text between the last mark and this one. The text is searched
    once and cut at its matches; offsets are sums over the pieces, so the time grows with the text and its matches."""

    def made(parts: Column) -> Column:
        starts = running_sums(F.transform(parts, lambda p: F.length(F.replace(p, F.lit(_CLOSE), F.lit("")))))
        return let(starts, lambda at: F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: let(F.get(parts, i), lambda p: let(F.instr(p, _CLOSE) - 1, lambda n: F.struct(F.get(at, i).alias("start"), (F.get(at, i) + n).alias("end"), F.substring(p, F.lit(1), n).alias("quote"), F.get(parts, i - 1).alias("before"))))))

    none = F.array().cast("array<struct<start:int,end:int,quote:string,before:string>>")
    return let(F.split(F.regexp_replace(text, pattern, replacement), _OPEN, -1), lambda parts: F.when(F.size(parts) > 1, made(parts)).otherwise(none))


def terms(text: Column) -> Column:
    """Folded words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def excerpt(text: Column, limit: int) -> Column:
    """White space collapsed; longer texts end in three dots within the limit."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(clean) > limit, F.concat(F.rtrim(F.substring(clean, 1, limit - 3)), F.lit("..."))).otherwise(clean)
