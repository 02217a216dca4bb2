"""Column expressions that the editorial operators share. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as an editor means it: with the two non-breaking spaces.
BLANK = r"[\s  ]"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
DIGITS = "0123456789"
#: Letters that lose their mark in fuzzy keys, and what stands for them.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNMARKED = "aaaaaaceeeeiiiinooooouuuuyy"


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def words(c: Column | str) -> Column:
    return F.filter(F.split(c, rf"{BLANK}+"), lambda w: w != "")


def folded(c: Column | str) -> Column:
    """Key of fuzzy comparison: stripped, lower case, without diacritics, ligatures undone."""
    out = F.translate(F.lower(strip(c)), MARKED, UNMARKED)
    for src, dst in (("ﬁ", "fi"), ("ﬂ", "fl"), ("¹", "1"), ("²", "2"), ("³", "3"), ("…", "...")):
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def key(c: Column | str) -> Column:
    """Key of exact comparison: stripped, lower case."""
    return F.lower(strip(c))


def count_of(text: Column, part: Column) -> Column:
    """Occurrences of a part in a text, not overlapping; none of an empty part."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(0).cast("int")


def cut(c: Column | str, n: int) -> Column:
    return F.substring(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), 1, n)


def has_any(c: Column, phrases: list[str]) -> Column:
    found = [F.contains(c, F.lit(p)) for p in phrases]
    return reduce(lambda a, b: a | b, found)


def mapped(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for p in values.items() for x in p))[key]


def hits(text: str, pattern: str) -> Column:
    """All matches with their places: array of (start from 0, hit), made in one pass."""
    found = f"regexp_extract_all({text}, {literal(pattern)}, 0)"
    pieces = f"split({text}, {literal(pattern)}, -1)"
    # behind the last piece there is no match
    steps = f"zip_with({found}, {pieces}, (hit, piece) -> named_struct('hit', hit, 'skip', length(piece)))"
    none = "named_struct('at', 0, 'out', cast(array() AS array<struct<start: int, hit: string>>))"
    step = "named_struct('at', acc.at + x.skip + length(x.hit), 'out', array_append(acc.out, named_struct('start', acc.at + x.skip, 'hit', x.hit)))"
    # most texts have no match, which is told without cutting them
    return F.expr(f"IF({text} RLIKE {literal(pattern)}, aggregate({steps}, {none}, (acc, x) -> IF(x.hit IS NULL, acc, {step}), acc -> acc.out), cast(array() AS array<struct<start: int, hit: string>>))")


def literal(text: str) -> str:
    """A raw SQL string literal."""
    return "r'" + text + "'" if "'" not in text else 'r"' + text + '"'
