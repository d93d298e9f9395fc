"""Text primitives: trimming, first matches, keywords and predicates, all built-in expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that no keyword may be.
STOP_WORDS = ["how", "do", "i", "the", "a", "an", "to", "in", "for", "create", "make", "write", "add", "new"]
#: Words that no suggested tag may be.
TAG_STOP_WORDS = ["create", "make", "build", "write"]
#: What a reply with code contains.
CODE_SIGNS = ["```", "class ", "function ", "public ", "export "]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_all(c: Column) -> Column:
    """Blanks of every kind off both ends: tabs, line ends, no-break spaces and byte order marks too, but no controls."""
    blank = r"[\t\n\x0B\f\r\p{Z}\x{FEFF}]+"
    return F.regexp_replace(c, f"^{blank}|{blank}$", "")


def non_empty(c: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(c, F.lit(""))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none."""
    return non_empty(F.regexp_extract(c, pattern, group))


def first_upper(c: Column) -> Column:
    """The first letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2147483647))


def contains_any(c: Column, needles: list[str]) -> Column:
    found = c.contains(needles[0])
    for needle in needles[1:]:
        found = found | c.contains(needle)
    return found


def keywords(c: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """The distinct lower-case words of more than two letters that are no stop words, in order.

    A null text has no keywords.
    """
    words = F.split(F.regexp_replace(F.lower(c), r"[^\w\s]", " "), r"\s+")
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.coalesce(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))), F.array().cast("array<string>"))


def contains_code(c: Column) -> Column:
    """Whether a reply looks as if it held code; false for null."""
    return F.coalesce(contains_any(c, CODE_SIGNS), F.lit(False))


def tag_list(c: Column, keep_empty: bool = False) -> Column:
    """The trimmed parts of a comma-separated text; empty parts are dropped unless kept. Null and empty give none."""
    parts = F.transform(F.split(c, ","), trim_all)
    if not keep_empty:
        parts = F.filter(parts, lambda x: F.length(x) > 0)
    return F.when(F.length(c) > 0, parts).otherwise(F.array().cast("array<string>"))


def preview(c: Column, limit: int = 500) -> Column:
    """At most ``limit`` characters, followed by how many were cut."""
    cut = F.concat(F.substring(c, 1, limit), F.lit("\n\n... [truncated "), (F.length(c) - limit).cast("string"), F.lit(" characters]"))
    return F.when(F.length(c) > limit, cut).otherwise(c)


def confirm_preview(c: Column, limit: int = 500) -> Column:
    """At most ``limit`` characters, followed by how many more there are, as a save is confirmed."""
    cut = F.concat(F.substring(c, 1, limit), F.lit("\n\n... ["), (F.length(c) - limit).cast("string"), F.lit(" more characters]"))
    return F.when(F.length(c) > limit, cut).otherwise(c)


def short_preview(c: Column, limit: int = 100) -> Column:
    """At most ``limit`` characters, followed by dots if there are more, as a block is picked."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def first_lines(c: Column, n: int = 30) -> Column:
    return F.array_join(F.slice(F.split(c, "\n"), 1, n), "\n")
