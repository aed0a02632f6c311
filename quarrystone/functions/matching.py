"""Expressions that find, count and show matches; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line ends that are trimmed from excerpts.
BLANKS = " \t\n\r\u000b\u000c\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BEGIN, END = "\u0001", "\u0002"


def is_insensitive(pattern: str, case_insensitive: bool, smart_case: bool) -> bool:
    """Smart case: a pattern without an upper-case character ignores case."""
    return case_insensitive or (smart_case and not any(c.isupper() for c in pattern))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def java_pattern(pattern: str, literal: bool, insensitive: bool) -> str:
    """A pattern for rlike; a literal is quoted, and case is ignored for all scripts."""
    body = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E" if literal else pattern
    return ("(?iu)" if insensitive else "") + body


def found(text: Column, pattern: str, literal: bool, insensitive: bool) -> Column:
    """Whether a text has a match. An empty literal matches nothing. A sensitive literal reaches the file scan."""
    if literal:
        if not pattern:
            return F.lit(False)
        return F.lower(text).contains(F.lower(F.lit(pattern))) if insensitive else text.contains(pattern)
    return text.rlike(java_pattern(pattern, False, insensitive))


def count(text: Column, pattern: str, literal: bool, insensitive: bool) -> Column:
    """Matches from left to right without overlap."""
    if literal:
        if not pattern:
            return F.lit(0)
        t, p = (F.lower(text), F.lower(F.lit(pattern))) if insensitive else (text, F.lit(pattern))
        return F.floor((F.length(t) - F.length(F.replace(t, p))) / F.length(p)).cast("int")
    return F.regexp_count(text, F.lit(java_pattern(pattern, False, insensitive)))


def first(text: Column, pattern: str, literal: bool, insensitive: bool) -> tuple[Column, Column]:
    """(place from 1, length) of the first match."""
    if literal:
        t, p = (F.lower(text), F.lower(F.lit(pattern))) if insensitive else (text, F.lit(pattern))
        return F.position(p, t), F.length(p)
    p = F.lit(java_pattern(pattern, False, insensitive))
    return F.regexp_instr(text, p), F.length(F.regexp_substr(text, p))


def excerpt(text: Column, pattern: str, literal: bool, insensitive: bool) -> Column:
    """80 characters before the first match to 120 after it, trimmed; the first 200 characters if none is found."""
    at, length = first(text, pattern, literal, insensitive)
    begin = F.greatest(F.lit(1), at - 80)
    cut = trimmed(F.substring(text, begin, at + length + 120 - begin))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, 200))


def match_spans(text: Column, pattern: str, literal: bool, insensitive: bool) -> Column:
    """array<struct<start, length>> of all matches, start from 0. Every match is bracketed by marks in one pass of the
    regular expression, and the places are added up from the parts. Marks in the text itself count as U+FFFD."""
    clean = F.translate(text, BEGIN + END, "\ufffd\ufffd")
    marked = F.regexp_replace(clean, java_pattern(pattern, literal, insensitive), BEGIN + "$0" + END)
    parts = F.split(marked, BEGIN)
    zero = F.struct(F.length(parts[0]).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        size = F.position(F.lit(END), part) - 1
        return F.struct(
            (acc["at"] + F.length(part) - 1).alias("at"),
            F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), size.alias("length")))).alias("spans"),
        )

    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), zero, step, lambda acc: acc["spans"])
