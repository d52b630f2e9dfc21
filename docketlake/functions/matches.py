"""Regex matches with offsets, context windows and merged windows, inside Catalyst."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a plain expression inside a lambda would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def generated(df: DataFrame, **columns: Column) -> DataFrame:
    """With columns that are computed once for each row; a plain column would be put into each expression that names it, and into lambdas."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def running(sizes: Column, depth: int = 3) -> Column:
    """For each element the sum of those before it. Long arrays are summed in segments, whose offsets are carried on in the same way.

    A fold that appends to its result copies it at every step; here only segments of the cube root of the length do that.
    """

    def folded(a: Column) -> Column:
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(a, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]

    def segments(a: Column) -> Column:
        size = F.greatest(F.ceil(F.pow(F.size(a), F.lit(1 / depth))), F.lit(SHORT)).cast("int")
        count = F.ceil(F.size(a) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(a, i * size + 1, size))

    def carried(parts: Column) -> Column:
        totals = F.transform(parts, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x))
        return let(running(totals, depth - 1), lambda offset: F.flatten(F.transform(parts, lambda c, i: F.transform(folded(c), lambda x: x + F.get(offset, i)))))

    if depth == 1:
        return folded(sizes)
    return let(sizes, lambda a: F.when(F.size(a) <= SHORT, folded(a)).otherwise(let(segments(a), carried)))


SHORT = 32  # arrays that are folded in one go
PIECE = 4096  # characters of a piece of a text


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters, so that a place far in it is found without reading all before it."""
    return F.when(F.length(text) <= PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))


def around(parts: Column, start: Column, end: Column, window: int) -> Column:
    """Of a text in ``pieces``, from ``window`` characters before start to as many after end."""
    low, high = F.greatest(start - window, F.lit(0)), end + window
    first, last = F.floor(low / PIECE).cast("int"), F.floor((high - 1) / PIECE).cast("int")
    body = F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(F.array_join(F.slice(parts, first + 1, last - first + 1), ""))
    return F.substring(body, low - first * PIECE + 1, high - low)


MARK, FIELD = "\uffff", "\ufffe"  # no characters; one that stands in a text is read as the replacement character


@dataclass(frozen=True)
class Pattern:
    """A named pattern, the groups to report (0: the text "1"), and what a text must contain to be searched at all: ``needs`` as it is, ``literal`` in any case."""

    name: str
    regex: str
    groups: tuple[int, ...] = ()
    needs: str | None = None
    literal: str | None = None


def literals(pattern: str) -> list[str]:
    """Lower-cased stretches that each text matching the pattern (in any case) contains; none for choices, other scripts and flags. What stands in groups is left out."""
    pattern = pattern.removeprefix("(?i)")
    if not pattern.isascii() or re.search(r"\\Q|\(\?[a-zA-Z-]", pattern):
        return []
    runs, run, i, depth = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        size, literal = 1, None
        if c == "\\":
            literal = pattern[i + 1 : i + 2] if not pattern[i + 1 : i + 2].isalnum() else None
            size = 2
        elif c == "[":
            end = pattern.find("]", i + 2)
            size = end - i + 1 if end > 0 else len(pattern) - i
        elif c == "|" and not depth:
            return []
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c not in ".^$*+?{}|":
            literal = c
        elif c == "{" and "}" in pattern[i:]:
            size = pattern.find("}", i) - i + 1
        follows = pattern[i + size : i + size + 1]
        if depth or literal is None or follows in ("?", "*", "{", "+"):
            runs.append(run + (literal if literal and not depth and follows == "+" else ""))
            run = ""
        else:
            run += literal
        i += size
    return [r.lower() for r in [*runs, run] if r]


def _cut(text: Column, pattern: Pattern) -> Column:
    """Texts between matches and matches in turn, by one pass; a match is followed by its groups."""
    groups = "".join(FIELD + (f"${g}" if g else "1") for g in pattern.groups)
    return F.split(F.regexp_replace(text, F.lit(pattern.regex), F.lit(f"{MARK}$0{groups}{MARK}")), MARK, -1)


def clean(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(FIELD)), F.translate(text, MARK + FIELD, "\ufffd\ufffd")).otherwise(text)


def _placed(cut: Column, make: Callable[[Column, Column], Column]) -> Column:
    """``make(start, fields)`` of each match of a text that was cut."""

    def every(at: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(cut) - 2, F.lit(2)), lambda i: let(F.split(F.get(cut, i), FIELD, -1), lambda fields: make(F.get(at, i), fields)))

    sizes = F.transform(cut, lambda x, i: F.length(F.when(i % 2 == 0, x).otherwise(F.substring_index(x, FIELD, 1))))
    only = let(F.split(F.get(cut, F.lit(1)), FIELD, -1), lambda fields: make(F.length(F.get(cut, F.lit(0))), fields))
    return F.when(F.size(cut) == 3, F.array(only)).otherwise(let(running(sizes), every))


def _hit(start: Column, fields: Column) -> list[Column]:
    match = F.get(fields, F.lit(0))
    return [start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match")]


def match_offsets(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match>> of all matches; 0-based, end exclusive. No empty matches."""
    found = lambda cut: F.when(F.size(cut) > 1, _placed(cut, lambda start, fields: F.struct(*_hit(start, fields)))).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))
    return let(_cut(clean(text), Pattern("", pattern)), found)


def all_hits(text: Column, patterns: list[Pattern], shift: Column | int = 0) -> Column:
    """array<struct<priority,name,start,end,match,groups>> of all matches, by pattern, then place (``shift`` is added).

    Each pattern reads the text once, and only a text that contains what it needs. One expression places the matches
    of every pattern, so its size does not grow with the bank.
    """

    def part(i: int, pattern: Pattern, body: Column, low: Column | None) -> Column:
        made = F.struct(F.lit(i).alias("priority"), F.lit(pattern.name).alias("name"), _cut(body, pattern).alias("cut"))
        if pattern.literal is not None:
            return F.when(F.contains(low, F.lit(pattern.literal)), made)
        return made if pattern.needs is None else F.when(body.rlike(pattern.needs) if pattern.needs.startswith("[") else F.contains(body, F.lit(pattern.needs)), made)

    def cuts(body: Column, low: Column | None = None) -> Column:
        return F.filter(F.array(*[part(i, p, body, low) for i, p in enumerate(patterns)]), lambda x: F.size(x["cut"]) > 1)

    def named(p: Column) -> Column:
        groups = lambda fields: F.slice(fields, 2, F.size(fields) - 1) if patterns[0].groups else F.array().cast("array<string>")
        make = lambda start, fields: F.struct(p["priority"].alias("priority"), p["name"].alias("name"), *_hit(start + shift, fields), groups(fields).alias("groups"))
        return _placed(p["cut"], make)

    lowered = any(p.literal is not None for p in patterns)
    return F.flatten(F.transform(let(text, lambda t: let(F.lower(t), lambda low: cuts(t, low)) if lowered else cuts(t)), named))


def zoned_hits(text: Column, zone: str, needs: str, patterns: list[Pattern]) -> Column:
    """As ``all_hits``, for patterns whose matches lie inside matches of ``zone`` that also match ``needs``.

    The text is read for zones, and the bank reads only those. Where two zones touch (the zone's
    repetition ended at its bound), the bank reads the whole text.
    """

    def inside(zones: Column) -> Column:
        touching = F.exists(F.transform(zones, lambda z, i: (i > 0) & (z["start"] == F.get(zones, i - 1)["end"])), lambda t: t)
        whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), clean(text).alias("match")))
        return F.when(touching, whole).otherwise(F.filter(zones, lambda z: z["match"].rlike(needs)))

    found = F.transform(let(match_offsets(text, zone), inside), lambda z: all_hits(z["match"], patterns, z["start"]))
    return let(found, lambda f: F.when(F.size(f) == 1, F.get(f, F.lit(0))).otherwise(F.sort_array(F.flatten(f))))


def first_of(hits: Column, field: str) -> Column:
    """Of the hits (structs that begin with their order) with equal ``field`` the first, in their order."""

    def fresh(rows: Column) -> Column:
        new = F.filter(rows, lambda r, i: (i == 0) | (F.get(rows, i - 1)["key"] != r["key"]))
        return F.sort_array(F.transform(new, lambda r: r["hit"]))

    keyed = lambda hs: F.sort_array(F.transform(hs, lambda h: F.struct(h[field].alias("key"), h.alias("hit"))))
    few = lambda hs: let(F.transform(hs, lambda h: h[field]), lambda ks: F.filter(hs, lambda h, i: F.array_position(ks, h[field]) == i + 1))
    return let(hits, lambda hs: F.when(F.size(hs) < 2, hs).when(F.size(hs) <= SHORT, few(hs)).otherwise(let(keyed(hs), fresh)))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def alternation(terms: list[str]) -> str:
    """Terms by their first letter, so that a place in a text is compared with few of them. Tells whether one occurs, not which comes first."""
    escaped = lambda t: re.sub(r"([.^$*+?{}\[\]\\|()/-])", r"\\\1", t)
    by: dict[str, list[str]] = {}
    for t in terms:
        by.setdefault(t[0], []).append(escaped(t[1:]))
    return f"(?=[{''.join(map(escaped, by))}])(?:" + "|".join(f"{escaped(k)}(?:{'|'.join(v)})" for k, v in by.items()) + ")"


def holds_any(lowered: Column, terms: list[str]) -> Column:
    """A lowered text contains one of the terms. Plain comparisons, as a regular expression tries every term at every place; a term that contains another one tells nothing more."""
    least = [t for t in dict.fromkeys(terms) if not any(o != t and o in t for o in terms)]
    return reduce(Column.__or__, [F.contains(lowered, F.lit(t)) for t in least])


def has_any(text: Column, terms: list[str]) -> Column:
    """Lowered text contains one of the terms."""
    return let(F.lower(text), lambda low: holds_any(low, terms))


def merge_windows(df: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Numbered islands of overlapping or touching windows per key (column ``island``)."""
    order = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")
