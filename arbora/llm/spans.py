"""Spans of regular expressions over whole texts, in built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, op: Callable[[Column, Column], Column]) -> Column:
    """All prefixes of an array under an associative op, by doubling: n log n steps, where appending to an array would take n * n."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(items), F.lit(1)))).cast("int"))

    def double(acc: Column, k: Column) -> Column:
        step = F.pow(F.lit(2.0), k).cast("int")
        return F.transform(acc, lambda x, i: F.when(i >= step, op(F.get(acc, i - step), x)).otherwise(x))

    return F.aggregate(rounds, items, double)


def spans(text: Column, found: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of found = matches(text, pattern): code points, end exclusive; empty if found is.

    The text between matches comes from a split by the same pattern, which is made only where there are matches.
    """
    none = F.expr("CAST(array() AS array<struct<start:long,end:long,match:string>>)")
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda s: F.char_length(s).cast("long"))

    def ends(pairs: Column) -> Column:
        walked = scan(F.transform(pairs, lambda z: z["gap"] + F.char_length(z["match"])), lambda a, b: a + b)
        return F.transform(F.arrays_zip(walked.alias("end"), pairs.alias("pair")), lambda z: F.struct((z["end"] - F.char_length(z["pair"]["match"])).alias("start"), z["end"].alias("end"), z["pair"]["match"].alias("match")))

    both = F.transform(F.arrays_zip(found.alias("m"), gaps.alias("g")), lambda z: F.struct(z["m"].alias("match"), z["g"].alias("gap")))
    return F.when(F.size(found) > 0, bound(both, ends)).otherwise(none)


#: Code points of a text's pieces.
PIECE = 256


def pieces(text: Column) -> Column:
    """A text cut into pieces of PIECE code points, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(cut: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive) of the text that cut = pieces(text) holds, without a walk from the text's start."""
    first = F.floor(start / PIECE).cast("int")
    held = F.array_join(F.slice(cut, first + 1, F.greatest(F.floor((end - 1) / PIECE).cast("int") - first + 1, F.lit(0))), "")
    return F.substr(held, (start % PIECE + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def joined(items: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def counted(items: Column, kind: str) -> Column:
    """The number of spans of a kind."""
    return F.size(F.filter(items, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, found: Column, mask: str) -> Column:
    """text with every span of found (structs with start and end, by start; at least one) replaced by mask; spans that overlap are replaced once."""

    def cut(held: Column) -> Column:
        reached = lambda s: scan(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        before = lambda ends: F.transform(ends, lambda e, i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0).cast("long")))

        def join(ends: Column) -> Column:
            gaps = F.filter(F.arrays_zip(before(ends).alias("a"), F.transform(found, lambda x: x["start"]).alias("b")), lambda z: z["b"] >= z["a"])
            kept = F.transform(gaps, lambda z: part(held, z["a"], z["b"]))
            last = part(held, F.element_at(ends, -1), F.char_length(text).cast("long"))
            return F.concat(F.array_join(F.transform(kept, lambda k: F.concat(k, F.lit(mask))), ""), last)

        return bound(reached(found), join)

    return bound(pieces(text), cut)
