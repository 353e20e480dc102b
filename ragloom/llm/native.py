"""Column helpers of the operators that run on DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,text:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty_spans() -> Column:
    return F.from_json(F.lit("[]"), f"array<{SPAN}>")


def find_spans(text: Column, kind: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern, with code point offsets, end exclusive.

    The text between matches and the matches are measured in turn, so an offset costs no search.
    """

    def place(found: Column) -> Column:
        def walk(gaps: Column) -> Column:
            begin = F.struct(F.lit(0).alias("at"), empty_spans().alias("out"))

            def step(a: Column, i: Column) -> Column:
                start, m = a["at"] + F.length(F.get(gaps, i)), F.get(found, i)
                end = start + F.length(m)
                span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), m.alias("text"))
                return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), begin, step, lambda a: a["out"])

        return F.when(F.size(found) == 0, empty_spans()).otherwise(let(F.split(text, pattern, -1), walk))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def code(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], span["start"], span["end"])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, code), ",")


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def one(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), one), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(False)


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
