"""Column helpers that keep array and text work inside one expression, on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` names it in lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Of each match: code point offsets (end exclusive), the text, and up to CONTEXT characters on either side.
MATCH = "struct<start:bigint,end:bigint,text:string,before:string,after:string>"
CONTEXT = 24


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """array<MATCH> of the leftmost non-overlapping matches of a pattern without capturing groups."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def offsets(x: Column) -> Column:
        each = F.transform(x["m"], lambda m, i: F.struct(m.alias("m"), F.get(x["p"], i).alias("b"), F.get(x["p"], i + 1).alias("a")))

        def step(acc: Column, e: Column) -> Column:
            start = acc["pos"] + F.length(e["b"])
            end = start + F.length(e["m"])
            match = F.struct(
                start.cast("long").alias("start"), end.cast("long").alias("end"), e["m"].alias("text"),
                F.right(e["b"], F.lit(CONTEXT)).alias("before"), F.left(e["a"], F.lit(CONTEXT)).alias("after"),
            )
            return F.struct(end.cast("long").alias("pos"), F.concat(acc["out"], F.array(match)).alias("out"))

        zero = F.struct(F.lit(0).cast("long").alias("pos"), F.expr(f"cast(array() as array<{MATCH}>)").alias("out"))
        return F.aggregate(each, zero, step, lambda acc: acc["out"])

    return let(found, offsets)


def none_found() -> Column:
    return F.expr(f"cast(array() as array<{MATCH}>)")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(d: Column) -> Column:
        def value(i: Column) -> Column:
            v = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, v).otherwise(2 * v - F.when(v >= 5, 9).otherwise(0))

        return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), value), F.lit(0), lambda a, b: a + b) % 10 == 0

    return let(number, total)
