"""Spans of a pattern's matches in a text, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"
#: Code points of context that a span carries on either side, and matches that are placed at once.
NEAR, CHUNK = 40, 256


def matches(text: Column, pattern: str, maybe: Column) -> Column:
    """The matches' strings. `maybe` is a cheap necessary condition; where it is false the pattern isn't tried."""
    return F.when(maybe, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def spans(text: Column, pattern: str, found: Column) -> Column:
    """Leftmost non-overlapping matches in code points, end exclusive, with up to NEAR code points of the text on
    either side, no further than the neighbouring matches.

    `found` are the matches' strings. The text's pieces between matches and the matches alternate, so running
    lengths give the places: within chunks of CHUNK matches first, then over the chunks, so that the work grows
    with the matches and not with their square.
    """
    pieces = F.split(text, pattern, -1)
    n = F.size(found)
    pairs = F.arrays_zip(found.alias("v"), F.slice(pieces, 1, n).alias("p"), F.slice(pieces, 2, n).alias("q"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(ONE).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.length(x["v"])
        one = F.struct(begin.cast("bigint").alias("start"), end.cast("bigint").alias("end"), x["v"].alias("value"), F.right(x["p"], F.lit(NEAR)).alias("before"), F.left(x["q"], F.lit(NEAR)).alias("after"))
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["out"], F.array(one)).cast(ONE).alias("out"))

    def chunk(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).cast(f"array<{ONE}>").alias("out"))

    chunks = F.transform(F.sequence(F.lit(1), n, F.lit(CHUNK)), lambda i: F.aggregate(F.slice(pairs, i, F.lit(CHUNK)), start, step))
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{ONE}>").alias("out"))
    return F.when(n > 0, F.flatten(F.aggregate(chunks, first, chunk, lambda acc: acc["out"]))).otherwise(F.array().cast(ONE))


def said(kind: str, found: Column) -> Column:
    """kind:start:end of each span."""
    return F.transform(found, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
