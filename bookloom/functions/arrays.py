"""Folds over long arrays, in chunks: a fold that appends copies what it has so far, so only a
chunk's worth is ever copied per element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def chunked(items: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body(chunk, place of its first element from zero) of each chunk; one empty chunk of none."""
    last = F.greatest(F.lit(0), F.ceil(F.size(items) / CHUNK).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda k: let(
        F.slice(items, k * CHUNK + 1, F.lit(CHUNK)), lambda c: body(c, k * CHUNK)))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]],
         kind: str) -> Column:
    """All that step(state, item) -> (state, array of outputs) puts out, from left to right."""
    def one(acc: Column, item: Column) -> Column:
        state, new = step(acc["state"], item)
        return F.struct(state.alias("state"),
                        F.concat(acc["out"], new).cast(f"array<{kind}>").alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        start = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return let(F.aggregate(part, start, one), lambda d: F.struct(
            d["state"].alias("state"),
            F.array_append(acc["out"], d["out"]).cast(f"array<array<{kind}>>").alias("out")))

    start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return let(items, lambda x: F.aggregate(chunked(x, lambda c, at: c), start, chunk,
                                            lambda acc: F.flatten(acc["out"])))
