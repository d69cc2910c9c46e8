"""Lines as short texts: each corner's step from the last in whole units, five bits a character, as map libraries in browsers read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the format: bits of a character, its bit for "more follows", and what is added to make it printable.
BITS, MORE, PRINTABLE = 5, 32, 63


def number(n: Column) -> Column:
    """A whole number: its sign in the lowest bit, then groups of five bits, the lowest first."""
    z = F.when(n < 0, -2 * n - 1).otherwise(2 * n)
    # as many groups as needed for 64 bits; those after the last that is not zero are left out
    groups = F.greatest(F.lit(1), F.ceil(F.length(F.bin(z)) / BITS)).cast("int")
    group = lambda k: F.shiftrightunsigned(z, k * BITS).bitwiseAND(31)
    return F.concat(*(F.when(groups > k, F.char(group(k) + F.when(groups > k + 1, MORE).otherwise(0) + PRINTABLE)).otherwise("") for k in range(12)))


def encoded(line: str, digits: int = 5) -> Column:
    """A line, an array of corners {x, y}, as text: y before x, in units of the last of the digits; null for null."""
    unit = 10**digits
    whole = F.transform(line, lambda c: F.struct(F.round(c["x"] * unit).cast("long").alias("x"), F.round(c["y"] * unit).cast("long").alias("y")))
    zero = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    before = F.concat(F.array(zero), F.slice(whole, 1, F.greatest(F.size(whole) - 1, F.lit(0))))
    return F.array_join(F.zip_with(whole, before, lambda a, b: F.concat(number(a["y"] - b["y"]), number(a["x"] - b["x"]))), "")


def decoded(text: str, digits: int = 5) -> Column:
    """The corners of such a text."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - PRINTABLE)
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("shift"), F.array().cast("array<bigint>").alias("all"))

    def step(s, c):
        n = s["n"] + F.call_function("shiftleft", c.bitwiseAND(31).cast("long"), s["shift"])
        last = c < MORE
        value = F.when(n % 2 == 1, -((n + 1) / 2).cast("long")).otherwise((n / 2).cast("long"))
        return F.struct(F.when(last, 0).otherwise(n).cast("long").alias("n"), F.when(last, 0).otherwise(s["shift"] + BITS).alias("shift"), F.when(last, F.concat(s["all"], F.array(value))).otherwise(s["all"]).alias("all"))

    steps = F.aggregate(codes, empty, step)["all"]
    sums = lambda k, odd: F.aggregate(F.filter(F.slice(steps, 1, k * 2), lambda _, i: i % 2 == odd), F.lit(0).cast("long"), lambda a, v: a + v)
    unit = float(10**digits)
    places = F.when(F.size(steps) > 1, F.sequence(F.lit(1), (F.size(steps) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(F.col(text).isNotNull(), F.transform(places, lambda k: F.struct((sums(k, 1) / unit).alias("x"), (sums(k, 0) / unit).alias("y"))))
