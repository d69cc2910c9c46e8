"""Column functions: hosts, periods, rounding, codecs, geometry, physics and vectors. All stay in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Registries below which sites are named by three labels.
TWO_LABEL_SUFFIXES = ("co.uk", "co.id", "com.au", "go.id", "ac.id", "or.id")
EARTH_KM = 6371.0088


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "://([^/?#:]*)", 1))


def site_of(host: Column) -> Column:
    """The registrable domain of a host."""
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(F.size(labels) <= 2, host).when(last(2).isin(*TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))


def seconds_of(clock: Column) -> Column:
    """Seconds of HH:MM:SS, hours may pass 24."""
    part = lambda k: F.split_part(clock, F.lit(":"), F.lit(k)).cast("long")
    return part(1) * 3600 + part(2) * 60 + part(3)


def circular(a: Column, b: Column, period: int) -> Column:
    """a - b on a circle, from minus half a period on."""
    return F.pmod(a - b + period // 2, F.lit(period)) - period // 2


def significant(x: Column, digits: int) -> Column:
    """x to so many significant digits, half away from zero."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x * scale) / scale)


def ramp(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear through the knots, constant beyond them."""
    out = F.when(x <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return out.otherwise(F.lit(knots[-1][1]))


def to_code(power: Column) -> Column:
    """Hundredths of decibels as a short, -32768 where there is no power."""
    return F.when(power > 0, F.rint(F.greatest(F.lit(-32767.0), F.least(F.lit(32767.0), 1000 * F.log10(power))))).otherwise(-32768).cast("short")


def from_code(code: Column) -> Column:
    return F.when(code != -32768, code / 100)


def haversine(lat0: Column, lon0: Column, lat: Column, lon: Column) -> Column:
    """Great-circle kilometres."""
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), F.lit(2)) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon - lon0) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def bearing(lat0: Column, lon0: Column, lat: Column, lon: Column) -> Column:
    """Degrees from north, 0 to 360."""
    d = F.radians(lon - lon0)
    y = F.sin(d) * F.cos(F.radians(lat))
    x = F.cos(F.radians(lat0)) * F.sin(F.radians(lat)) - F.sin(F.radians(lat0)) * F.cos(F.radians(lat)) * F.cos(d)
    return (F.degrees(F.atan2(y, x)) + 360) % 360


def cell_key(lat: Column, lon: Column) -> Column:
    """One long for each cell of the rounded quarter-degree grid; neighbours differ by fixed steps."""
    return F.rint(lat * 4).cast("long") * 100000 + F.rint(lon * 4).cast("long") + 3600


def cell_place(cell: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a cell's middle."""
    return F.floor(cell / 100000) / 4, (F.pmod(cell, F.lit(100000)) - 3600) / 4


def sector(degrees: Column) -> Column:
    """Which of eight sectors around north a direction falls in."""
    return F.floor((degrees + 22.5) % 360 / 45).cast("int")


def pixel_hectares(lat: Column, degrees: float) -> Column:
    return (degrees * 111320) ** 2 * F.cos(F.radians(lat)) / 1e4


def relative_humidity(t: Column, dew: Column) -> Column:
    """Percent, by the Magnus form."""
    e = lambda x: F.exp(17.625 * x / (243.04 + x))
    return 100 * e(dew) / e(t)


def vapour_deficit(t: Column, dew: Column) -> Column:
    """kPa."""
    e = lambda x: F.exp(17.27 * x / (x + 237.3))
    return 0.6108 * (e(t) - e(dew))


def wind_from(u: Column, v: Column) -> Column:
    return (F.degrees(F.atan2(-u, -v)) + 360) % 360


def capital_recovery(i: Column, n: Column) -> Column:
    g = F.pow(1 + i, n)
    return i * g / (g - 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector at length one."""
    length = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x / length)


def edit1(a: Column, b: Column) -> Column:
    """One letter put in, left out or changed, or two neighbours exchanged, or equal."""
    first = F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda acc, k: F.when((acc == 0) & (F.substr(a, k, F.lit(1)) != F.substr(b, k, F.lit(1))), k).otherwise(acc))
    swapped = F.concat(F.left(a, first - 1), F.substr(a, first + 1, F.lit(1)), F.substr(a, first, F.lit(1)), F.substr(a, first + 2))
    return (F.levenshtein(a, b) <= 1) | (F.length(a) == F.length(b)) & (first > 0) & (swapped == b)
