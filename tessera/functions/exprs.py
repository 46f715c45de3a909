"""Column expressions of the measurement domain. Everything here is a built-in expression: nothing leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.special import normal_quantile

#: fixed values: device range and weights of the picture standards
UNITS = 1023
BT601 = (0.299, 0.587, 0.114)
REC709 = (0.2126, 0.7152, 0.0722)


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp, with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def weighted(r: Column, g: Column, b: Column, weights: tuple[float, float, float]) -> Column:
    return r * F.lit(weights[0]) + g * F.lit(weights[1]) + b * F.lit(weights[2])


def luma(r: Column, g: Column, b: Column) -> Column:
    """BT.601 luma."""
    return weighted(r, g, b, BT601)


def luma_709(r: Column, g: Column, b: Column) -> Column:
    """Rec.709 luma."""
    return weighted(r, g, b, REC709)


def chroma(r: Column, g: Column, b: Column) -> Column:
    """Magnitude of the BT.601 U and V differences."""
    y = luma(r, g, b)
    u, v = (b - y) * F.lit(0.492), (r - y) * F.lit(0.877)
    return F.sqrt(u * u + v * v)


def linear_rgb(c: Column) -> Column:
    """Linear light of an sRGB value in [0, 1]."""
    return F.when(c <= 0.04045, c / F.lit(12.92)).otherwise(F.pow((c + F.lit(0.055)) / F.lit(1.055), F.lit(2.4)))


def relative_luminance(r: Column, g: Column, b: Column) -> Column:
    return weighted(linear_rgb(r), linear_rgb(g), linear_rgb(b), REC709)


def saturated_red(r: Column, g: Column, b: Column) -> Column:
    """Is red at least 0.8 of a positive linear total?"""
    lr, lg, lb = linear_rgb(r), linear_rgb(g), linear_rgb(b)
    total = lr + lg + lb
    return (total > 0) & (lr >= F.lit(0.8) * total)


def red_quantity(r: Column, g: Column, b: Column) -> Column:
    """320 * max(0, R - G - B) in linear light where red is saturated, else 0."""
    lr, lg, lb = linear_rgb(r), linear_rgb(g), linear_rgb(b)
    return F.when(saturated_red(r, g, b), F.lit(320.0) * F.greatest(F.lit(0.0), lr - lg - lb)).otherwise(F.lit(0.0))


def saturate(x: Column) -> Column:
    """Positive values drawn into [0, 1), one half at 1; 0 for others and for nulls."""
    return 1 - 1 / (1 + F.greatest(x, F.lit(0.0)))


def band_distance(x: Column, low: float, high: float) -> Column:
    """How far x lies from the nearest value in [low, high]."""
    return F.abs(x - F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def live_floor(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(a, F.lit(0.0)) * F.greatest(b, F.lit(0.0)))


def follow_z(r: Column, n: Column) -> Column:
    """Fisher z of a correlation over n points; 0 where n <= 3 or r is not finite or +-1."""
    ok = (n > 3) & r.isNotNull() & ~F.isnan(r) & (F.abs(r) < 1)
    return F.when(ok, F.atanh(r) * F.sqrt((n - 3).cast("double"))).otherwise(F.lit(0.0))


def critical_z(alpha: float, tests: int) -> float:
    """Two-sided normal quantile at level alpha shared by a number of tests."""
    return normal_quantile(1 - alpha / (2 * max(tests, 1)))


def to_device(x: Column) -> Column:
    """Unit value to device units, clipped, half to even."""
    return F.rint(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * UNITS).cast("int")


def snap_toggle(value: Column) -> Column:
    return F.when(value >= (UNITS + 1) // 2, UNITS).otherwise(0)


def snap_levels(x: Column, levels: int) -> Column:
    """Nearest of evenly spread levels in [0, 1]."""
    return F.rint(x * (levels - 1)) / F.lit(float(levels - 1)) if levels > 1 else F.lit(0.0)


def gray_encode(i: Column) -> Column:
    return i.bitwiseXOR(F.shiftright(i, 1))


def gray_decode(g: Column, bits: int = 16) -> Column:
    """Inverse of gray_encode for codes of up to `bits` bits."""
    shift = 1
    while shift < bits:
        g = g.bitwiseXOR(F.shiftright(g, shift))
        shift *= 2
    return g


def signed(code: Column, bits: int) -> Column:
    """Codes of half the range or more wrap to negative."""
    return F.when(code >= 1 << (bits - 1), code - (1 << bits)).otherwise(code)


def flat_bit(register: Column, bit: Column, width: int = 16) -> Column:
    return register * width + bit


def usable_rate(share: Column, limit: float, slow: float, fast: float) -> Column:
    """`slow` below the limit, then linear to `fast` at share 1."""
    return F.when(share < limit, F.lit(slow)).otherwise(F.lit(slow) + (share - F.lit(limit)) / F.lit(1 - limit) * F.lit(fast - slow))


def three_way(x: Column, low: float, high: float, names: tuple[str, str, str]) -> Column:
    return F.when(x <= low, names[0]).when(x >= high, names[2]).otherwise(names[1])


def response_curve(x: Column, mode: str) -> Column:
    """Eased response of a unit value, by control mode."""
    if mode == "linear":
        return x
    if mode == "quad_in":
        return x * x
    if mode == "quad_out":
        return F.lit(1.0) - (1 - x) * (1 - x)
    if mode == "circ_in":
        return F.lit(1.0) - F.sqrt(F.greatest(F.lit(0.0), 1 - x * x))
    if mode == "quint_in":
        return F.pow(x, F.lit(5.0))
    if mode == "expo_in":
        return F.when(x <= 0, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), (x - 1) * 10))
    if mode == "steps4":
        return F.floor(F.least(x, F.lit(1 - 1e-12)) * 4) / F.lit(3.0)
    raise ValueError(f"no such control mode: {mode}")


def style_label(text: Column, first: str, second: str, names: tuple[str, str]) -> Column:
    """The name whose pattern matches more often; MIXED on a tie with matches, UNKNOWN without."""
    a, b = (F.coalesce(F.regexp_count(F.lower(text), F.lit(p)), F.lit(0)) for p in (first, second))
    return F.when((a == 0) & (b == 0), "UNKNOWN").when(a > b, names[0]).when(b > a, names[1]).otherwise("MIXED")


def content_key(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16)


def quantisation_si(step: float) -> float:
    return step * math.sqrt((4 - math.pi) / 2)


def quantisation_ti(step: float) -> float:
    return step / math.sqrt(6)
