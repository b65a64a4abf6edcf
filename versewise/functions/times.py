"""Time and rational arithmetic (H1-H8, H11) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ttml_time(text: Column) -> Column:
    """Clock ``hh:mm:ss(.f)`` or offset ``n(h|m|s|ms)`` with up to six decimals -> microseconds, or null (H1)."""
    part = lambda i: F.regexp_extract(text, r"^(\d+):(\d{2}):(\d{2}(?:\.\d{1,6})?)$", i)
    clock = (part(1).cast("bigint") * 3600 + part(2).cast("bigint") * 60) * 1000000 + (part(3).cast("decimal(18,6)") * 1000000).cast("bigint")
    number = F.regexp_extract(text, r"^(\d+(?:\.\d{1,6})?)(h|ms|m|s)$", 1).cast("decimal(24,6)")
    unit = F.regexp_extract(text, r"^(\d+(?:\.\d{1,6})?)(h|ms|m|s)$", 2)
    scale = F.when(unit == "h", 3600000000).when(unit == "m", 60000000).when(unit == "s", 1000000).otherwise(1000)
    good = text.rlike(r"^\d+:[0-5]\d:[0-5]\d(?:\.\d{1,6})?$")
    return F.when(good, clock).when(unit != "", F.round(number * scale).cast("bigint"))


def lrc_time(tag: Column) -> Column:
    """``mm:ss(.f)`` with one to three decimals, padded on the right -> milliseconds, or null (H2)."""
    pattern = r"^(\d+):([0-5]\d)(?:[.:](\d{1,3}))?$"
    part = lambda i: F.regexp_extract(tag, pattern, i)
    return F.when(tag.rlike(pattern), part(1).cast("bigint") * 60000 + part(2).cast("bigint") * 1000 + F.rpad(part(3), 3, "0").cast("bigint"))


def seconds_to_us(seconds: Column) -> Column:
    """Decimal seconds -> microseconds, ties to even (H3)."""
    return F.bround(seconds.cast("decimal(20,9)") * 1000000, 0).cast("bigint")


def ticks_to_us(ticks: Column, rate: Column) -> Column:
    """Ticks of a rate that divides a million -> microseconds; null otherwise (H4)."""
    return F.when(F.lit(1000000) % rate == 0, ticks * (F.lit(1000000) / rate).cast("bigint"))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by a bounded fold of Euclid's step (H6)."""
    start = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def rational(num: Column, den: Column) -> Column:
    """A normalised fraction with a positive denominator (H6)."""
    g = gcd(num, den) * F.signum(den).cast("bigint")
    return F.struct((num / g).cast("bigint").alias("num"), (den / g).cast("bigint").alias("den"))


def rational_less(a: Column, b: Column) -> Column:
    """a < b by exact cross-multiplication (H6)."""
    wide = "decimal(38,0)"
    return a["num"].cast(wide) * b["den"].cast(wide) < b["num"].cast(wide) * a["den"].cast(wide)


def output_frames(samples: Column, per_frame: int = 800) -> Column:
    """Frames that cover the samples (H7)."""
    return F.floor((samples + per_frame - 1) / per_frame).cast("bigint")


def frame_start_us(frame: Column, per_second: int = 60) -> Column:
    """Start of a frame, rounded down to a microsecond (H8)."""
    return F.floor(frame * 1000000 / per_second).cast("bigint")


def smoothstep(x: Column) -> Column:
    """Cubic ease on [0, 1]."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return F.when(x.isNotNull(), t * t * (3 - 2 * t))


def critical(x: Column) -> Column:
    """Critically damped step response, 0 before the onset."""
    t = F.greatest(F.lit(0.0), x)
    return F.when(x.isNotNull(), 1 - (1 + t) * F.exp(-t))


def quintic(x: Column) -> Column:
    """Fifth-order ease on [0, 1]."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return F.when(x.isNotNull(), t * t * t * (t * (t * 6 - 15) + 10))
