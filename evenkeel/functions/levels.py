"""Column functions: level keys, finite values, stabilising transforms, vectors, text codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "<missing>"


def level_key(c: Column) -> Column:
    """One spelling per condition level: null is ``<missing>``, text is trimmed, whole numbers lose their fraction."""
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    whole = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 9e15) & (F.floor(number) == number)
    return F.when(c.isNull(), F.lit(MISSING)).when(whole, number.cast("bigint").cast("string")).otherwise(text)


def strip_zero(c: Column) -> Column:
    """The figures' variant: only a trailing ``.0`` goes."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def finite(c: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def log_gain(c: Column, eps: float = 1e-12) -> Column:
    return F.log(F.greatest(c, F.lit(eps)))


def logit(c: Column, eps: float = 1e-6) -> Column:
    p = clip(c, eps, 1 - eps)
    return F.log(p / (1 - p))


def fisher_root(c: Column, eps: float = 1e-6) -> Column:
    return F.atanh(F.sqrt(clip(c, 0.0, 1 - eps)))


def trigger_code(c: Column) -> Column:
    """Number at the end of a trigger's text (``... S 10``); null for other events."""
    return F.regexp_extract(c, r"S\s*(\d+)\s*$", 1).try_cast("int")


def hex_mod(hex_text: Column, k: int) -> Column:
    """A hex string as a number, modulo ``k``, digit by digit."""
    digit = lambda d: F.conv(d, 16, 10).cast("int")
    return F.aggregate(F.split(hex_text, ""), F.lit(0), lambda a, d: F.when(d == "", a).otherwise((a * 16 + digit(d)) % k))


def redacted(c: Column) -> Column:
    """First 12 hex digits of the SHA-256 of an id."""
    return F.substring(F.sha2(c.cast("string"), 256), 1, 12)


def steady_mean(c: Column) -> Column:
    """Mean that no order of the rows changes: the sum is one of decimals with 18 places. Groups that these can't hold (NaN, 1e20 and more) get the plain mean."""
    d = c.cast("string").try_cast("decimal(38,18)")
    return F.coalesce(F.when(F.count(d) == F.count(c), F.try_sum(d).cast("double") / F.count(c)), F.avg(c))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
