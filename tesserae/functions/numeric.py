"""Exact decimals and score functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMAL = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$"


def decimal(c: Column, scale: int = 18) -> Column:
    """An exact decimal from a plain decimal string; null for exponents, words and what doesn't fit."""
    return F.when(F.trim(c).rlike(_DECIMAL), F.trim(c)).try_cast(f"decimal(38,{scale})")


def decimal_text(c: Column) -> Column:
    """The shortest form of a plain decimal string of any length: no plus, leading or trailing zeros, no minus zero; null if it is none."""
    t = F.trim(c)
    digits = F.regexp_replace(t, "^[+-]", "")
    whole = F.regexp_replace(F.substring_index(digits, ".", 1), "^0+", "")
    part = F.when(F.contains(digits, F.lit(".")), F.regexp_replace(F.substring_index(digits, ".", -1), "0+$", "")).otherwise("")
    body = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    return F.when(t.rlike(_DECIMAL), F.when(t.startswith("-") & (body != "0"), F.concat(F.lit("-"), body)).otherwise(body))


def shifted(c: Column, places: int) -> Column:
    """c times 10 ** places, exactly; c of scale 8 or less."""
    narrow = c.cast("decimal(28,8)")
    return (narrow * F.lit(10**places).cast("decimal(10,0)") if places >= 0 else narrow / F.lit(10**-places).cast("decimal(10,0)")).cast("decimal(38,18)")


def is_bigint(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^-?[0-9]+$") & c.try_cast("bigint").isNotNull(), F.lit(False))


def simple_return(before: Column, now: Column) -> Column:
    return F.when(before > 0, now / before - 1)


def log_return(before: Column, now: Column) -> Column:
    return F.when((before > 0) & (now > 0), F.ln(now / before))


def freshness(age_hours: Column, half_life: float = 36) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_hours, F.lit(0)) / half_life)


def coverage(n: Column) -> Column:
    return F.least(F.lit(1.0), F.log10(n + 1) / F.log10(F.lit(40.0)))


def radar_score(magnitude: Column, abnormality: Column, evidence: Column, fresh: Column, relevance: Column) -> Column:
    """0 to 100 with one decimal."""
    return F.round(1000 * (magnitude * 0.28 + abnormality * 0.2 + evidence * 0.18 + fresh * 0.14 + relevance * 0.2)) / 10


def cosine(a: Column, b: Column) -> Column:
    """0 if the lengths differ or a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
