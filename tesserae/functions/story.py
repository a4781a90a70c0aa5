"""Parts of stories and claims as Column expressions: noise, money, signatures, representative texts, salience, labels, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.fixed import CURRENCIES, MAGNITUDES, NOISE, PERIPHERAL, PUBLIC_INTEREST


def is_noise(normalized: Column) -> Column:
    """Whether a normalised title and summary is gossip, petty crime or the like, and of no public interest."""
    return normalized.rlike(rf"\b({NOISE})\b") & ~normalized.rlike(rf"\b({PUBLIC_INTEREST})\b")


def approximate_usd(number: Column, text: Column, unit: Column) -> Column:
    """number, times the magnitude that text or unit names, in dollars of a fixed rate; null if neither names a currency."""
    blob = F.lower(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(unit, F.lit(""))))
    scale, rate = F.lit(1.0), F.lit(None).cast("double")
    for pattern, times in reversed(MAGNITUDES):
        scale = F.when(blob.rlike(pattern), times).otherwise(scale)
    for pattern, dollars in reversed(CURRENCIES):
        rate = F.when(blob.rlike(pattern), dollars).otherwise(rate)
    return number * scale * rate


def event_signature(topic: Column, normalized: Column, formula: list[str] | None = None, names: list[str] | None = None) -> Column:
    """topic | sorted words | sorted numbers of two or three digits | sorted pairs of neighbouring words, of a normalised title.

    Pairs of fewer than 7 characters, with a number, of two formula words, or that are a name alone, go.
    """
    words = F.filter(F.split(normalized, " "), lambda w: w != "")
    kept = F.array_sort(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\d+$")))
    numbers = F.array_sort(F.filter(words, lambda w: w.rlike(r"^\d{2,3}$")))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def tells(p: Column) -> Column:
        ok = (F.length(p["a"]) + F.length(p["b"]) >= 6) & ~p["a"].rlike(r"^\d+$") & ~p["b"].rlike(r"^\d+$")
        if formula:
            ok &= ~(p["a"].isin(*formula) & p["b"].isin(*formula))
        return ok & ~F.concat_ws("_", p["a"], p["b"]).isin(*names) if names else ok

    joined = F.array_sort(F.transform(F.filter(pairs, tells), lambda p: F.concat_ws("_", p["a"], p["b"])))
    return F.concat_ws("|", topic, F.array_join(kept, " "), F.array_join(numbers, " "), F.array_join(joined, " "))


def representative_text(title: Column, summary: Column, headlines: Column, entities: Column, labels: Column) -> Column:
    """One bounded text of a story, the same whatever the order of its parts: 240 characters of summary, 4 headlines, 12 entities and 6 labels at most, 700 characters in all."""
    some = lambda a, n: F.slice(F.array_sort(F.array_distinct(F.coalesce(a, F.array().cast("array<string>")))), 1, n)
    parts = [title, F.nullif(F.substring(summary, 1, 240), F.lit("")), *(F.nullif(F.array_join(some(a, n), sep), F.lit("")) for a, n, sep in ((headlines, 4, " | "), (entities, 12, " "), (labels, 6, " | ")))]
    return F.substring(F.concat_ws(" — ", *parts), 1, 700)


def salience(predicate: Column, label: Column, value_type: Column) -> Column:
    """core for numbers and ranges, else peripheral if predicate or label tells of ceremony."""
    return F.when(value_type.isin("number", "range"), "core").when(F.lower(F.concat_ws(" ", predicate, label)).rlike(PERIPHERAL), "peripheral").otherwise("core")


def canonical_value(c: Column) -> Column:
    """A text that is a number becomes that number's shortest form; others stay."""
    number = F.trim(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    as_double = F.trim(c).try_cast("double")
    whole = (as_double == F.floor(as_double)) & (F.abs(as_double) < 1e15)
    return F.when(number & whole, as_double.cast("bigint").cast("string")).when(number, as_double.cast("string")).otherwise(c)


def coverage_source(summary: Column) -> Column:
    """What follows the last colon; the whole if nothing does."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(summary, r":\s*([^:]+)$", 1)), F.lit("")), summary)


def without_label(summary: Column, label: Column) -> Column:
    return F.when(F.startswith(summary, F.concat(label, F.lit(":"))), F.trim(F.substr(summary, F.length(label) + 2))).otherwise(summary)


def slug(c: Column) -> Column:
    """Words of a normalised text with hyphens between."""
    return F.replace(c, F.lit(" "), F.lit("-"))


def time_id(at_ms: Column, key: Column) -> Column:
    """An id of version 7: 48 bits of milliseconds, then bits of the key's hash, so that a row has the same id whenever it is made."""
    h = F.md5(key.cast("string"))
    parts = [F.lower(F.lpad(F.hex(at_ms), 12, "0")), F.lit("7"), F.substring(h, 1, 3), F.lit("8"), F.substring(h, 4, 15)]
    t = F.concat(*parts)
    return F.concat_ws("-", F.substring(t, 1, 8), F.substring(t, 9, 4), F.substring(t, 13, 4), F.substring(t, 17, 4), F.substring(t, 21, 12))


def lcg_shuffled(items: Column, seed: Column) -> Column:
    """items in the order of a seeded shuffle from the last place down, each step of a 32-bit linear congruence choosing whom to swap with. Arrays should be short: one is copied a step."""
    start = F.when(F.pmod(seed, F.lit(1 << 32)) == 0, F.lit(1)).otherwise(F.pmod(seed, F.lit(1 << 32))).cast("long")

    def step(state: Column, at: Column) -> Column:
        s = F.pmod(state["s"] * 1664525 + 1013904223, F.lit(1 << 32))
        j = F.pmod(s, at).cast("int")
        a, last = state["a"], at.cast("int") - 1
        swapped = F.transform(a, lambda x, k: F.when(k == last, F.get(a, j)).when(k == j, F.get(a, last)).otherwise(x))
        return F.struct(swapped.alias("a"), s.alias("s"))

    places = F.when(F.size(items) > 1, F.reverse(F.sequence(F.lit(2).cast("long"), F.size(items).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(places, F.struct(items.alias("a"), start.alias("s")), step)["a"]
