"""Text functions as Column expressions: folding, tokens, shingles, keys, cleaning, cascades of patterns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.fixed import STOP_WORDS, VIETNAMESE_LETTERS


def _folds() -> tuple[str, str]:
    """Precomposed Latin letters with marks and the letters left when the marks go (canonical decomposition), from the Unicode tables."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(cp):
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


_FROM, _TO = _folds()


def strip_marks(c: Column) -> Column:
    """Without diacritics: combining marks go, precomposed letters become their base letter; d with stroke is no mark and stays."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{M}+", "")


def normalize_text(c: Column) -> Column:
    """Lower case, no marks, d for the stroked d, one space for each run of other characters than letters a-z and digits."""
    plain = F.lower(F.translate(strip_marks(c), "đĐ", "dD"))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def fold_search(c: Column) -> Column:
    """Lower case without marks; the stroked d and punctuation stay."""
    return strip_marks(F.lower(c))


def tokens(c: Column, least: int = 2) -> Column:
    """Distinct words of a-z, 0-9 and % of a folded text, of least characters or more, without stop words."""
    words = F.split(F.trim(F.regexp_replace(strip_marks(F.lower(c)), "[^a-z0-9%]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS)))


def keywords(c: Column) -> Column:
    """Distinct words of three or more characters that are neither stop words nor digits alone."""
    words = F.split(normalize_text(c), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS) & ~w.rlike("^[0-9]+$")))


def shingles(words: Column, n: int) -> Column:
    """Distinct runs of n words; the whole for fewer words; none for none.

    words should be a column of its own: an expression would be evaluated again for each run.
    """
    size = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, n)))
    return F.when((size == 0) | (F.concat_ws(" ", words) == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def title_shingles(words: Column) -> Column:
    """Runs of three words of a normalised title, of two below six words."""
    return F.when(F.size(words) < 6, shingles(words, 2)).otherwise(shingles(words, 3))


def bigrams(words: Column) -> Column:
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(shingles(words, 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct-valued arrays; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 0.0).otherwise(both / union)


def number_tokens(c: Column) -> Column:
    """Distinct numbers with separators taken out, of two digits or more, without bare years 1900-2099."""
    raw = F.regexp_extract_all(c, F.lit(r"([0-9][0-9.,]*)"), 1)
    plain = F.transform(raw, lambda x: F.regexp_replace(x, "[.,]", ""))
    return F.array_distinct(F.filter(plain, lambda x: (F.length(x) >= 2) & ~x.rlike("^(19|20)[0-9][0-9]$")))


def locale_number(raw: Column, lang: Column) -> Column:
    """A double from digits grouped by dots (vi: comma decimals) or commas (others: dot decimals); null if it is none."""
    vi = F.regexp_replace(F.regexp_replace(raw, r"\.", ""), ",", ".")
    en = F.regexp_replace(raw, ",", "")
    return F.when(lang == "vi", vi).otherwise(en).try_cast("double")


def outlet_suffix_stripped(title: Column) -> Column:
    """Without ' - Outlet' or ' | Outlet' at the end."""
    return F.regexp_replace(title, r"\s+[-|–]\s+[^-|–]{2,40}$", "")


def title_key(title: Column) -> Column:
    return normalize_text(outlet_suffix_stripped(title))


def is_vietnamese(c: Column) -> Column:
    """Whether the text has a letter of Vietnamese that English lacks."""
    return F.lower(c).rlike(f"[{VIETNAMESE_LETTERS}]")


def clean_html(c: Column) -> Column:
    """Without scripts, styles and tags, common references decoded, white space as one space."""
    s = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    s = F.regexp_replace(s, "<[^>]*>", " ")
    for ref, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(ref), F.lit(to))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def safe_url(c: Column) -> Column:
    """http(s) URLs, else null."""
    return F.when(c.rlike(r"^https?://[^\s/]+"), c)


def canonical_url(c: Column) -> Column:
    """Without fragment and tracking parameters (utm_*, fbclid, gclid, ref_*, mc_*), and without a final slash."""
    s = F.regexp_replace(c, "#.*$", "")
    s = F.regexp_replace(s, r"([?&])((utm_|ref_|mc_)[^=&]*|fbclid|gclid)=[^&]*", "$1")
    s = F.regexp_replace(F.regexp_replace(s, "[?]&+", "?"), "&&+", "&")
    return F.regexp_replace(F.regexp_replace(s, "[?&]+$", ""), "/$", "")


def has_word(text: Column, word: str) -> Column:
    """Whether the whole word stands in the text, whatever its case; the word is no pattern."""
    quoted = "".join("\\" + ch if not ch.isalnum() else ch for ch in word.lower())
    return F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}]){quoted}(?![\p{{L}}\p{{N}}])")


def cascade(text: Column, rules: list[tuple[str, str]], other: str | None = None) -> Column:
    """The name of the first pattern that the text matches."""
    out = None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(F.lit(other))


def grounded(numbers: Column, allowed: Column) -> Column:
    """Whether every number is allowed."""
    return F.forall(numbers, lambda n: F.array_contains(allowed, n))


def content_hash(title: Column, body: Column) -> Column:
    """32 hexadecimal digits of the SHA-256 of both, normalised."""
    return F.substring(F.sha2(F.concat_ws("\n", normalize_text(title), normalize_text(body)), 256), 1, 32)


def canonical_json_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON in the order of their names; a null field is left out as 'not asserted'."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)


def fnv1a_32(data: bytes) -> int:
    """The 32-bit FNV-1a hash, for single keys on the driver."""
    h = 0x811C9DC5
    for b in data:
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h
