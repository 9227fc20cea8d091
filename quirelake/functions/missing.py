"""Which values stand for nothing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Placeholders of the catalogue, in lower case and without blanks around.
PLACEHOLDERS = ("", "n/a", "na", "none", "null", "nan", "-", "--", "tbd", "unknown", "?")

# Characters trimmed as blanks: white space of Unicode and the invisible ones.
BLANKS = r"[\s\u0085\u00a0\u1680\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"


def bare(c: Column) -> Column:
    """The text without blanks around; null stays null."""
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")


def is_missing(c: Column) -> Column:
    """Null, blank or a placeholder."""
    return c.isNull() | F.lower(bare(c)).isin(*PLACEHOLDERS)


def present(c: Column) -> Column:
    """The text without blanks around, or null where it is missing."""
    return F.when(~is_missing(c), bare(c))


def doi_key(c: Column) -> Column:
    """A DOI without letter case, resolver or doi: prefix, trailing dots and blanks; null where missing."""
    low = F.lower(bare(c))
    cut = F.regexp_replace(low, r"^(?:https?://)?(?:www\.|dx\.)?doi\.[a-z]+/", "")
    cut = F.regexp_replace(cut, r"^doi\s*:\s*", "")
    cut = F.regexp_replace(cut, r"^(?:https?://)?(?:www\.|dx\.)?doi\.[a-z]+/", "")
    cut = F.regexp_replace(cut, r"[.\s]+$", "")
    return F.when(~is_missing(c) & ~cut.isin(*PLACEHOLDERS), cut)
