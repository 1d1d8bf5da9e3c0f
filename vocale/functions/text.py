"""Text clean-up columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.split() sees it, and the same set without the
# four separator controls for fields that are only trimmed.
SPACE = r"[\t-\r\x1c-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
TRIM_SPACE = r"[\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

# The characters of TRIM_SPACE, one by one.
TRIM_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# Fixed value: the cap on a normalised text, in code points.
MAX_TEXT_CHARS = 4000


def collapse_space(text: Column) -> Column:
    """NULL to '', every whitespace run to one blank, no blank at either end."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "))


def normalize_text(text: Column, max_chars: int | None = MAX_TEXT_CHARS) -> Column:
    """Collapse whitespace, then cap the length; ``max_chars=None`` keeps the whole text."""
    cleaned = collapse_space(text)
    return cleaned if max_chars is None else F.substring(cleaned, 1, max_chars)


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIM_CHARS))


def is_blank(text: Column) -> Column:
    """True for NULL and for text that is only whitespace."""
    return ~F.coalesce(text.rlike(f"[^{TRIM_SPACE[1:]}"), F.lit(False))


def is_empty_text(text: Column) -> Column:
    """True when nothing is left after normalising; stops at the first character that stays."""
    return ~F.coalesce(text.rlike(f"[^{SPACE[1:]}"), F.lit(False))


def blank_to_null(text: Column) -> Column:
    """Blank becomes NULL; anything else is kept as it is, outer blanks included."""
    return F.when(~is_blank(text), text)


def label_slug(text: Column, max_chars: int = 48) -> Column:
    """Readable bounded label: blanks to dashes, 'unknown' when empty."""
    trimmed = trim_space(F.coalesce(text, F.lit("")))
    slug = F.substring(F.replace(trimmed, F.lit(" "), F.lit("-")), 1, max_chars)
    return F.when(trimmed == "", F.lit("unknown")).otherwise(slug)


def source_name(source_id: Column) -> Column:
    return F.concat(F.lit("source-"), label_slug(source_id))
