"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# every Unicode white-space character, and the four ASCII separators
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def squeeze(text: Column) -> Column:
    """Collapse every run of white space to one blank and trim the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends, keep it inside."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def ellipsize(text: Column, limit: int = 280) -> Column:
    """Texts longer than ``limit`` characters end in three dots, ``limit`` long in all."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def split_list(text: Column) -> Column:
    """Comma list to an array of trimmed, non-blank items; NULL becomes an empty array."""
    items = F.filter(F.transform(F.split(text, ","), strip), lambda item: item != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def first_filled(*candidates: Column) -> Column:
    """The first candidate that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def is_blank(text: Column) -> Column:
    """True for NULL and for strings of blanks only."""
    return text.isNull() | (F.trim(text) == "")


def hex_id(uuid_text: Column) -> Column:
    """UUID text to its canonical form of 32 lower-case hex digits; other text gives NULL."""
    bare = F.when(uuid_text.startswith("urn:uuid:"), F.substr(uuid_text, F.lit(10))).otherwise(uuid_text)
    digits = F.replace(F.btrim(bare, F.lit("{}")), F.lit("-"), F.lit(""))
    # text with other characters than hex digits has no bytes
    return F.when((F.octet_length(digits) == 32) & F.unhex(digits).isNotNull(), F.lower(digits))


def hex_bytes(raw: Column) -> Column:
    """A 16-byte binary id in the same canonical form."""
    return F.lower(F.hex(raw))
