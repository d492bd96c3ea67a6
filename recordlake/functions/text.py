"""UTF-8 text of opaque payloads and the predicates on it.

Case folding is ``lower`` on both sides; order is the order of UTF-8 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("contains", "equals", "less", "greater")


def text_lenient(data: Column) -> Column:
    """The payload as text, invalid bytes replaced by U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def text_strict(data: Column) -> Column:
    """The payload as text; null where it is not valid UTF-8."""
    return F.try_validate_utf8(data.cast("string"))


def try_text(data: Column) -> Column:
    """A struct ``(ok, value)``; the value is empty where the payload is not valid UTF-8."""
    found = text_strict(data)
    return F.struct(found.isNotNull().alias("ok"), F.coalesce(found, F.lit("")).alias("value"))


def content_match(data: Column, operator: str, value: str, ignore_case: bool = True) -> Column:
    """Whether the payload is valid UTF-8 and its text meets the predicate; false, never null, otherwise."""
    if operator not in OPERATORS:
        raise ValueError(f"unknown content operator {operator!r}; one of {OPERATORS}")
    raw = data.cast("string")
    fold = F.lower if ignore_case else (lambda c: c)
    text, probe = fold(raw), fold(F.lit(value))
    test = {"contains": lambda: F.contains(text, probe), "equals": lambda: text == probe, "less": lambda: text < probe, "greater": lambda: text > probe}[operator]()
    return F.coalesce(F.when(F.is_valid_utf8(raw), test), F.lit(False))


def crc(data: Column) -> Column:
    """CRC-32 (IEEE) of a payload."""
    return F.crc32(data.cast("binary"))
