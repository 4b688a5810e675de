"""Text expressions with Unicode-aware character classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as sensitive text, tested in this order.
SENSITIVE_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"\+?[\d\s\-\(\)]{10,15}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "credit_card": r"\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}",
}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def found_in(c: Column, pattern: str) -> Column:
    """True where the pattern occurs anywhere in the text; false for null."""
    return F.coalesce(c.cast("string").rlike("(?U)" + pattern), F.lit(False))


def starts_with_match(c: Column, pattern: str) -> Column:
    """True where the pattern matches from the first character on; null stays null."""
    return c.cast("string").rlike(f"(?U)^(?:{pattern})")
