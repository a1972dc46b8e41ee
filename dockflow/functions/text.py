"""Text clean-up columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(text: Column) -> Column:
    """Trimmed text; empty and all-space text becomes NULL."""
    return F.nullif(F.trim(text), F.lit(""))


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def safe_coordinate(text: Column, limit: float) -> Column:
    """Number within ±limit; anything else, NaN and infinities included, is NULL."""
    number = text.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) <= limit), number)


def decimal_like(text: Column) -> Column:
    """An identifier that looks like a decimal number and must not be read as one."""
    return text.rlike(r"^[+-]?\d+\.\d+$")


def one_line(text: Column) -> Column:
    """Tab, carriage return and newline become spaces, character by character."""
    return F.translate(text, "\t\r\n", "   ")


def clean_identifier(text: Column, limit=128) -> Column:
    """True for a non-empty identifier without white space and within the length limit."""
    return text.isNotNull() & ~text.rlike(r"\s") & F.length(text).between(1, limit)
