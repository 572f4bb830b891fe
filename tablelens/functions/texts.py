"""Line handling shared by the text operators. CRLF, CR and LF each end a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK_LINE = "\r\n\r\n|\r\r|\n\n"


def with_plain_breaks(text: Column) -> Column:
    """The text with every line break as LF. Most texts have no other break, and
    one search for CR leaves those as they are."""
    lf = F.lit("\n")
    plain = F.replace(F.replace(text, F.lit("\r\n"), lf), F.lit("\r"), lf)
    return F.when(F.contains(text, F.lit("\r")), plain).otherwise(text)


def line_breaks(text: Column) -> Column:
    plain = with_plain_breaks(text)
    without = F.replace(plain, F.lit("\n"), F.lit(""))
    return (F.octet_length(plain) - F.octet_length(without)).cast("long")


def lines(text: Column, limit: int = -1) -> Column:
    """The lines as an array; with a limit the last element keeps the rest unsplit.

    Splitting at one plain character needs no regular expression.
    """
    return F.split(with_plain_breaks(text), "\n", limit)


def grouped_digits(number: Column) -> Column:
    return F.format_number(number, 0)


def as_list(names: str | list[str] | tuple[str, ...]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)
