"""Typed conversion of text cells: value, or NULL with a reason."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from gridloom.functions.text import is_blank, strip

# The five column types, by the name used in messages, with Spark's type.
COLUMN_TYPES = {
    "Text": "string",
    "Integer": "bigint",
    "Decimal": "double",
    "Date": "timestamp",
    "Boolean": "boolean",
}

# Words read as a boolean besides true and false.
TRUE_WORDS = ("1", "tak", "Tak", "TAK")
FALSE_WORDS = ("0", "nie", "Nie", "NIE")

# The largest magnitude that a 96-bit decimal holds.
DECIMAL_LIMIT = 7.9228162514264338e28

# Tried in order after ISO 8601. Dates are read by this list, not by the machine's culture.
DATE_FORMATS = (
    "d.M.yyyy",
    "d.M.yyyy H:mm",
    "d.M.yyyy H:mm:ss",
    "d-M-yyyy",
    "d/M/yyyy",
    "yyyy/M/d",
    "yyyy.MM.dd",
)

_ISO_START = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}.*)?$"
# A comma without a point is the decimal mark, and spaces group thousands; otherwise commas group
# thousands. The sign may stand on either side.
_GROUP_SPACES = " \u00a0\u202f"
_COMMON_NUMBER = r"^[+-]?[0-9]{1,28}(?:[.,][0-9]+)?$"
_NUMBER = rf"^[+-]?(?:[0-9{_GROUP_SPACES}]*,[0-9]*|[0-9,]*\.[0-9]*|[0-9]+) *[+-]?$"


def convert(
    value: Column, column_type: str, date_formats: Sequence[str] = DATE_FORMATS, trimmed: bool = False
) -> Column:
    """The typed value; NULL when the cell is blank or does not convert."""
    if column_type == "Text":
        return value
    text = value if trimmed else strip(value)
    if column_type == "Integer":
        return text.try_cast("bigint")
    if column_type == "Decimal":
        return _decimal(text)
    if column_type == "Boolean":
        word = F.lower(text)
        return F.when(value.isin(*TRUE_WORDS) | (word == "true"), True).when(
            value.isin(*FALSE_WORDS) | (word == "false"), False
        )
    if column_type == "Date":
        iso = F.when(text.rlike(_ISO_START), text.try_cast("timestamp"))
        return F.coalesce(iso, *[_by_format(text, fmt) for fmt in date_formats])
    raise ValueError(f"Unknown column type '{column_type}'.")


# How many digits the letters of a date format stand for; other letters are tried without a look first.
_DIGITS = {"d": "{1,2}", "M": "{1,2}", "H": "{1,2}", "yyyy": "{4,}", "MM": "{2}", "dd": "{2}", "HH": "{2}", "mm": "{2}", "ss": "{2}"}


def _by_format(text: Column, fmt: str) -> Column:
    """A date in one format. A pattern turns cells of other shapes away before they are parsed."""
    parsed = F.try_to_timestamp(text, F.lit(fmt))
    parts = re.findall(r"([A-Za-z])(\1*)|([^A-Za-z])", fmt)
    shapes = [r"\d" + _DIGITS[a + b] if a + b in _DIGITS else None if a else re.escape(c) for a, b, c in parts]
    return parsed if None in shapes else F.when(text.rlike("^" + "".join(shapes) + "$"), parsed)


def _decimal(text: Column) -> Column:
    """Plain numbers take the short way; the rest is regrouped, signed and held to the limit."""
    grouped = F.when(text.contains("."), F.translate(text, ", ", "")).otherwise(
        F.translate(text, "," + _GROUP_SPACES, ".")
    )
    signed = F.when(text.rlike(_NUMBER), F.regexp_replace(grouped, "^(.*)([+-])$", "$2$1"))
    number = signed.try_cast("double")
    return F.when(text.rlike(_COMMON_NUMBER), F.translate(text, ",", ".").try_cast("double")).when(
        F.abs(number) < DECIMAL_LIMIT, number
    )


def conversion_error(value: Column, converted: Column, column_type: str) -> Column:
    """The message for a cell that has text but no value of its type, else NULL."""
    if column_type == "Text":
        return F.lit(None).cast("string")
    # Fixed text: it is a value of the result.
    return F.when(
        converted.isNull() & ~is_blank(value),
        F.concat(F.lit("Value '"), value, F.lit(f"' cannot be converted to {column_type}.")),
    )
