"""Text of cells: whitespace, single-byte encodings, and how a value is spelled in a file."""

from __future__ import annotations

import codecs

from pyspark.sql import Column, functions as F, types as T

# Every Unicode white-space character.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column) -> Column:
    """Cut Unicode white space from both ends (Spark's own trim knows the space only)."""
    return F.btrim(value, F.lit(WHITESPACE))


def has_padding(raw: Column, delimiter: str) -> Column:
    """Whether any cell of a raw record may start or end with white space: one look for all cells.

    Plain substring searches settle nearly every record; the answer may be yes once too often.
    """
    found = raw.startswith(" ") | raw.endswith(" ")
    for edge in {delimiter, '"'}:
        found = found | raw.contains(edge + " ") | raw.contains(" " + edge)
    for control in "\t\n\x0b\x0c\r":
        if control == delimiter:
            found = found | raw.contains('"' + control) | raw.contains(control + '"')
        else:
            found = found | raw.contains(control)
    other_space = raw.rlike("[" + "".join(ch for ch in WHITESPACE if ord(ch) > 127) + "]")
    return found | ((F.length(raw) != F.octet_length(raw)) & other_space)


def is_blank(value: Column) -> Column:
    return F.coalesce(strip(value), F.lit("")) == ""


def decode_bytes(value: Column, encoding: str) -> Column:
    """Text whose bytes are in ``encoding``; one byte per character, or UTF-8.

    Bytes are read as ISO-8859-1 and the characters that differ are translated, so that any
    code page works in the JVM without the session's legacy charset switch.
    """
    codec = codecs.lookup(encoding).name
    if codec in ("utf-8", "utf-8-sig", "ascii"):
        return value
    latin, wanted = _code_page(codec)
    return F.translate(F.decode(value.cast("binary"), "ISO-8859-1"), latin, wanted)


def encode_bytes(value: Column, encoding: str) -> Column:
    """The reverse of ``decode_bytes``: a string column that holds the encoded bytes."""
    latin, wanted = _code_page(codecs.lookup(encoding).name)
    return F.encode(F.translate(value, wanted, latin), "ISO-8859-1").cast("string")


def _code_page(codec: str) -> tuple[str, str]:
    """Characters that a code page has in place of the ISO-8859-1 ones."""
    if bytes(range(32, 127)).decode(codec, "replace") != bytes(range(32, 127)).decode("ascii"):
        raise ValueError(f"Encoding '{codec}' does not extend ASCII by one byte per character.")
    latin, wanted = [], []
    for code in range(128, 256):
        character = bytes([code]).decode(codec, "ignore")
        if character and character != chr(code):
            latin.append(chr(code))
            wanted.append(character)
    return "".join(latin), "".join(wanted)


def cell_text(value: Column, dtype: T.DataType) -> Column:
    """A value as it is written to a file, independent of locale; NULL stays NULL.

    Whole numbers carry no ``.0``, exponents appear only outside 1e-5..1e15, booleans are 1 and 0,
    and timestamps are ISO 8601 with seven decimals (and an offset when the type has one).
    """
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, T.BooleanType):
        return value.cast("int").cast("string")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return _number_text(value)
    if isinstance(dtype, T.TimestampNTZType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0'")
    if isinstance(dtype, T.TimestampType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0'xxx")
    return value.cast("string")


def _number_text(value: Column) -> Column:
    spelled = value.cast("string")
    plain = F.when(spelled.endswith(".0"), F.left(spelled, F.length(spelled) - 2)).otherwise(spelled)
    unrolled = F.regexp_replace(
        F.regexp_replace(spelled.try_cast("decimal(38,22)").cast("string"), "0+$", ""), r"\.$", ""
    )
    mantissa = F.regexp_replace(F.split_part(spelled, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(spelled, F.lit("E"), F.lit(2))
    signed = F.concat(
        F.when(power.startswith("-"), "E-").otherwise("E+"), F.lpad(F.ltrim(power, F.lit("-")), 2, "0")
    )
    size = F.abs(value)
    return (
        F.when(~spelled.contains("E"), plain)
        .when((size >= 1e-5) & (size < 1e15), unrolled)
        .otherwise(F.concat(mantissa, signed))
    )
