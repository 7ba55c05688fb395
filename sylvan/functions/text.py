"""Text, byte and number columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sylvan import constants as K

# Splits a double into two halves whose products with small integers are exact.
_SPLITTER = 134217729.0


def trim(text: Column) -> Column:
    """Strip Unicode white space, line ends and the byte-order mark."""
    return F.btrim(text, F.lit(K.SPACE_CHARS))


def indent_width(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line, F.lit(K.SPACE_CHARS)))


def decode_text(content: Column) -> Column:
    """Bytes as text; bad UTF-8 becomes U+FFFD, never an error."""
    return F.make_valid_utf8(content.cast("string"))


def is_binary(content: Column) -> Column:
    """NUL byte, or more than 30 % control bytes, in the leading sample."""
    head = F.substring(content, 1, K.BINARY_SAMPLE_BYTES)
    # one character per byte, so that character classes count bytes
    chars = F.decode(head, "ISO-8859-1")
    controls = F.regexp_count(chars, F.lit(K.CONTROL_BYTES))
    return (F.octet_length(head) > 0) & (
        F.contains(chars, F.lit("\0"))
        | (controls > F.lit(K.BINARY_THRESHOLD) * F.octet_length(head))
    )


def line_count(text: Column) -> Column:
    """Pieces between newlines: 1 for empty text."""
    bare = F.replace(text, F.lit("\n"), F.lit(""))
    return (F.length(text) - F.length(bare) + 1).cast("long")


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: code points, supplementary ones twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def tokens_of(units: Column) -> Column:
    """Token estimate of a length in UTF-16 units: a quarter, rounded up."""
    return F.ceil(units / K.BYTES_PER_TOKEN_UNIT).cast("long")


def one_decimal(value: Column) -> Column:
    """Text with one decimal, rounded half up on the exact binary value.

    ``value * 10`` is compared with the half-way point without rounding error
    (the double is split in two halves), so 1.15, which is stored a little
    lower, gives 1.1 and 1.25 gives 1.3.
    """
    value = value.cast("double")
    wide = value * _SPLITTER
    high = wide - (wide - value)
    low = value - high
    floor = F.floor(value * 10.0)
    above_half = (high * 10.0 - (floor + 0.5)) + low * 10.0 >= 0
    tenths = floor + above_half.cast("long")
    return F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")
    )


def format_bytes(size: Column) -> Column:
    """``0 B``, else one decimal in B, KB, MB, GB, TB or PB (by 1024)."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    out = F.when(size == 0, F.lit("0 B"))
    for power, unit in enumerate(units):
        text = F.concat(one_decimal(size / float(1024**power)), F.lit(f" {unit}"))
        last = power == len(units) - 1
        out = out.otherwise(text) if last else out.when(size < 1024 ** (power + 1), text)
    return out


def format_count(count: Column) -> Column:
    """Plain below 1000, then ``x.xk``, then ``x.xm``."""
    return (
        F.when(count < 1000, count.cast("string"))
        .when(count < 1_000_000, F.concat(one_decimal(count / 1000.0), F.lit("k")))
        .otherwise(F.concat(one_decimal(count / 1_000_000.0), F.lit("m")))
    )
