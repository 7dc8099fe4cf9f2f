"""Keys: UUID spellings and the integer form that range operators work on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that may surround a key.
OUTER_BLANKS = " \t\r\n\f\v\u00a0\u200b\ufeff"


def uuid_hex(text: Column) -> Column:
    """The 32 lower-case hex digits of a UUID in any of its spellings, or null if the text is no whole UUID.

    Case, hyphens, braces, a ``urn:uuid:`` prefix and outer blanks don't matter.
    """
    bare = F.lower(F.btrim(text, F.lit(OUTER_BLANKS)))
    bare = F.when(bare.startswith("urn:uuid:"), F.substring(bare, 10, 1000)).otherwise(bare)
    bare = F.translate(bare, "{}-", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare)


def hex_block(digits: Column, bits: int = 16) -> tuple[Column, Column]:
    """(block, offset) of a 32-digit hex key seen as a 128-bit integer.

    A block holds 2**bits consecutive integers, so it bounds the size of any group that is built on it; the offset
    is the key's place in its block. ``bits`` is a multiple of 4.
    """
    n = bits // 4
    return F.substring(digits, 1, 32 - n), F.conv(F.substring(digits, 33 - n, n), 16, 10).cast("int")


def integer_hex(number: Column) -> Column:
    """A non-negative integer key as 32 hex digits, so that integer keys use the same operators."""
    return F.lpad(F.lower(F.hex(number.cast("long"))), 32, "0")
