"""Text to typed values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Texts that mean null in a file.
NULL_TOKENS = ["NULL", "null", "", "NA"]


def null_tokens(value: Column) -> Column:
    return F.when(value.isin(*NULL_TOKENS), F.lit(None)).otherwise(value)


def parse_price(text: Column) -> Column:
    """Digits and points of a price text as a double; 0.0 where none is readable."""
    kept = F.regexp_replace(text, "[^0-9.]", "")
    return F.coalesce(kept.try_cast("double"), F.lit(0.0))


# Forms in which a file may write a day, tried in this order after ISO.
DATE_FORMATS = ("MM/dd/yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "MMM d, yyyy")


def lenient_date(text: Column, formats: tuple[str, ...] = ()) -> Column:
    """Date of an ISO text, else of the first format that reads it, null where none does."""
    others = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats]
    return F.coalesce(text.try_cast("date"), *others) if others else text.try_cast("date")


def match_name(name: Column) -> Column:
    """Form in which product names are compared."""
    return F.upper(F.trim(name))


# The signs that take four bits, and what marks a text of others.
PACKED_SIGNS, PLAIN = "0123456789-", b"\x00"


def pack_text(text: Column) -> Column:
    """Text as bytes, two signs a byte where it is made of digits and dashes only; ``unpack_text`` gives it back.

    The first byte tells which: packed signs follow a filling of F.
    """
    signs = F.concat(F.when(F.length(text) % 2 == 0, "FF").otherwise("F"), F.translate(text, "-", "A"))
    plain = F.concat(F.lit(PLAIN), text.cast("binary"))
    return F.when(F.translate(text, PACKED_SIGNS, "") == "", F.unhex(signs)).otherwise(plain)


def unpack_text(packed: Column) -> Column:
    plain = F.substring(packed, 2, 2**31 - 1).cast("string")
    signs = F.translate(F.hex(packed), "AF", "-")
    return F.when(F.substring(packed, 1, 1) == F.lit(PLAIN), plain).otherwise(signs)
