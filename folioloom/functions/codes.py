"""Small coded values: Roman numerals, identifiers, and the reversible masking of offline texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman numerals by decimal place.
_PLACES = (("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "M", "MM", "MMM"))
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"


def roman(number: Column) -> Column:
    """1 to 3999 as a Roman numeral, null beyond."""
    digits = [F.array(*[F.lit(x) for x in place]) for place in _PLACES]
    parts = [F.get(digits[p], (F.floor(number / 10**p) % 10).cast("int")) for p in (3, 2, 1, 0)]
    return F.when(number.between(1, 3999), F.concat(*parts))


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID), F.lit(False))


def rolling_hash(c: Column) -> Column:
    """The absolute 32-bit value of h * 31 + code over the characters."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    wrap = lambda v: F.pmod(v + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: wrap(h * 31 + x)))


#: All characters of one byte, and what stands for the character 0, which ``translate`` would delete.
_BYTES, _ZERO = "".join(map(chr, range(256))), chr(256)


def _xored(c: Column, key: Column) -> Column:
    """Characters of one byte, each XORed with ``key`` (0 to 255)."""
    turned = F.array(*[F.lit("".join(chr(b ^ k) if b != k else _ZERO for b in range(256))) for k in range(256)])
    return F.replace(F.call_function("translate", c, F.lit(_BYTES), F.get(turned, key.cast("int"))), F.lit(_ZERO), F.lit("\0"))


def masked(c: Column, key: Column) -> Column:
    """Percent-encoded text, each byte XORed with ``key`` (0 to 254), in base 64. It hides, and protects nothing."""
    from .text import uri_component

    return F.base64(F.encode(_xored(uri_component(c), key), "ISO-8859-1"))


def unmasked(c: Column, key: Column) -> Column:
    """The text that ``masked`` hid."""
    return F.url_decode(F.replace(_xored(F.decode(F.unbase64(c), "ISO-8859-1"), key), F.lit("+"), F.lit("%2B")))


def sealed(c: Column, key: Column, bound: Column) -> Column:
    """Text under AES-GCM with a fresh initial vector, which is put first; the tag is put last. ``bound`` (say the book and
    chapter) is no part of it, and must be the same for it to be opened. ``key`` has 16, 24 or 32 bytes."""
    return F.aes_encrypt(c.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), bound)


def opened(c: Column, key: Column, bound: Column) -> Column:
    """The text that was sealed; null if a byte, the key or ``bound`` differs."""
    return F.try_aes_decrypt(c, key, F.lit("GCM"), F.lit("DEFAULT"), bound).cast("string")
