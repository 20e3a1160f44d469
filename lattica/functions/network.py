"""Network addresses as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ipv4(text: Column) -> Column:
    """Dotted text as a number; null if it isn't an address."""
    p = F.split(text, "\\.")
    part = [F.get(p, F.lit(i)).try_cast("bigint") for i in range(4)]
    good = (F.size(p) == 4) & part[0].between(0, 255) & part[1].between(0, 255) & part[2].between(0, 255) & part[3].between(0, 255)
    return F.when(good, ((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3])


def ipv4_text(ip: Column) -> Column:
    octet = lambda k: F.shiftright(ip, 8 * k).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", octet(3), octet(2), octet(1), octet(0))


def domain(ip: Column) -> Column:
    """The address with its last octet zero."""
    return ip - ip % 256


def mac(text: Column) -> Column:
    """Hexadecimal pairs with : or - as a number; null if it isn't an address."""
    plain = F.regexp_replace(text, "[:-]", "")
    return F.when(plain.rlike("^[0-9A-Fa-f]{12}$"), F.conv(plain, 16, 10).cast("bigint"))
