"""Vector expressions as Columns over ARRAY<DOUBLE>; every sum runs from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def ip(x, y) -> Column:
    """Inner product."""
    return total(F.zip_with(_col(x), _col(y), lambda a, b: a * b))


def neg_ip(x, y) -> Column:
    """Inner product as a distance."""
    return -ip(x, y)


def l2sqr(x, y) -> Column:
    return total(F.zip_with(_col(x), _col(y), lambda a, b: (a - b) * (a - b)))


def l2(x, y) -> Column:
    return F.sqrt(l2sqr(x, y))


def l1(x, y) -> Column:
    return total(F.zip_with(_col(x), _col(y), lambda a, b: F.abs(a - b)))


def linf(x, y) -> Column:
    return F.array_max(F.zip_with(_col(x), _col(y), lambda a, b: F.abs(a - b)))


def norm2(x) -> Column:
    """Squared length."""
    return ip(x, x)


def cosine(x, y) -> Column:
    return ip(x, y) / (F.sqrt(norm2(x)) * F.sqrt(norm2(y)))


def unit(x, plus: float = 0.0) -> Column:
    """x divided by its length; ``plus`` guards queries against a zero length."""
    length = F.sqrt(norm2(x)) + F.lit(plus)
    return F.transform(_col(x), lambda v: v / length)


#: Distances are smaller-is-better; a score is larger-is-better.
METRICS = {"ip": neg_ip, "l2sqr": l2sqr, "l2": l2, "l1": l1, "linf": linf, "cosine": lambda x, y: -cosine(x, y)}


def hamming(x, y) -> Column:
    """Differing bits of two 64-bit codes."""
    return F.bit_count(_col(x).bitwiseXOR(_col(y)))


def or_bits(x, y) -> Column:
    return F.bit_count(_col(x).bitwiseOR(_col(y)))


def and_bits(x, y) -> Column:
    return F.bit_count(_col(x).bitwiseAND(_col(y)))


def jaccard_bits(x, y) -> Column:
    """Jaccard distance of bit sets; 1 for two empty ones."""
    return F.when(or_bits(x, y) == 0, F.lit(1.0)).otherwise((or_bits(x, y) - and_bits(x, y)) / or_bits(x, y).cast("double"))


def estimated_ip(norm, x, y, bits: int = 64) -> Column:
    """Inner product with a unit query, estimated from two codes."""
    return _col(norm) * F.cos(F.lit(3.141592653589793) * hamming(x, y) / F.lit(float(bits)))


def common_prefix(x, y) -> Column:
    """Length of the common prefix of two non-negative 64-bit keys; 64 when equal."""
    v = _col(x).bitwiseXOR(_col(y))
    return F.when(v == 0, F.lit(64)).otherwise(64 - F.length(F.bin(v)))


def level(x, y, width: int, top: int) -> Column:
    """Number of whole groups of ``width`` low bits in which the keys agree; ``top`` when equal."""
    v = _col(x).bitwiseXOR(_col(y))
    zeros = F.bit_count(v.bitwiseAND(-v) - 1)
    return F.when(v == 0, F.lit(top)).otherwise(F.floor(zeros / F.lit(width)).cast("int"))


def edge_key(x, y) -> Column:
    """One integer for an undirected edge of 31-bit ids."""
    return F.shiftleft(F.greatest(_col(x), _col(y)).cast("bigint"), 32).bitwiseOR(F.least(_col(x), _col(y)).cast("bigint"))


def lifted(vec, top_norm2, sign) -> Column:
    """The vector with sign * sqrt(top_norm2 - |vec|^2) appended, so that all lengths are equal."""
    rest = F.greatest(_col(top_norm2) - norm2(vec), F.lit(0.0))
    return F.concat(_col(vec), F.array(_col(sign) * F.sqrt(rest)))
