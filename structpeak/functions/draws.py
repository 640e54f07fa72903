"""Seeded pseudo-random draws as integer column arithmetic.

Every draw is a pure function of (seed, key, stream): the result does not depend on
partitioning, task retries or row order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the Mersenne prime 2^31 - 1; squares of residues stay inside a bigint.
MODULUS = 2147483647


def order_digest(seed: int, *keys: Column) -> Column:
    """Hex digest that puts keys into a seeded, reproducible random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def key_seed(*parts: Column) -> Column:
    """28-bit integer seed from the text of the parts."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint")


def residue(seed: Column, stream: Column | int) -> Column:
    """Mixed integer in [0, MODULUS) for one stream of a seed."""
    s = (F.lit(stream) if isinstance(stream, int) else stream).cast("bigint")
    p = F.lit(MODULUS).cast("bigint")
    x = (seed + s * F.lit(1000003).cast("bigint")) % p
    y = (x * x + s) % p
    return (y * F.lit(48271).cast("bigint") + F.lit(11).cast("bigint")) % p


def uniform(seed: Column, stream: Column | int) -> Column:
    """Uniform draw in (0, 1)."""
    return (residue(seed, stream).cast("double") + F.lit(0.5)) / F.lit(float(MODULUS))


def gaussian(seed: Column, stream: Column | int) -> Column:
    """Standard normal draw from two uniform streams (Box-Muller)."""
    s = F.lit(stream) if isinstance(stream, int) else stream
    a, b = uniform(seed, s), uniform(seed, s + F.lit(1))
    return F.sqrt(F.lit(-2.0) * F.log(a)) * F.cos(F.lit(6.283185307179586) * b)
