"""Repeatable randomness: a draw depends on (seed, tag, row key) only, never on the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: int, tag: str, *keys: Column) -> Column:
    """Uniform on the open interval (0, 1); for synthetic rows, not for private noise (:func:`secret_uniforms`)."""
    bits = F.xxhash64(F.lit(seed), F.lit(tag), *keys).bitwiseAND(F.lit((1 << 52) - 1))
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def normal(seed: int, tag: str, *keys: Column) -> Column:
    """Standard normal by the Box-Muller transform."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(seed, tag + "/radius", *keys)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(seed, tag + "/angle", *keys))


def laplace(seed: int, tag: str, *keys: Column) -> Column:
    """Laplace with scale 1."""
    return laplace_of(uniform(seed, tag, *keys))


_DIGITS = 13  # hexadecimal digits of a uniform: 52 bits
_A_DIGEST = 128 // _DIGITS


def secret_uniforms(df: DataFrame, secret: str, keys: list[Column], n: int) -> tuple[DataFrame, list[Column]]:
    """``df`` with the digests of its rows' keys, and ``n`` columns uniform on (0, 1) cut from them.

    A SHA-512 keyed with the secret serves nine columns. Key values are written with their lengths,
    so that no two keys read the same. The digests (``_digests``) are made once a row: dropped by the caller.
    """
    spelt = F.concat(*[F.coalesce(F.concat(F.length(k.cast("string")).cast("string"), F.lit(":"), k.cast("string")), F.lit("-")) for k in keys])
    digests = F.array(*[F.sha2(F.concat(F.lit(f"{secret}/{i}/"), spelt), 512) for i in range(-(-n // _A_DIGEST))])
    # explode(array(x)) evaluates x once per row; as a plain column it would be copied into every use.
    made = df.select("*", F.explode(F.array(digests)).alias("_digests"))

    def cut(i: int) -> Column:
        digits = F.substring(F.col("_digests")[i // _A_DIGEST], 1 + i % _A_DIGEST * _DIGITS, _DIGITS)
        return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))

    return made, [cut(i) for i in range(n)]


def normals_of(uniforms: list[Column]) -> list[Column]:
    """As many standard normals as uniforms (an even number): two from each pair."""
    found = []
    for radius, angle in zip(uniforms[::2], uniforms[1::2]):
        length, turn = F.sqrt(F.lit(-2.0) * F.log(radius)), F.lit(2.0 * math.pi) * angle
        found += [length * F.cos(turn), length * F.sin(turn)]
    return found


def laplace_of(u: Column) -> Column:
    """Laplace with scale 1 by inversion of the distribution function."""
    centred = u - F.lit(0.5)
    return -F.signum(centred) * F.log(F.greatest(F.lit(1.0) - F.lit(2.0) * F.abs(centred), F.lit(2.0 ** -53)))


def choice(values: list, seed: int, tag: str, *keys: Column) -> Column:
    """One of ``values`` with equal chance."""
    options = F.array(*[F.lit(v) for v in values])
    pick = F.floor(uniform(seed, tag, *keys) * F.lit(len(values))).cast("int") + F.lit(1)
    return F.element_at(options, pick)
