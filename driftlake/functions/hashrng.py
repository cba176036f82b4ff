"""Random numbers as functions of a seed and a key: the same on every machine, in every rerun, and in other engines."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first 13 hexadecimal digits of an MD5 are 52 bits, which a double holds exactly.
DIGITS, SCALE = 13, float(1 << 52)


def uniform(seed: int, *key: Column) -> Column:
    """Double in [0, 1) from the text seed:key1:key2..."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") / SCALE


def uniform_sql(seed: int, *key: str) -> str:
    """The same as DuckDB SQL; key: SQL expressions, cast to text as Spark does."""
    text = " || ':' || ".join([f"'{seed}'", *(f"CAST({k} AS VARCHAR)" for k in key)])
    return f"(CAST(('0x' || substr(md5({text}), 1, {DIGITS})) AS BIGINT) / {SCALE:.1f})"


def uniform_of(seed: int, *key: object) -> float:
    """The same for plain values."""
    text = ":".join(map(str, (seed, *key)))
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16) / SCALE


def normal(seed: int, *key: Column) -> Column:
    """Standard normal deviate (Box-Muller)."""
    u, v = uniform(seed, *key, F.lit("u")), uniform(seed, *key, F.lit("v"))
    return F.sqrt(-2 * F.log1p(-u)) * F.cos(v * 6.283185307179586)


def gamma(seed: int, shape: int, *key: Column) -> Column:
    """Gamma deviate of whole shape and scale 1: a sum of exponential ones."""
    out = F.lit(0.0)
    for i in range(shape):
        out = out - F.log1p(-uniform(seed, *key, F.lit(i)))
    return out


def gamma_of(seed: int, shape: float, *key: object) -> float:
    """Gamma deviate of scale 1 for plain values: exponential ones for the whole part of shape, and a share of one (by rejection) for the rest."""
    whole = int(shape)
    rest, out, turn = shape - whole, 0.0, 0
    for i in range(whole):
        out -= math.log1p(-uniform_of(seed, *key, i))
    while rest > 0:
        x, y = uniform_of(seed, *key, "x", turn) ** (1 / rest), uniform_of(seed, *key, "y", turn) ** (1 / (1 - rest))
        if 0 < x + y <= 1:
            return out - math.log1p(-uniform_of(seed, *key, "e", turn)) * x / (x + y)
        turn += 1
    return out
