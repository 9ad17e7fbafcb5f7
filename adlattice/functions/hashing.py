"""Stable hashes: entity split, field-aware token buckets, sampling draws."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlattice.functions.digests import by_length, xxh64

HEX_DIGITS = 15
HASH_SPACE = float(1 << (4 * HEX_DIGITS))


def md5_int(text: Column) -> Column:
    """The leading 60 bits of md5 as a non-negative long; JVM-side and the same in any engine."""
    return F.conv(F.substring(F.md5(text.cast("string")), 1, HEX_DIGITS), 16, 10).cast("long")


def unit_hash(key: Column, seed: int) -> Column:
    """A deterministic draw in [0, 1) for ``key``."""
    return md5_int(F.concat(F.lit(f"{seed}:"), key.cast("string"))).cast("double") / F.lit(HASH_SPACE)


def cumulative_ratios(ratios: Mapping[str, float]) -> list[tuple[str, float]]:
    """Normalised cumulative upper bounds per split name; the last one is always 1."""
    total = float(sum(ratios.values()))
    if total <= 0:
        raise ValueError("split ratios must have a positive sum")
    bounds, acc = [], 0.0
    for name, share in ratios.items():
        acc += share / total
        bounds.append((name, acc))
    bounds[-1] = (bounds[-1][0], 1.0)
    return bounds


def split_name(draw: Column, ratios: Mapping[str, float]) -> Column:
    """The first split whose bound lies above ``draw``."""
    bounds = cumulative_ratios(ratios)
    out = F.lit(bounds[-1][0])
    for name, bound in reversed(bounds[:-1]):
        out = F.when(draw < F.lit(bound), F.lit(name)).otherwise(out)
    return out


def token_message(seed: Column | int, src: Column, field: Column, fid: Column) -> Column:
    seed_col = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.concat(seed_col, F.lit(":"), src.cast("string"), F.lit(":"), field, F.lit(":"), fid)


def token_bucket(src: Column, field: Column, fid: Column, buckets: Column, seed: int = 17) -> Column:
    """Field-aware bucket in [0, buckets): the same fid lands elsewhere in another (src, field)."""
    return F.pmod(md5_int(token_message(seed, src, field, fid)), buckets.cast("long"))


@F.pandas_udf(T.LongType())
def _blake2b_bucket(message: pd.Series, buckets: pd.Series) -> pd.Series:
    digests = (hashlib.blake2b(m.encode("utf-8"), digest_size=16).digest() for m in message)
    return pd.Series([int.from_bytes(d, "big") % int(b) for d, b in zip(digests, buckets)], dtype="int64")


def token_bucket_blake2b(src: Column, field: Column, fid: Column, buckets: Column, seed: int = 17) -> Column:
    """Bucket ids identical to a 128-bit blake2b of the message; opt-in, Arrow-batched."""
    return _blake2b_bucket(token_message(seed, src, field, fid), buckets.cast("long"))


def unit_hash_xxh64(key: Column, seed: int) -> Column:
    """Draw from unseeded xxh64 of ``"seed:key"``; opt-in for parity with splits made that way."""

    @F.pandas_udf(T.DoubleType())
    def draw(text: pd.Series) -> pd.Series:
        return pd.Series(by_length(text, xxh64) / 2.0**64)

    return draw(F.concat(F.lit(f"{seed}:"), key.cast("string")))
