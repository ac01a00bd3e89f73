"""Portable seeded randomness as column expressions.

``hash_uniform(seed, tag, key)`` = first 13 hex digits of md5('seed|tag|key') / 2^52, a
uniform in [0, 1) that depends only on the row key, never on partition layout or task
retries (``F.rand`` does both). The same formula runs in DuckDB, so every sampler and
generator built on it has an exact SQL twin. All derived draws (gaussian, laplace,
index into a donor table) are arithmetic on these uniforms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2 ** 52)


def _key_string(seed, tag: str | Column, keys) -> Column:
    parts = [F.lit(str(seed)), tag if isinstance(tag, Column) else F.lit(str(tag))]
    for k in keys:
        parts.append((F.col(k) if isinstance(k, str) else k).cast("string"))
    return F.concat_ws("|", *parts)


def hash_uniform(seed, tag: str | Column, *keys) -> Column:
    """Uniform in [0, 1) from (seed, tag, key...). Keys are column names or Columns; a tag may vary by row as a Column."""
    hexpart = F.substring(F.md5(_key_string(seed, tag, keys)), 1, 13)
    return F.conv(hexpart, 16, 10).cast("bigint").cast("double") / F.lit(TWO_52)


def hash_uniform_sql(seed, tag: str, *key_sql: str) -> str:
    """DuckDB text of the same uniform (used by the SQL oracles)."""
    inner = ", ".join([f"'{seed}'", f"'{tag}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {inner})), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def hash_gaussian(seed, tag: str | Column, *keys) -> Column:
    """Standard normal by Box-Muller on two independent hash uniforms."""
    ending = lambda end: F.concat(tag, F.lit(end)) if isinstance(tag, Column) else f"{tag}{end}"
    u1 = F.lit(1.0) - hash_uniform(seed, ending("#u1"), *keys)   # (0, 1]
    u2 = hash_uniform(seed, ending("#u2"), *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def hash_gaussian_sql(seed, tag: str, *key_sql: str) -> str:
    u1 = f"(1.0 - {hash_uniform_sql(seed, f'{tag}#u1', *key_sql)})"
    u2 = hash_uniform_sql(seed, f"{tag}#u2", *key_sql)
    return f"(sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi!r} * {u2}))"


def laplace_from_uniform(u: Column, scale) -> Column:
    """Laplace(0, scale) by the inverse CDF of a uniform in [0, 1)."""
    centred = u - F.lit(0.5)
    scale_col = scale if isinstance(scale, Column) else F.lit(float(scale))
    return -scale_col * F.signum(centred) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(centred))
