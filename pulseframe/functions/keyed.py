"""Random numbers that depend on row keys only.

The draw of a row is the same under any partitioning and after any task is run again, which plain
``rand()`` does not promise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

HEX_DIGITS = 13  # 52 bits: every draw is an exact double
SCALE = float(16**HEX_DIGITS)


def uniform(keys: list[str | Column], seed: int, salt: str | Column) -> Column:
    """Uniform draw in [0, 1) for the row with these keys; ``salt`` names the purpose."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    salt = F.lit(salt) if isinstance(salt, str) else salt
    text = F.concat_ws("|", *[c.cast("string") for c in columns], F.lit(str(seed)), salt.cast("string"))
    digits = F.substring(F.md5(text), 1, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(SCALE)


def normal(keys: list[str | Column], seed: int, salt: str) -> Column:
    """Standard normal draw (Box-Muller on two uniforms)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(keys, seed, salt + "-r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(keys, seed, salt + "-a"))
