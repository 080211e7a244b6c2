"""Reproducible pseudo-random ordering: md5 of ``seed:row_id``.

The same key is computed by any SQL engine with md5, so ordering, sampling
and fold assignment do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed, *parts) -> Column:
    """Hex md5 of ``seed:part1:part2...`` (parts are columns or names)."""
    cols = [F.lit(str(seed))]
    for p in parts:
        cols.append(F.lit(":"))
        cols.append((F.col(p) if isinstance(p, str) else p).cast("string"))
    return F.md5(F.concat(*cols))


def unit_uniform(seed, *parts) -> Column:
    """A number in (0, 1) from the first 13 hex digits of the seeded md5."""
    h = F.substring(seeded_key(seed, *parts), 1, 13)
    as_long = F.conv(h, 16, 10).cast("double")
    return (as_long + F.lit(0.5)) / F.lit(float(16 ** 13))
