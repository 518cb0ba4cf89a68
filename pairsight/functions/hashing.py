"""Reproducible keys and uniform draws.

Everything random in the library is a function of (seed, key) through MD5. The result is the same
under any partitioning and after a task is run again, which ``rand()`` and
``monotonically_increasing_id`` do not give.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "|"


def stable_key(*parts: Column) -> Column:
    """Hex MD5 over the parts; integers and strings only, so that the text form is unambiguous."""
    return F.md5(F.concat_ws(SEPARATOR, *[p.cast("string") for p in parts]))


def u60(*parts: Column) -> Column:
    """Unsigned 60-bit integer from the first fifteen hex digits of the key.

    A remainder by n is even to within n / 2^60, and any position of a table can be drawn.
    """
    return F.conv(F.substring(stable_key(*parts), 1, 15), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    """Uniform double in [0, 1)."""
    return u60(*parts) / F.lit(1152921504606846976.0)
