"""Number parsing with the semantics of a Python ``float()`` on trimmed text.

Spark's ``try_cast`` accepts things Python rejects (``'1d'`` -> 1.0), so the
cast is guarded by a regular expression.  Underscore digit groups (``1_000``)
are treated as type errors on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted textual number forms.
DECIMAL_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SPECIAL_PATTERN = r"(?i)^[+-]?(nan|inf|infinity)$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Strip all leading/trailing whitespace (``trim`` only strips spaces)."""
    return F.regexp_replace(_col(c).cast("string"), r"^\s+|\s+$", "")


def is_number_text(c) -> Column:
    s = py_strip(c)
    return s.rlike(DECIMAL_PATTERN) | s.rlike(SPECIAL_PATTERN)


def strict_double(c) -> Column:
    """Double value of a column, null if it is not a number in Python's sense.

    Numeric input is passed through; strings are stripped, checked and cast.
    """
    s = py_strip(c)
    return F.when(is_number_text(c), s.try_cast("double"))


def not_nan(c) -> Column:
    """True unless the value is NaN (``NaN > 1`` is true in Spark)."""
    return ~F.isnan(_col(c))


def clean_nonfinite(c) -> Column:
    """+-Inf and NaN and null -> 0.0."""
    x = _col(c).cast("double")
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(F.when(bad, F.lit(0.0)).otherwise(x), F.lit(0.0))
