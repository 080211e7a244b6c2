"""Scalar Column builders (JVM-side built-ins only; no Python UDFs)."""

from rowaudit.functions.numeric import (  # noqa: F401
    clean_nonfinite, is_number_text, not_nan, py_strip, strict_double,
)
from rowaudit.functions.hashing import seeded_key  # noqa: F401
from rowaudit.functions.text import (  # noqa: F401
    clean_text, has_html, has_url, pii_kind, tokens, word_count,
)
