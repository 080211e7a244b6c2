"""rowaudit: audit and clean machine-learning training data with Spark DataFrames.

Every operator takes and returns DataFrames; the driver only ever sees rule
configs, one-row statistics, fitted coefficients and bounded model tables.
"""

from rowaudit.session import get_spark, shared_dir  # noqa: F401

__version__ = "0.1.0"
