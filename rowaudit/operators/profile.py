"""Profiling and type inference: one aggregation pass over all columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowaudit.functions.numeric import strict_double

NUMERICAL, CATEGORICAL, TEXT, DATETIME = "NUMERICAL", "CATEGORICAL", "TEXT", "DATETIME"


def infer_num_or_cat(df: DataFrame, cols: list[str] | None = None, parse_strings: bool = True) -> DataFrame:
    """(column, auto_type) with auto_type Numerical/Categorical.

    Numeric storage -> Numerical.  Otherwise (parse_strings) the column is
    Numerical if any stripped value parses as a number.
    """
    cols = cols or [c for c in df.columns if c != "row_id"]
    fixed, probe = {}, []
    for c in cols:
        dt = df.schema[c].dataType
        if isinstance(dt, T.NumericType):
            fixed[c] = "Numerical"
        elif not parse_strings:
            fixed[c] = "Categorical"
        else:
            probe.append(c)
    if probe:
        row = df.agg(*[F.max(strict_double(F.col(c)).isNotNull().cast("int")).alias(c) for c in probe]).first()
        for c in probe:
            fixed[c] = "Numerical" if (row[c] or 0) == 1 else "Categorical"
    spark = df.sparkSession
    return spark.createDataFrame([(c, fixed[c]) for c in cols], "column string, auto_type string")


def distinct_sample(df: DataFrame, col: str, n: int = 50) -> DataFrame:
    """Up to n distinct values (as text) in first-seen row order."""
    v = F.coalesce(F.col(col).cast("string"), F.lit("None"))
    g = df.groupBy(v.alias("value")).agg(F.min("row_id").alias("first_row"))
    return g.orderBy("first_row").limit(n)


def normalize_nulls(df: DataFrame) -> DataFrame:
    """NaN -> null in every float/double column."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.when(F.isnan(F.col(f.name)), F.lit(None)).otherwise(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def infer_four_types(df: DataFrame, cols: list[str] | None = None, text_mean_len: float = 30.0) -> dict[str, str]:
    """NUMERICAL / DATETIME / TEXT / CATEGORICAL per column; strings by mean
    length of their text form (null counts as the 4-character 'None')."""
    cols = cols or [c for c in df.columns if c != "row_id"]
    out, strings = {}, []
    for c in cols:
        dt = df.schema[c].dataType
        if isinstance(dt, T.NumericType) and not isinstance(dt, T.BooleanType):
            out[c] = NUMERICAL
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out[c] = DATETIME
        elif isinstance(dt, T.StringType):
            strings.append(c)
        else:
            out[c] = TEXT
    if strings:
        row = df.agg(*[F.avg(F.length(F.coalesce(F.col(c), F.lit("None")))).alias(c) for c in strings]).first()
        for c in strings:
            out[c] = TEXT if (row[c] or 0.0) > text_mean_len else CATEGORICAL
    return {c: out[c] for c in cols}


def four_types_table(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    t = infer_four_types(df, cols)
    return df.sparkSession.createDataFrame(list(t.items()), "column string, data_type string")
