"""Shared column builders and staging helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowaudit.session import shared_dir

#: Blanks between words: space and the five ASCII controls tab .. carriage return.
BLANK = r"\x20\x09-\x0D"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the non-blank runs of a text; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANK}]+"))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{BLANK}]+")).cast("long")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` (a lambda variable, so
    the optimizer cannot inline the expression at each use)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh folder below the shared checkpoint folder and read it back.
    Cuts lineage, survives lost executors and keeps column pruning."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not use, derived from ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def shielded(docs: DataFrame, core: tuple[str, ...]) -> tuple[DataFrame, "callable"]:
    """``docs`` with every column outside ``core`` packed into one struct, so that no
    extra column can clash with an operator's own names, and the function that unpacks
    it and restores the column order."""
    extra = [c for c in docs.columns if c not in core]
    if not extra:
        return docs, lambda df: df.select(*docs.columns)
    packed = docs.select(*[c for c in docs.columns if c in core],
                         F.struct(*[F.col(f"`{c}`") for c in extra]).alias("_extra"))
    at = {c: F.col("_extra").getField(c) for c in extra}
    return packed, lambda df: df.select(*[at[c].alias(c) if c in at else F.col(c) for c in docs.columns])
