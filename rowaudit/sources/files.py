"""File sources and sinks."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text tokens read as missing (the usual CSV NA spellings).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Spellings read as numbers, whole numbers, booleans and times by ``infer_types``.
INTEGER, NUMBER, BOOLEAN = r"^[+-]?[0-9]{1,18}$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", r"(?i)^(true|false)$"
TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$"


def _csv(spark: SparkSession, paths: list[str], encoding: str, schema, quoted_newlines: bool) -> DataFrame:
    r = (spark.read.option("header", True).option("multiLine", quoted_newlines).option("quote", '"').option("escape", '"')
         .option("encoding", encoding).option("mode", "PERMISSIVE").option("enforceSchema", schema is not None))
    return (r.schema(schema) if schema is not None else r).csv(paths)


def file_encodings(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files below ``path`` that are valid UTF-8, and the others (read as Latin-1).  A distributed
    scan of the bytes of each line; a U+FFFD that a file really holds is valid."""
    lines = spark.read.text(path)  # a text line keeps the bytes of the file
    bad = F.max(F.when(F.is_valid_utf8("value"), 0).otherwise(1))
    found = lines.groupBy(F.col("_metadata.file_path").alias("f")).agg(bad.alias("bad")).collect()  # a row per file
    return [unquote(r["f"]) for r in found if not r["bad"]], [unquote(r["f"]) for r in found if r["bad"]]


def infer_types(df: DataFrame) -> T.StructType:
    """Types of text columns, from one aggregate over all rows: bigint, double, boolean or timestamp
    if every value that is not missing is one, else text."""
    kinds = (("long", INTEGER), ("double", NUMBER), ("boolean", BOOLEAN), ("timestamp", TIMESTAMP))
    tests = []
    for i, f in enumerate(df.schema.fields):
        c = F.btrim(F.col(f"`{f.name}`"))
        tests += [F.count(c).alias(f"n{i}"), *[F.count_if(c.rlike(p)).alias(f"{k}{i}") for k, p in kinds]]
    row = df.agg(*tests).first()
    out = T.StructType()
    for i, f in enumerate(df.schema.fields):
        kind = next((k for k, _ in kinds if row[f"n{i}"] and row[f"{k}{i}"] == row[f"n{i}"]), "string")
        out.add(f.name, "double" if not row[f"n{i}"] else kind)  # an empty column is a numeric one
    return out


def _na_to_null(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(NA_TOKENS), F.lit(None)).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def read_csv(spark: SparkSession, path: str, schema=None, infer_schema: bool = False, quoted_newlines: bool = True) -> DataFrame:
    """Header CSV; files that are not valid UTF-8 are read as Latin-1, each on its own.  NA tokens
    become null.  ``infer_schema`` types the columns by all values, in one more pass.  Without
    ``quoted_newlines`` a file is split over many tasks; with them Spark reads it in one."""
    utf8, latin = file_encodings(spark, path)
    if utf8 and latin:
        parts = [_csv(spark, files, code, schema, quoted_newlines) for files, code in ((utf8, "UTF-8"), (latin, "ISO-8859-1"))]
    else:
        parts = [_csv(spark, [path], "ISO-8859-1" if latin else "UTF-8", schema, quoted_newlines)]
    df = _na_to_null(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=schema is None))
    if schema is not None or not infer_schema:
        return df
    kinds = infer_types(df)
    return df.select(*[F.btrim(F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
                       for f in kinds.fields])


def read_json_records(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A JSON array of row objects (one document per file)."""
    r = spark.read.option("multiLine", True)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_jsonl(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """JSON lines: one object per line (splittable).  ``options`` go to the JSON reader."""
    r = spark.read.options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def write_clean_csv(df: DataFrame, flags: DataFrame | None, path: str, drop_cols=("row_id",)) -> None:
    """Rows not flagged, as header CSV: quote when needed, double the quotes,
    null as empty.  The anti join runs distributed; files are written per task."""
    out = df if flags is None else df.join(flags.select("row_id"), "row_id", "left_anti")
    out = out.drop(*[c for c in drop_cols if c in out.columns])
    (out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").option("nullValue", "").csv(path))
