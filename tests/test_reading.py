"""CSV: encoding per file, typed columns, splits; quantiles of many columns."""

import numpy as np
from pyspark.sql import functions as F

from rowaudit.operators.stats import column_quantiles, column_stats
from rowaudit.sources.files import file_encodings, infer_types, read_csv


def _write(folder, **files):
    for name, data in files.items():
        (folder / f"{name}.csv").write_bytes(data)
    return str(folder)


def test_mixed_encodings_in_one_folder(spark, tmp_path):
    path = _write(tmp_path, a="k,v\n1,é\n2,real � mark\n".encode(), b="k,v\n3,café\n".encode("latin-1"))
    utf8, latin = file_encodings(spark, path)
    assert [f[-5:] for f in utf8] == ["a.csv"] and [f[-5:] for f in latin] == ["b.csv"]
    got = {r.k: r.v for r in read_csv(spark, path).collect()}
    assert got == {"1": "é", "2": "real � mark", "3": "café"}


def test_types_are_inferred_from_all_values(spark, tmp_path):
    lines = ["i,f,b,t,s,e"] + [f"{i},{i}.5,true,2024-01-{i % 28 + 1:02d} 10:00:00,x{i},NA" for i in range(500)] + ["NA,1e3,FALSE,2024-02-01,7,", "7,nan,NA,NA,8,NA"]
    path = _write(tmp_path, a="\n".join(lines).encode())
    df = read_csv(spark, path, infer_schema=True)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "timestamp", "string", "double"]
    assert df.count() == 502 and df.where("f is null").count() == 1 and df.agg(F.sum("i")).first()[0] == sum(range(500)) + 7
    assert infer_types(read_csv(spark, path)).simpleString() == df.schema.simpleString()


def test_quoted_newlines_and_splits(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "p").mkdir()
    path = _write(tmp_path / "q", a=b'k,v\n1,"two\nlines, ""quoted"""\n')
    assert [tuple(r) for r in read_csv(spark, path).collect()] == [("1", 'two\nlines, "quoted"')]
    path = _write(tmp_path / "p", a=("k,v\n" + "".join(f"{i},text {i}\n" for i in range(200_000))).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        df = read_csv(spark, path, quoted_newlines=False)
        assert df.rdd.getNumPartitions() > 3 and df.count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_quantiles_of_many_columns(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(4000, 12))
    X[:, 3] = rng.integers(0, 3, 4000)
    X[:, 4] = 7.0
    X[::2, 5] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in x) for x in X], ", ".join(f"c{i} double" for i in range(12)))
    qs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    for accuracy in (100, 10_000):
        got = column_quantiles(df.withColumn("none", F.lit(None).cast("double")), {c: F.col(c) for c in [*df.columns, "none"]}, qs, accuracy)
        for i in range(12):
            assert np.allclose(got[f"c{i}"], np.nanpercentile(X[:, i], [100 * q for q in qs]), rtol=0, atol=1e-12)
        assert got["none"] == [None] * 6
    st = {r["column"]: r for r in column_stats(df, df.columns).collect()}
    assert len(st) == 12 and np.isclose(st["c5"]["median"], np.nanmedian(X[:, 5])) and st["c5"]["n"] == 2000
