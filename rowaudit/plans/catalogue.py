"""Registered queries over the driver's test tables, each with a DuckDB
oracle where one can be written.  Every query reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowaudit.functions.text import FUNCTION_WORDS, likely_language
from rowaudit.operators import flags as fl
from rowaudit.operators import outliers as ol
from rowaudit.operators import rules as ru

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- configs
# Rules over `events` used by the phase-1/phase-2 queries.
EVENT_RULES = [
    ru.ColumnRule("value", ru.NUMERICAL, min_val=0.05, max_val=400.0),
    ru.ColumnRule("event_type", ru.CATEGORICAL, valid_categories=["click", "view", "purchase", "signup"]),
    ru.ColumnRule("user_id", ru.NUMERICAL, min_val=0, max_val=140),
]
EVENT_P1_SQL = """
WITH f AS (
  SELECT event_id AS row_id,
    CASE WHEN value IS NOT NULL AND NOT isnan(value) AND (value < 0.05 OR value > 400.0) THEN 0
         WHEN event_type IS NOT NULL AND event_type NOT IN ('click','view','purchase','signup') THEN 1
         WHEN user_id IS NOT NULL AND (user_id < 0 OR user_id > 140) THEN 2 END AS seq
  FROM events)
SELECT f.row_id, CAST(1 AS INTEGER) AS phase, CAST(f.seq AS INTEGER) AS seq, r.col AS "column", r.reason
FROM f JOIN (VALUES (0, 'value', 'Range violation value'),
                    (1, 'event_type', 'Invalid category event_type'),
                    (2, 'user_id', 'Range violation user_id')) r(seq, col, reason) ON f.seq = r.seq
"""


def events(spark, sf):
    return table(spark, sf, "events").withColumn("row_id", F.col("event_id"))


def event_p1(spark, sf):
    return ru.check_table(events(spark, sf), EVENT_RULES, "p1")


# ------------------------------------------------------- B: profiling
@register("row_count", "SELECT CAST(count(*) AS BIGINT) AS n_rows FROM events")
def q_row_count(spark, sf):
    return events(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"))


@register("preview", "SELECT event_id, ts, user_id, event_type, value FROM events ORDER BY event_id LIMIT 50")
def q_preview(spark, sf):
    df = events(spark, sf)
    return fl.first_rows(df, None, 50).select("event_id", "ts", "user_id", "event_type", "value")


# ------------------------------------------------------- D: gatekeeper
@register("range_check", """
SELECT event_id AS row_id, value FROM events
WHERE value IS NOT NULL AND NOT isnan(value) AND (value < 0.05 OR value > 400.0)
""")
def q_range_check(spark, sf):
    df = events(spark, sf)
    f = ru.check_table(df, [EVENT_RULES[0]], "p1")
    return f.where(F.col("p1").isNotNull()).select("row_id", "value")


@register("category_check", """
SELECT event_id AS row_id, event_type FROM events
WHERE event_type IS NOT NULL AND event_type NOT IN ('click','view','purchase','signup')
""")
def q_category_check(spark, sf):
    f = ru.check_table(events(spark, sf), [EVENT_RULES[1]], "p1")
    return f.where(F.col("p1").isNotNull()).select("row_id", "event_type")


@register("first_violation", EVENT_P1_SQL)
def q_first_violation(spark, sf):
    return fl.flags_from(event_p1(spark, sf), "p1", 1).drop("score")


# ------------------------------------------------------- shared SQL pieces
def _sql_list(items) -> str:
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in items)


def _events_nulls(spark, sf):
    """events with nulls made where event_id % 17 = 0 (value, event_type) and
    % 13 = 0 or < 3 (ts); the test tables have none."""
    e = events(spark, sf)
    return (e.withColumn("value", F.when(F.col("event_id") % 17 == 0, F.lit(None)).otherwise(F.col("value")))
             .withColumn("event_type", F.when(F.col("event_id") % 17 == 0, F.lit(None)).otherwise(F.col("event_type")))
             .withColumn("ts", F.when((F.col("event_id") % 13 == 0) | (F.col("event_id") < 3), F.lit(None))
                         .otherwise(F.col("ts"))))


EVENTS_NULLS_SQL = """events_n AS (
  SELECT event_id AS row_id, event_id, user_id, props,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS event_type,
    CASE WHEN event_id % 13 = 0 OR event_id < 3 THEN NULL ELSE ts END AS ts
  FROM events)"""

STRICT_NUM_SQL = ("CASE WHEN regexp_matches(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), "
                  "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') "
                  "OR regexp_matches(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '(?i)^[+-]?(nan|inf|infinity)$') "
                  "THEN TRY_CAST(regexp_replace({x}, '^\\s+|\\s+$', '', 'g') AS DOUBLE) END")


def strict_num_sql(x: str) -> str:
    return STRICT_NUM_SQL.format(x=x)


# ------------------------------------------------------- B: profiling (cont.)
@register("infer_num_or_cat", f"""
SELECT 'o_orderkey' AS "column", 'Numerical' AS auto_type
UNION ALL SELECT 'o_orderstatus', CASE WHEN max(CASE WHEN {strict_num_sql('o_orderstatus')} IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN 'Numerical' ELSE 'Categorical' END FROM orders
UNION ALL SELECT 'price_text', CASE WHEN max(CASE WHEN {strict_num_sql('CAST(o_totalprice AS VARCHAR)')} IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN 'Numerical' ELSE 'Categorical' END FROM orders
UNION ALL SELECT 'o_orderpriority', CASE WHEN max(CASE WHEN {strict_num_sql('o_orderpriority')} IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN 'Numerical' ELSE 'Categorical' END FROM orders
""")
def q_infer_num_or_cat(spark, sf):
    from rowaudit.operators.profile import infer_num_or_cat
    o = table(spark, sf, "orders").withColumn("price_text", F.col("o_totalprice").cast("string"))
    return infer_num_or_cat(o, ["o_orderkey", "o_orderstatus", "price_text", "o_orderpriority"])


@register("distinct_sample", """
SELECT CAST(user_id AS VARCHAR) AS value, min(event_id) AS first_row FROM events
GROUP BY 1 ORDER BY first_row LIMIT 50
""")
def q_distinct_sample(spark, sf):
    from rowaudit.operators.profile import distinct_sample
    return distinct_sample(events(spark, sf), "user_id", 50)


@register("normalize_nulls", """
SELECT event_id AS row_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value FROM events
""")
def q_normalize_nulls(spark, sf):
    from rowaudit.operators.profile import normalize_nulls
    e = events(spark, sf).withColumn("value", F.when(F.col("event_id") % 17 == 0, F.lit(float("nan")))
                                     .otherwise(F.col("value")))
    return normalize_nulls(e.select("row_id", "value"))


@register("infer_four_types", """
SELECT 'doc_id' AS "column", 'NUMERICAL' AS data_type
UNION ALL SELECT 'text', CASE WHEN avg(length(coalesce(text, 'None'))) > 30 THEN 'TEXT' ELSE 'CATEGORICAL' END FROM documents
UNION ALL SELECT 'lang', CASE WHEN avg(length(coalesce(lang, 'None'))) > 30 THEN 'TEXT' ELSE 'CATEGORICAL' END FROM documents
UNION ALL SELECT 'source', CASE WHEN avg(length(coalesce(source, 'None'))) > 30 THEN 'TEXT' ELSE 'CATEGORICAL' END FROM documents
UNION ALL SELECT 'n_chars', 'NUMERICAL'
UNION ALL SELECT 'ts', 'DATETIME'
""")
def q_infer_four_types(spark, sf):
    from rowaudit.operators.profile import four_types_table
    d = table(spark, sf, "documents")
    t1 = four_types_table(d, ["doc_id", "text", "lang", "source", "n_chars"])
    t2 = four_types_table(table(spark, sf, "events"), ["ts"])
    return t1.unionByName(t2)


@register("column_stats", """
SELECT 'value' AS "column", count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd_pop,
  round(stddev_samp(value), 6) AS sd_samp, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS median
FROM events
UNION ALL
SELECT 'user_id', count(user_id), round(avg(user_id), 6), round(stddev_pop(user_id), 6), round(stddev_samp(user_id), 6),
  CAST(min(user_id) AS DOUBLE), CAST(max(user_id) AS DOUBLE), round(quantile_cont(user_id, 0.5), 6)
FROM events
""")
def q_column_stats(spark, sf):
    from rowaudit.operators.stats import column_stats
    s = column_stats(events(spark, sf), ["value", "user_id"])
    return s.select("column", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd_pop", "sd_samp")],
                    "min", "max", F.round("median", 6).alias("median"))


@register("class_counts", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def q_class_counts(spark, sf):
    from rowaudit.operators.stats import class_counts
    return class_counts(table(spark, sf, "orders"), "o_orderstatus")


@register("quantile_threshold", """
SELECT round(quantile_cont(value, 0.95), 6) AS q95_value,
       (SELECT round(quantile_cont(l_extendedprice, 0.95), 6) FROM lineitem) AS q95_price
FROM events
""")
def q_quantile_threshold(spark, sf):
    from rowaudit.operators.stats import exact_quantile
    a = exact_quantile(table(spark, sf, "events"), "value", 0.95)
    b = exact_quantile(table(spark, sf, "lineitem"), "l_extendedprice", 0.95)
    return spark.range(1).select(F.round(F.lit(a), 6).alias("q95_value"), F.round(F.lit(b), 6).alias("q95_price"))


# ------------------------------------------------------- C: cleaning
@register("coerce_median_impute", f"""
WITH {EVENTS_NULLS_SQL}
SELECT row_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM events_n)), 6) AS value FROM events_n
""")
def q_coerce_median_impute(spark, sf):
    from rowaudit.operators.clean import coerce_median_impute
    d = coerce_median_impute(_events_nulls(spark, sf).select("row_id", "value"), ["value"])
    return d.select("row_id", F.round("value", 6).alias("value"))


@register("median_zero_impute", f"""
WITH {EVENTS_NULLS_SQL}
SELECT row_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM events_n)), 6) AS value,
       CAST(0.0 AS DOUBLE) AS empty
FROM events_n
""")
def q_median_zero_impute(spark, sf):
    from rowaudit.operators.clean import coerce_median_impute
    d = _events_nulls(spark, sf).select("row_id", "value", F.lit(None).cast("double").alias("empty"))
    d = coerce_median_impute(d, ["value", "empty"], zero_if_empty=True)
    return d.select("row_id", F.round("value", 6).alias("value"), "empty")


@register("mode_impute", f"""
WITH {EVENTS_NULLS_SQL}, m AS (
  SELECT event_type FROM events_n WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)
SELECT row_id, coalesce(event_type, (SELECT event_type FROM m)) AS event_type FROM events_n
""")
def q_mode_impute(spark, sf):
    from rowaudit.operators.clean import mode_impute
    return mode_impute(_events_nulls(spark, sf).select("row_id", "event_type"), "event_type")


@register("text_fill_empty", """
SELECT doc_id AS row_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE text END AS text FROM documents
""")
def q_text_fill_empty(spark, sf):
    from rowaudit.operators.clean import text_fill_empty
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"),
                                             F.when(F.col("doc_id") % 17 == 0, F.lit(None)).otherwise(F.col("text")).alias("text"))
    return text_fill_empty(d, "text")


@register("datetime_ffill_bfill", f"""
WITH {EVENTS_NULLS_SQL}
SELECT row_id, coalesce(
  last_value(ts IGNORE NULLS) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(ts IGNORE NULLS) OVER (ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS ts
FROM events_n
""")
def q_datetime_ffill_bfill(spark, sf):
    from rowaudit.operators.clean import ffill_bfill
    return ffill_bfill(_events_nulls(spark, sf).select("row_id", "ts"), "ts")


TEXT_CLEAN_SQL = ("trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({t}, '')), 'http\\S+', '', 'g'), "
                  "'[^a-zA-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))")


@register("clean_text", f"""
SELECT doc_id AS row_id, {TEXT_CLEAN_SQL.format(t='text')} AS text_clean FROM documents
""")
def q_clean_text(spark, sf):
    from rowaudit.functions.text import clean_text
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("row_id"), clean_text(F.col("text")).alias("text_clean"))


@register("text_length", "SELECT doc_id AS row_id, CAST(length(text) AS INTEGER) AS text_length FROM documents")
def q_text_length(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.length("text").alias("text_length"))


@register("word_count", """
SELECT doc_id AS row_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS word_count FROM documents
""")
def q_word_count(spark, sf):
    from rowaudit.functions.text import word_count
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("row_id"), word_count(F.col("text")).alias("word_count"))


def _lexicon_values() -> str:
    from rowaudit.functions.lexicon import DEFAULT_LEXICON
    return ", ".join(f"('{w}', {p!r}, {s!r})" for w, p, s in DEFAULT_LEXICON)


TOKENS_SQL = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def _lexicon_mean_sql(table_sql: str, id_col: str, text_col: str, which: str) -> str:
    """(row_id, score): mean lexicon score of the text's tokens, 0 if none."""
    return f"""lex(word, polarity, subjectivity) AS (VALUES {_lexicon_values()}),
toks AS (SELECT {id_col} AS row_id, unnest({TOKENS_SQL.format(t=text_col)}) AS word FROM {table_sql}),
scored AS (SELECT t.row_id, avg(l.{which}) AS s FROM toks t JOIN lex l ON t.word = l.word GROUP BY t.row_id),
lexmean AS (SELECT d.{id_col} AS row_id, coalesce(s.s, 0.0) AS {which}
            FROM {table_sql} d LEFT JOIN scored s ON d.{id_col} = s.row_id)"""


@register("sentiment_polarity", f"""
WITH {_lexicon_mean_sql('documents', 'doc_id', 'text', 'polarity')}
SELECT row_id, round(polarity, 6) AS sentiment FROM lexmean
""")
def q_sentiment_polarity(spark, sf):
    from rowaudit.operators.clean import text_features
    d = table(spark, sf, "documents").withColumn("row_id", F.col("doc_id"))
    return text_features(d.select("row_id", "text"), "text").select("row_id", F.round("text_sentiment", 6).alias("sentiment"))


@register("minmax_normalize", """
WITH s AS (SELECT min(value) AS lv, max(value) AS hv, min(user_id) AS lu, max(user_id) AS hu FROM events)
SELECT event_id AS row_id, round((value - lv) / (hv - lv), 6) AS value,
       round((user_id - lu) / CAST(hu - lu AS DOUBLE), 6) AS user_id
FROM events, s
""")
def q_minmax_normalize(spark, sf):
    from rowaudit.operators.clean import minmax_normalize
    d = minmax_normalize(events(spark, sf).select("row_id", "value", "user_id"), ["value", "user_id"])
    return d.select("row_id", F.round("value", 6).alias("value"), F.round("user_id", 6).alias("user_id"))


@register("category_codes", f"""
WITH {EVENTS_NULLS_SQL}, c AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT event_type FROM events_n WHERE event_type IS NOT NULL))
SELECT e.row_id, coalesce(c.code, -1) AS event_type FROM events_n e LEFT JOIN c ON e.event_type = c.event_type
""")
def q_category_codes(spark, sf):
    from rowaudit.operators.clean import category_codes
    return category_codes(_events_nulls(spark, sf).select("row_id", "event_type"), "event_type")


@register("one_hot", f"""
WITH {EVENTS_NULLS_SQL}
SELECT row_id,
  CAST(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS INTEGER) AS event_type_click,
  CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS event_type_error,
  CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS INTEGER) AS event_type_purchase,
  CAST(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS INTEGER) AS event_type_signup,
  CAST(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS INTEGER) AS event_type_view
FROM events_n
""")
def q_one_hot(spark, sf):
    from rowaudit.operators.clean import one_hot
    return one_hot(_events_nulls(spark, sf).select("row_id", "event_type"), "event_type")


@register("standard_scale", """
WITH s AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(user_id) AS mu, stddev_pop(user_id) AS su FROM events)
SELECT event_id AS row_id, round((value - mv) / CASE WHEN sv > 0 THEN sv ELSE 1 END, 6) AS value,
       round((user_id - mu) / CASE WHEN su > 0 THEN su ELSE 1 END, 6) AS user_id
FROM events, s
""")
def q_standard_scale(spark, sf):
    from rowaudit.operators.clean import standard_scale
    d = standard_scale(events(spark, sf).select("row_id", "value", "user_id"), ["value", "user_id"])
    return d.select("row_id", F.round("value", 6).alias("value"), F.round("user_id", 6).alias("user_id"))


ORDER_RULES = [
    ru.ColumnRule("o_totalprice", ru.NUMERICAL, min_val=2000.0, max_val=450000.0),
    ru.ColumnRule("o_orderstatus", ru.CATEGORICAL, is_feature=False, valid_categories=["F", "O"]),
    ru.ColumnRule("o_orderpriority", ru.CATEGORICAL, valid_categories=[
        "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]),
    ru.ColumnRule("o_custkey", ru.NUMERICAL, is_feature=False),
]
ORDER_P1_WHERE = """((o_totalprice IS NOT NULL AND NOT isnan(o_totalprice) AND (o_totalprice < 2000.0 OR o_totalprice > 450000.0))
   OR (o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O'))
   OR (o_orderpriority IS NOT NULL AND o_orderpriority NOT IN ('1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW')))"""


def orders(spark, sf):
    return table(spark, sf, "orders").withColumn("row_id", F.col("o_orderkey"))


@register("select_features", "SELECT o_orderkey AS row_id, o_totalprice, o_orderpriority FROM orders")
def q_select_features(spark, sf):
    from rowaudit.operators.clean import select_features
    return select_features(orders(spark, sf), ORDER_RULES)


@register("clean_nonfinite", """
SELECT event_id AS row_id, CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN 0.0 ELSE value END AS value FROM events
""")
def q_clean_nonfinite(spark, sf):
    from rowaudit.operators.clean import clean_nonfinite
    e = events(spark, sf).select("row_id", F.when(F.col("event_id") % 17 == 0, F.lit(float("inf")))
                                 .when(F.col("event_id") % 19 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return clean_nonfinite(e, ["value"])


@register("prepare_table", """
WITH s AS (SELECT min(o_orderkey) AS lk, max(o_orderkey) AS hk, min(o_custkey) AS lc, max(o_custkey) AS hc,
                  min(o_totalprice) AS lp, max(o_totalprice) AS hp FROM orders),
st AS (SELECT o_orderstatus, CAST(row_number() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT o_orderstatus FROM orders)),
pr AS (SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT o.o_orderkey AS row_id,
  round((o.o_orderkey - lk) / CAST(hk - lk AS DOUBLE), 6) AS o_orderkey,
  round((o.o_custkey - lc) / CAST(hc - lc AS DOUBLE), 6) AS o_custkey,
  st.code AS o_orderstatus,
  round((o.o_totalprice - lp) / (hp - lp), 6) AS o_totalprice,
  o.o_orderdate, pr.code AS o_orderpriority
FROM orders o CROSS JOIN s JOIN st ON o.o_orderstatus = st.o_orderstatus JOIN pr ON o.o_orderpriority = pr.o_orderpriority
""")
def q_prepare_table(spark, sf):
    from rowaudit.operators.clean import prepare_table
    p = prepare_table(orders(spark, sf))
    return p.select("row_id", *[F.round(c, 6).alias(c) for c in ("o_orderkey", "o_custkey")], "o_orderstatus",
                    F.round("o_totalprice", 6).alias("o_totalprice"), "o_orderdate", "o_orderpriority")


# ------------------------------------------------------- D: gatekeeper (cont.)
def _orders_type_errors(spark, sf):
    """orders with o_totalprice as text, TYPE_ERROR on the first poison phase."""
    from rowaudit.operators.poison import pick_poison_rows
    d, _ = pick_poison_rows(orders(spark, sf), 0.05, 42)
    return d.withColumn("o_totalprice", F.when(F.col("poison_phase") == 1, F.lit("TYPE_ERROR"))
                        .otherwise(F.col("o_totalprice").cast("string")))


PICK_SQL = """picked AS (
  SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY md5('42:pick:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rk
  FROM orders),
ph AS (SELECT row_id, rk, greatest(1, CAST(floor((SELECT count(*) FROM orders) * 0.05) AS BIGINT) // 3) AS m FROM picked),
phases AS (SELECT row_id, CASE WHEN rk <= 3 * m THEN CAST(ceil(rk / m) AS INTEGER) END AS poison_phase,
                  CASE WHEN rk <= 3 * m THEN (rk - 1) % m END AS poison_pos FROM ph)"""


@register("type_check", f"""
WITH {PICK_SQL}
SELECT row_id, 'Type error o_totalprice' AS reason FROM phases WHERE poison_phase = 1
""")
def q_type_check(spark, sf):
    d = _orders_type_errors(spark, sf)
    f = ru.check_table(d, [ru.ColumnRule("o_totalprice", ru.NUMERICAL)], "p1")
    return f.where(F.col("p1").isNotNull()).select("row_id", F.col("p1.reason").alias("reason"))


def documents(spark, sf):
    return table(spark, sf, "documents").withColumn("row_id", F.col("doc_id"))


@register("length_check", """
SELECT doc_id AS row_id, 'Length violation' AS reason FROM documents
WHERE coalesce(length(text), 0) < 10 OR coalesce(length(text), 0) > 5000
""")
def q_length_check(spark, sf):
    r = ru.TextRules(flag_urls=False, flag_gibberish=False)
    return ru.text_flags(documents(spark, sf), "text", r).select("row_id", "reason")


def pages(spark, sf):
    return table(spark, sf, "pages").withColumn("row_id", F.col("page_id"))


@register("url_check", "SELECT page_id AS row_id, 'Contains URL' AS reason FROM pages WHERE regexp_matches(url, 'https?://')")
def q_url_check(spark, sf):
    r = ru.TextRules(min_length=0, max_length=2 ** 31 - 1, flag_gibberish=False)
    return ru.text_flags(pages(spark, sf), "url", r).select("row_id", "reason")


@register("gibberish_check", f"""
WITH {_lexicon_mean_sql('documents', 'doc_id', 'text', 'subjectivity')}
SELECT l.row_id, round(l.subjectivity, 6) AS subjectivity FROM lexmean l JOIN documents d ON d.doc_id = l.row_id
WHERE len(regexp_extract_all(d.text, '\\S+')) > 3 AND l.subjectivity < 0.01
""")
def q_gibberish_check(spark, sf):
    r = ru.TextRules(min_length=0, max_length=2 ** 31 - 1, flag_urls=False)
    f = ru.text_flags(documents(spark, sf), "text", r)
    return f.select("row_id", F.round("score", 6).alias("subjectivity"))


@register("html_check", """
SELECT page_id AS row_id, 'Contains HTML' AS reason FROM pages WHERE regexp_matches(html, '<[a-zA-Z/!][^>]*>')
""")
def q_html_check(spark, sf):
    r = ru.TextRules(min_length=0, max_length=2 ** 31 - 1, flag_urls=False, flag_gibberish=False, flag_html=True)
    return ru.text_flags(pages(spark, sf), "html", r).select("row_id", "reason")


def _pii_sql(t: str) -> str:
    from rowaudit.functions.text import CARD_PATTERN, EMAIL_PATTERN, IPV4_PATTERN, PHONE_PATTERN
    return (f"CASE WHEN regexp_matches({t}, '{EMAIL_PATTERN}') THEN 'email' "
            f"WHEN regexp_matches({t}, '{CARD_PATTERN}') THEN 'card' "
            f"WHEN regexp_matches({t}, '{IPV4_PATTERN}') THEN 'ipv4' "
            f"WHEN regexp_matches({t}, '{PHONE_PATTERN}') THEN 'phone' END")


@register("pii_check", f"""
SELECT doc_id AS row_id, 'Personal data ' || kind AS reason
FROM (SELECT doc_id, {_pii_sql('text')} AS kind FROM documents) WHERE kind IS NOT NULL
""")
def q_pii_check(spark, sf):
    r = ru.TextRules(min_length=0, max_length=2 ** 31 - 1, flag_urls=False, flag_gibberish=False, flag_pii=True)
    return ru.text_flags(documents(spark, sf), "text", r).select("row_id", "reason")


@register("language_check", """
SELECT doc_id AS row_id, 'Language mismatch' AS reason FROM documents WHERE lang IS NULL OR lang <> 'en'
""")
def q_language_check(spark, sf):
    r = ru.TextRules(min_length=0, max_length=2 ** 31 - 1, flag_urls=False, flag_gibberish=False, language="en")
    return ru.text_flags(documents(spark, sf), "text", r).select("row_id", "reason")


def _hits_sql(lang: str, words: list[str]) -> str:
    return f"len(list_filter(t, lambda w: w IN ({_sql_list(words)})))"


def _language_sql() -> str:
    langs = sorted(FUNCTION_WORDS)
    hits = ", ".join(f"{_hits_sql(k, FUNCTION_WORDS[k])} AS {k}" for k in langs)
    pick = " ".join(f"WHEN {k} > 0 AND {k} = greatest({', '.join(langs)}) THEN '{k}'" for k in langs)
    return rf"""
WITH d AS (SELECT doc_id AS row_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}') AS t FROM documents),
h AS (SELECT row_id, {hits} FROM d),
g AS (SELECT row_id, CASE {pick} END AS lang FROM h)
SELECT row_id, lang, lang IS NULL OR lang <> 'en' AS mismatch FROM g"""


@register("language_by_function_words", _language_sql())
def q_language_by_function_words(spark, sf):
    """The language check on documents that come without a language column."""
    d = documents(spark, sf).select("row_id", F.coalesce("text", F.lit("")).alias("text"))
    r = ru.TextRules(min_length=0, max_length=2 ** 31 - 1, flag_urls=False, flag_gibberish=False, language="en")
    return ru.check_text(d, "text", r, name="p1").select("row_id", likely_language("text").alias("lang"), F.col("p1").isNotNull().alias("mismatch"))


PERPLEXITY_LIMIT = 30.0


@register("perplexity_check", """
WITH g AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substring(lower(text), i, 3))) AS tri FROM documents),
c AS (SELECT tri, count(*) AS n FROM g GROUP BY tri),
ctx AS (SELECT substring(tri, 1, 2) AS cx, sum(n) AS cn FROM c GROUP BY 1),
v AS (SELECT count(DISTINCT substring(tri, 3, 1)) AS v FROM c),
m AS (SELECT c.tri, ln((c.n + 1.0) / (ctx.cn + v.v)) AS lp FROM c JOIN ctx ON substring(c.tri, 1, 2) = ctx.cx CROSS JOIN v),
p AS (SELECT g.doc_id, exp(-avg(m.lp)) AS perplexity FROM g JOIN m ON g.tri = m.tri GROUP BY g.doc_id)
SELECT d.doc_id AS row_id, round(p.perplexity, 6) AS perplexity, p.perplexity > 30.0 AS flagged
FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id
""")
def q_perplexity_check(spark, sf):
    from rowaudit.operators.text import perplexity_outliers
    d = perplexity_outliers(documents(spark, sf), "text", PERPLEXITY_LIMIT)
    return d.select("row_id", F.round("perplexity", 6).alias("perplexity"), F.col("p1ppl").isNotNull().alias("flagged"))


# ------------------------------------------------------- events sanitize (rules + z-score)
EVENT_FLAGS_SQL = """p1 AS (
  SELECT event_id AS row_id,
    CASE WHEN value IS NOT NULL AND NOT isnan(value) AND (value < 0.05 OR value > 400.0) THEN 0
         WHEN event_type IS NOT NULL AND event_type NOT IN ('click','view','purchase','signup') THEN 1
         WHEN user_id IS NOT NULL AND (user_id < 0 OR user_id > 140) THEN 2 END AS seq
  FROM events),
clean AS (SELECT e.* FROM events e JOIN p1 ON e.event_id = p1.row_id WHERE p1.seq IS NULL),
st AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(user_id) AS mu, stddev_pop(user_id) AS su FROM clean),
p2 AS (SELECT event_id AS row_id,
    CASE WHEN abs((value - mv) / CASE WHEN sv > 0 THEN sv ELSE 1 END) > 4 THEN 0
         WHEN abs((user_id - mu) / CASE WHEN su > 0 THEN su ELSE 1 END) > 4 THEN 1 END AS seq
  FROM clean, st),
reasons(phase, seq, col, reason) AS (VALUES (1, 0, 'value', 'Range violation value'),
  (1, 1, 'event_type', 'Invalid category event_type'), (1, 2, 'user_id', 'Range violation user_id'),
  (2, 0, 'value', 'Z-score outlier value'), (2, 1, 'user_id', 'Z-score outlier user_id')),
flags AS (
  SELECT f.row_id, CAST(r.phase AS INTEGER) AS phase, CAST(f.seq AS INTEGER) AS seq, r.col AS "column", r.reason
  FROM (SELECT row_id, 1 AS phase, seq FROM p1 WHERE seq IS NOT NULL
        UNION ALL SELECT row_id, 2, seq FROM p2 WHERE seq IS NOT NULL) f
  JOIN reasons r ON f.phase = r.phase AND f.seq = r.seq)"""


def event_flags(spark, sf):
    from rowaudit.plans.jobs import sanitize_table
    return sanitize_table(events(spark, sf), EVENT_RULES, "none", "event_type", use_forest=False)


FLAG_COLS = ["row_id", "phase", "seq", "column", "reason"]


@register("zscore_outliers", f"WITH {EVENT_FLAGS_SQL} SELECT row_id, seq, \"column\", reason FROM flags WHERE phase = 2")
def q_zscore_outliers(spark, sf):
    return event_flags(spark, sf).where(F.col("phase") == 2).select("row_id", "seq", "column", "reason")


@register("clean_rows_anti", f"WITH {EVENT_FLAGS_SQL} SELECT event_id AS row_id FROM events WHERE event_id NOT IN (SELECT row_id FROM flags WHERE phase = 1)")
def q_clean_rows_anti(spark, sf):
    p1 = fl.flags_from(event_p1(spark, sf), "p1", 1)
    return fl.drop_flagged(events(spark, sf), p1).select("row_id")


@register("first_flag_wins", """
WITH s AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv FROM events),
u AS (
  SELECT event_id AS row_id, 1 AS phase, 0 AS seq, 'value' AS col, 'Range violation value' AS reason FROM events
    WHERE value IS NOT NULL AND NOT isnan(value) AND (value < 0.05 OR value > 400.0)
  UNION ALL SELECT event_id, 1, 1, 'event_type', 'Invalid category event_type' FROM events
    WHERE event_type IS NOT NULL AND event_type NOT IN ('click','view','purchase','signup')
  UNION ALL SELECT event_id, 2, 0, 'value', 'Z-score outlier value' FROM events, s WHERE abs((value - mv) / sv) > 4)
SELECT row_id, CAST(phase AS INTEGER) AS phase, CAST(seq AS INTEGER) AS seq, col AS "column", reason
FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY phase, seq) AS r FROM u) WHERE r = 1
""")
def q_first_flag_wins(spark, sf):
    e = events(spark, sf)
    rng = ru.table_flags(e, [EVENT_RULES[0]])
    cat = ru.table_flags(e, [ru.ColumnRule("value", ru.NUMERICAL), EVENT_RULES[1]])
    z = fl.flags_from(ol.zscore(e, ["value"], 4.0, "p2"), "p2", 2)
    return fl.merge_flags(rng, cat, z).select(*FLAG_COLS)


@register("phase_counts", f"WITH {EVENT_FLAGS_SQL} SELECT CAST(phase AS INTEGER) AS phase, CAST(count(*) AS BIGINT) AS n_flagged FROM flags GROUP BY phase")
def q_phase_counts(spark, sf):
    return fl.phase_counts(event_flags(spark, sf))


@register("basic_metrics", f"""WITH {EVENT_FLAGS_SQL}
SELECT (SELECT CAST(count(*) AS BIGINT) FROM events) AS total_rows, (SELECT CAST(count(DISTINCT row_id) AS BIGINT) FROM flags) AS flagged_rows""")
def q_basic_metrics(spark, sf):
    return fl.basic_metrics(events(spark, sf), event_flags(spark, sf))


@register("findings_report", f"""WITH {EVENT_FLAGS_SQL}
SELECT phase, reason, CAST(count(*) AS BIGINT) AS n_flagged,
       round(count(*) * 100.0 / (SELECT count(*) FROM events), 6) AS pct_of_rows
FROM flags GROUP BY phase, reason""")
def q_findings_report(spark, sf):
    return fl.findings_report(event_flags(spark, sf), events(spark, sf))


@register("flagged_page", f"""WITH {EVENT_FLAGS_SQL}
SELECT e.event_id AS row_id, e.event_type, e.value, f.reason FROM events e JOIN flags f ON e.event_id = f.row_id
ORDER BY row_id LIMIT 10 OFFSET 20""")
def q_flagged_page(spark, sf):
    e = events(spark, sf).select("row_id", "event_type", "value")
    return fl.flagged_page(e, event_flags(spark, sf), page=3, page_size=10)


@register("review_batch", f"""WITH {EVENT_FLAGS_SQL}
SELECT e.event_id AS row_id, e.event_type, e.value, f.reason
FROM (SELECT * FROM events ORDER BY event_id LIMIT 200) e LEFT JOIN flags f ON e.event_id = f.row_id""")
def q_review_batch(spark, sf):
    e = events(spark, sf).select("row_id", "event_type", "value")
    return fl.review_batch(e, event_flags(spark, sf), 200)


def _verdicts(spark, sf):
    """Reviewer verdicts for the first 200 rows (derived: row_id % 3)."""
    head = events(spark, sf).orderBy("row_id").limit(200).select("row_id")
    v = F.when(F.col("row_id") % 3 == 0, "keep").when(F.col("row_id") % 3 == 1, "remove").otherwise("flag")
    return head.select("row_id", v.alias("verdict"), F.lit("reviewed").alias("reason"))


@register("adjudicate_flags", f"""WITH {EVENT_FLAGS_SQL},
v AS (SELECT event_id AS row_id, CASE event_id % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'remove' ELSE 'flag' END AS verdict
      FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 200)),
j AS (SELECT coalesce(f.row_id, v.row_id) AS row_id, f.phase, f.seq, f."column", f.reason, v.verdict
      FROM flags f FULL OUTER JOIN v ON f.row_id = v.row_id)
SELECT row_id,
  CAST(CASE WHEN verdict = 'flag' THEN 4 ELSE phase END AS INTEGER) AS phase,
  CAST(CASE WHEN verdict = 'flag' THEN 0 ELSE seq END AS INTEGER) AS seq,
  CASE WHEN verdict = 'flag' THEN NULL ELSE "column" END AS "column",
  CASE WHEN verdict = 'flag' THEN 'Judge: reviewed' ELSE reason END AS reason
FROM j WHERE coalesce(verdict, '') <> 'remove' AND (reason IS NOT NULL OR verdict = 'flag')""")
def q_adjudicate_flags(spark, sf):
    return fl.adjudicate(event_flags(spark, sf), _verdicts(spark, sf)).select(*FLAG_COLS)


@register("apply_decisions", f"""WITH {EVENT_FLAGS_SQL}
SELECT event_id AS row_id FROM events
WHERE event_id NOT IN (SELECT row_id FROM flags WHERE row_id % 3 <> 0)""")
def q_apply_decisions(spark, sf):
    f = event_flags(spark, sf)
    dec = f.select("row_id", F.when(F.col("row_id") % 3 == 0, "keep").otherwise("remove").alias("decision"))
    return fl.apply_decisions(events(spark, sf), f, dec).select("row_id")


@register("export_clean_rows", f"""WITH {EVENT_FLAGS_SQL}
SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE event_id NOT IN (SELECT row_id FROM flags)""")
def q_export_clean_rows(spark, sf):
    return fl.drop_flagged(events(spark, sf), event_flags(spark, sf)).drop("row_id")


@register("iqr_outliers", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id AS row_id, value FROM events, q
WHERE value IS NOT NULL AND NOT isnan(value) AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))""")
def q_iqr_outliers(spark, sf):
    d = ol.iqr_outliers(events(spark, sf), ["value"], 1.5, "p2")
    return d.where(F.col("p2").isNotNull()).select("row_id", "value")


@register("rare_categories", """
WITH c AS (SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1),
t AS (SELECT count(*) AS total FROM events WHERE user_id IS NOT NULL)
SELECT e.event_id AS row_id, e.user_id, round(c.n / CAST(t.total AS DOUBLE), 6) AS share
FROM events e JOIN c ON e.user_id = c.user_id, t WHERE c.n < 0.006 * t.total""")
def q_rare_categories(spark, sf):
    d = ol.rare_categories(events(spark, sf), "user_id", 0.006, "p2")
    return d.where(F.col("p2").isNotNull()).select("row_id", "user_id", F.round("p2.score", 6).alias("share"))


# ------------------------------------------------------- windows, sort, sampling
@register("stratified_folds", """
SELECT o_orderkey AS row_id, CAST((row_number() OVER (PARTITION BY o_orderstatus
  ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders""")
def q_stratified_folds(spark, sf):
    from rowaudit.operators.rows import stratified_folds
    return stratified_folds(orders(spark, sf), "o_orderstatus", 5, seed=42).select("row_id", "fold")


LABELLED_DOCS_SQL = "ld AS (SELECT d.doc_id, d.text, d.source, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def labelled_docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").withColumn("row_id", F.col("doc_id"))


@register("stratified_folds_unshuffled", f"""
WITH {LABELLED_DOCS_SQL},
r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS rk FROM ld),
sz AS (SELECT quality, count(*) AS n FROM ld GROUP BY quality),
st AS (SELECT quality, n, coalesce(sum(n) OVER (ORDER BY quality ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM sz),
b AS (SELECT quality, i AS fold, floor((s + n - 1 - i) / 5.0) - floor((s - 1 - i) / 5.0) AS alloc FROM st, range(0, 5) t(i)),
c AS (SELECT quality, fold, sum(alloc) OVER (PARTITION BY quality ORDER BY fold) AS hi, alloc FROM b)
SELECT r.doc_id AS row_id, CAST(c.fold AS INTEGER) AS fold FROM r JOIN c ON r.quality = c.quality AND r.rk > c.hi - c.alloc AND r.rk <= c.hi""")
def q_stratified_folds_unshuffled(spark, sf):
    from rowaudit.operators.rows import stratified_folds
    return stratified_folds(labelled_docs(spark, sf), "quality", 5, shuffle=False).select("row_id", "fold")


@register("bounded_sample", """
SELECT o_orderkey AS row_id FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 2000""")
def q_bounded_sample(spark, sf):
    from rowaudit.operators.rows import bounded_sample
    return bounded_sample(orders(spark, sf), 2000, 42).select("row_id")


@register("shuffle_with_mapping", """
SELECT o_orderkey AS orig_id, row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS new_id FROM orders""")
def q_shuffle_with_mapping(spark, sf):
    from rowaudit.operators.rows import shuffle_with_mapping
    return shuffle_with_mapping(orders(spark, sf), 42).select("orig_id", "new_id")


# ------------------------------------------------------- J: poison injection
def _pick_sql(tbl: str, key: str, p: float = 0.05) -> str:
    return f"""picked AS (
  SELECT {key} AS row_id, row_number() OVER (ORDER BY md5('42:pick:' || CAST({key} AS VARCHAR)), {key}) AS rk FROM {tbl}),
ph AS (SELECT row_id, rk, greatest(1, CAST(floor((SELECT count(*) FROM {tbl}) * {p}) AS BIGINT) // 3) AS m FROM picked),
phases AS (SELECT row_id, CASE WHEN rk <= 3 * m THEN CAST(ceil(rk / m) AS INTEGER) END AS poison_phase,
                  CASE WHEN rk <= 3 * m THEN (rk - 1) % m END AS poison_pos FROM ph)"""


def _flip_sql(label: str, labs: str) -> str:
    others = f"list_filter({labs}, lambda x: x != {label})"
    return (f"{others}[1 + CAST(('0x' || substr(md5('42:flip:' || CAST(row_id AS VARCHAR)), 1, 8))::BIGINT "
            f"% len({others}) AS INTEGER)]")


def _shuffle_sql(src: str) -> str:
    return (f"SELECT *, row_id AS orig_id, row_number() OVER (ORDER BY md5('42:shuffle:' || CAST(row_id AS VARCHAR)), row_id) - 1 AS new_id "
            f"FROM {src}")


@register("pick_poison_rows", f"WITH {_pick_sql('orders', 'o_orderkey')} SELECT row_id, poison_phase, poison_pos FROM phases WHERE poison_phase IS NOT NULL")
def q_pick_poison_rows(spark, sf):
    from rowaudit.operators.poison import pick_poison_rows
    d, _ = pick_poison_rows(orders(spark, sf), 0.05, 42)
    return d.where(F.col("poison_phase").isNotNull()).select("row_id", "poison_phase", "poison_pos")


# regression injection over `part`: target p_retailprice, feature p_size
PART_POISON_SQL = f"""{_pick_sql('part', 'p_partkey')},
base AS (SELECT p.p_partkey AS row_id, p.p_size, p.p_retailprice, ph.poison_phase FROM part p JOIN phases ph ON p.p_partkey = ph.row_id),
sd AS (SELECT stddev_samp(p_size) AS sd FROM base WHERE poison_phase IS DISTINCT FROM 1),
s2 AS (SELECT row_id, poison_phase,
         CASE WHEN poison_phase = 1 THEN -99999.0 ELSE CAST(p_retailprice AS DOUBLE) END AS p_retailprice,
         CASE WHEN poison_phase = 1 THEN NULL WHEN poison_phase = 2 THEN p_size + 20 * sd ELSE CAST(p_size AS DOUBLE) END AS size_num
       FROM base, sd),
mn AS (SELECT min(size_num) AS mn FROM s2),
poisoned AS (SELECT row_id, poison_phase, p_retailprice, coalesce(poison_phase = 1, false) AS is_type_error,
         CASE WHEN poison_phase = 3 THEN mn ELSE size_num END AS p_size FROM s2, mn)"""


def _part_poisoned(spark, sf, shuffle: bool):
    from rowaudit.functions.numeric import strict_double
    from rowaudit.operators.poison import poison_regression
    p = table(spark, sf, "part").withColumn("row_id", F.col("p_partkey"))
    d = poison_regression(p, "p_retailprice", ["p_size"], 0.05, 42, shuffle=shuffle)
    return d.withColumn("is_type_error", F.col("p_size") == "TYPE_ERROR") \
        .withColumn("p_size", F.round(strict_double(F.col("p_size")), 6)) \
        .withColumn("p_retailprice", F.round("p_retailprice", 6))


@register("inject_type_error", f"WITH {PART_POISON_SQL} SELECT row_id, is_type_error, p_size, round(p_retailprice, 6) AS p_retailprice FROM poisoned WHERE poison_phase = 1")
def q_inject_type_error(spark, sf):
    return _part_poisoned(spark, sf, False).where(F.col("poison_phase") == 1).select("row_id", "is_type_error", "p_size", "p_retailprice")


@register("inject_outlier", f"WITH {PART_POISON_SQL} SELECT row_id, round(p_size, 6) AS p_size FROM poisoned WHERE poison_phase = 2")
def q_inject_outlier(spark, sf):
    return _part_poisoned(spark, sf, False).where(F.col("poison_phase") == 2).select("row_id", "p_size")


@register("inject_min_mismatch", f"WITH {PART_POISON_SQL} SELECT row_id, round(p_size, 6) AS p_size, round(p_retailprice, 6) AS p_retailprice FROM poisoned WHERE poison_phase = 3")
def q_inject_min_mismatch(spark, sf):
    return _part_poisoned(spark, sf, False).where(F.col("poison_phase") == 3).select("row_id", "p_size", "p_retailprice")


@register("poison_regression_table", f"""WITH {PART_POISON_SQL}, sh AS ({_shuffle_sql('poisoned')})
SELECT new_id AS row_id, orig_id, is_type_error, round(p_size, 6) AS p_size, round(p_retailprice, 6) AS p_retailprice,
       CAST(poison_phase IS NOT NULL AS INTEGER) AS is_actual_poisoned FROM sh""")
def q_poison_regression_table(spark, sf):
    d = _part_poisoned(spark, sf, True)
    return d.select("row_id", "orig_id", "is_type_error", "p_size", "p_retailprice", "is_actual_poisoned")


# classification injection over `orders`: target o_orderstatus, feature o_totalprice
ORDERS_POISON_SQL = f"""{_pick_sql('orders', 'o_orderkey')},
base AS (SELECT o.o_orderkey AS row_id, o.o_totalprice, o.o_orderstatus, ph.poison_phase FROM orders o JOIN phases ph ON o.o_orderkey = ph.row_id),
sd AS (SELECT stddev_samp(o_totalprice) AS sd FROM base WHERE poison_phase IS DISTINCT FROM 1),
labs AS (SELECT list_sort(list(DISTINCT o_orderstatus)) AS labs FROM orders),
poisoned AS (SELECT row_id, poison_phase, coalesce(poison_phase = 1, false) AS is_type_error,
    CASE WHEN poison_phase = 1 THEN NULL WHEN poison_phase = 2 THEN o_totalprice + 10 * sd ELSE o_totalprice END AS o_totalprice,
    CASE WHEN poison_phase = 3 THEN {_flip_sql('o_orderstatus', 'labs')} ELSE o_orderstatus END AS o_orderstatus,
    o_orderstatus AS original_status
  FROM base, sd, labs)"""


def _orders_poisoned(spark, sf, shuffle: bool):
    from rowaudit.functions.numeric import strict_double
    from rowaudit.operators.poison import poison_classification
    d = poison_classification(orders(spark, sf).withColumn("original_status", F.col("o_orderstatus")),
                              "o_orderstatus", ["o_totalprice"], 0.05, 42, shuffle=shuffle)
    return d.withColumn("is_type_error", F.col("o_totalprice") == "TYPE_ERROR") \
        .withColumn("o_totalprice_num", strict_double(F.col("o_totalprice")))


@register("inject_label_flip", f"WITH {ORDERS_POISON_SQL} SELECT row_id, original_status, o_orderstatus FROM poisoned WHERE poison_phase = 3")
def q_inject_label_flip(spark, sf):
    return _orders_poisoned(spark, sf, False).where(F.col("poison_phase") == 3).select("row_id", "original_status", "o_orderstatus")


@register("poison_classification_table", f"""WITH {ORDERS_POISON_SQL}, sh AS ({_shuffle_sql('poisoned')})
SELECT new_id AS row_id, orig_id, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, is_type_error,
       CAST(poison_phase IS NOT NULL AS INTEGER) AS is_actual_poisoned FROM sh""")
def q_poison_classification_table(spark, sf):
    d = _orders_poisoned(spark, sf, True)
    return d.select("row_id", "orig_id", "o_orderstatus", F.round("o_totalprice_num", 6).alias("o_totalprice"),
                    "is_type_error", "is_actual_poisoned")


@register("truth_semi", f"""WITH {_pick_sql('orders', 'o_orderkey')}
SELECT row_id, CAST(poison_phase IS NOT NULL AS INTEGER) AS is_actual_poisoned FROM phases""")
def q_truth_semi(spark, sf):
    from rowaudit.operators.poison import pick_poison_rows
    d, _ = pick_poison_rows(orders(spark, sf), 0.05, 42)
    truth = d.where(F.col("poison_phase").isNotNull()).select("row_id")
    return fl.mark_truth(orders(spark, sf).select("row_id"), truth)


@register("row_status", f"""WITH {_pick_sql('orders', 'o_orderkey')},
f AS (SELECT o_orderkey AS row_id,
  CASE WHEN o_totalprice IS NOT NULL AND NOT isnan(o_totalprice) AND (o_totalprice < 2000.0 OR o_totalprice > 450000.0) THEN 'Range violation o_totalprice'
       WHEN o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O') THEN 'Invalid category o_orderstatus'
       WHEN o_orderpriority IS NOT NULL AND o_orderpriority NOT IN ('1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW') THEN 'Invalid category o_orderpriority' END AS reason
  FROM orders)
SELECT f.row_id, f.reason IS NOT NULL AS is_flagged, coalesce(f.reason, '---') AS reason,
  p.poison_phase IS NOT NULL AS is_actual_poisoned,
  CASE WHEN f.reason IS NOT NULL AND p.poison_phase IS NOT NULL THEN 'tp' WHEN f.reason IS NOT NULL THEN 'fp'
       WHEN p.poison_phase IS NOT NULL THEN 'fn' ELSE 'clean' END AS status
FROM f JOIN phases p ON f.row_id = p.row_id""")
def q_row_status(spark, sf):
    from rowaudit.operators.poison import pick_poison_rows
    o = orders(spark, sf)
    d, _ = pick_poison_rows(o, 0.05, 42)
    truth = d.where(F.col("poison_phase").isNotNull()).select("row_id")
    flags = ru.table_flags(o, ORDER_RULES)
    return fl.row_status(o.select("row_id"), flags, truth)


DETECT_RULES = [ru.ColumnRule("o_totalprice", ru.NUMERICAL, min_val=0.0, max_val=600000.0),
                ru.ColumnRule("o_orderstatus", ru.CATEGORICAL, valid_categories=["F", "O", "P"])]
DETECTED_SQL = f"""{ORDERS_POISON_SQL}, sh AS ({_shuffle_sql('poisoned')}),
pred AS (SELECT new_id AS row_id, CAST(poison_phase IS NOT NULL AS INTEGER) AS is_actual_poisoned,
   CAST(is_type_error OR o_totalprice < 0.0 OR o_totalprice > 600000.0 OR o_orderstatus NOT IN ('F','O','P') AS INTEGER) AS is_predicted_poisoned
 FROM sh)"""


def _orders_detected(spark, sf):
    d = _orders_poisoned(spark, sf, True)
    checked = ru.check_table(d, DETECT_RULES, "p1")
    return checked.select("row_id", "is_actual_poisoned",
                          F.col("p1").isNotNull().cast("int").alias("is_predicted_poisoned"))


@register("detection_metrics", f"""WITH {DETECTED_SQL},
c AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(is_actual_poisoned) AS BIGINT) AS poisoned_true,
  CAST(sum(is_predicted_poisoned) AS BIGINT) AS poisoned_pred,
  CAST(count(*) FILTER (WHERE is_actual_poisoned = 1 AND is_predicted_poisoned = 1) AS BIGINT) AS tp,
  CAST(count(*) FILTER (WHERE is_actual_poisoned = 0 AND is_predicted_poisoned = 0) AS BIGINT) AS tn,
  CAST(count(*) FILTER (WHERE is_actual_poisoned = 0 AND is_predicted_poisoned = 1) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE is_actual_poisoned = 1 AND is_predicted_poisoned = 0) AS BIGINT) AS fn FROM pred),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS rc FROM c)
SELECT total, poisoned_true, poisoned_pred, round(coalesce((tp + tn) / nullif(total, 0), 0.0), 4) AS accuracy,
  round(p, 4) AS precision, round(rc, 4) AS recall, round(coalesce(2 * p * rc / nullif(p + rc, 0.0), 0.0), 4) AS f1,
  tp, tn, fp, fn FROM r""")
def q_detection_metrics(spark, sf):
    return fl.detection_metrics(_orders_detected(spark, sf))


@register("actual_top50", f"WITH {DETECTED_SQL} SELECT row_id FROM pred WHERE is_actual_poisoned = 1 ORDER BY row_id LIMIT 50")
def q_actual_top50(spark, sf):
    return fl.first_rows(_orders_detected(spark, sf), F.col("is_actual_poisoned") == 1, 50).select("row_id")


@register("predicted_top50", f"WITH {DETECTED_SQL} SELECT row_id FROM pred WHERE is_predicted_poisoned = 1 ORDER BY row_id LIMIT 50")
def q_predicted_top50(spark, sf):
    return fl.first_rows(_orders_detected(spark, sf), F.col("is_predicted_poisoned") == 1, 50).select("row_id")


@register("true_positive_top50", f"WITH {DETECTED_SQL} SELECT row_id FROM pred WHERE is_actual_poisoned = 1 AND is_predicted_poisoned = 1 ORDER BY row_id LIMIT 50")
def q_true_positive_top50(spark, sf):
    d = _orders_detected(spark, sf)
    return fl.first_rows(d, (F.col("is_actual_poisoned") == 1) & (F.col("is_predicted_poisoned") == 1), 50).select("row_id")


# text injection over labelled documents: text, target quality
TEXT_POISON_SQL = f"""{LABELLED_DOCS_SQL}, {_pick_sql('ld', 'doc_id')},
labs AS (SELECT list_sort(list(DISTINCT quality)) AS labs FROM ld),
poisoned AS (SELECT ld.doc_id AS row_id, ph.poison_phase,
    CASE WHEN ph.poison_phase = 1 AND ph.poison_pos % 2 = 0 THEN 'short'
         WHEN ph.poison_phase = 1 THEN 'Check http://malicious-link.xyz'
         WHEN ph.poison_phase = 2 THEN coalesce(ld.text, 'None') || ' buy crypto now free profit!!!' ELSE ld.text END AS text,
    CASE WHEN ph.poison_phase = 3 THEN {_flip_sql('ld.quality', 'labs')} ELSE ld.quality END AS quality
  FROM ld JOIN phases ph ON ld.doc_id = ph.row_id, labs)"""


def _docs_poisoned(spark, sf, shuffle: bool):
    from rowaudit.operators.poison import poison_text
    return poison_text(labelled_docs(spark, sf), "text", "quality", 0.05, 42, shuffle=shuffle)


@register("inject_malformed_text", f"WITH {TEXT_POISON_SQL} SELECT row_id, text FROM poisoned WHERE poison_phase = 1")
def q_inject_malformed_text(spark, sf):
    return _docs_poisoned(spark, sf, False).where(F.col("poison_phase") == 1).select("row_id", "text")


@register("inject_semantic_noise", f"WITH {TEXT_POISON_SQL} SELECT row_id, text FROM poisoned WHERE poison_phase = 2")
def q_inject_semantic_noise(spark, sf):
    return _docs_poisoned(spark, sf, False).where(F.col("poison_phase") == 2).select("row_id", "text")


@register("poison_text_table", f"""WITH {TEXT_POISON_SQL}, sh AS ({_shuffle_sql('poisoned')})
SELECT new_id AS row_id, orig_id, text, quality, CAST(poison_phase IS NOT NULL AS INTEGER) AS is_actual_poisoned FROM sh""")
def q_poison_text_table(spark, sf):
    return _docs_poisoned(spark, sf, True).select("row_id", "orig_id", "text", "quality", "is_actual_poisoned")


def _uniform_sql(tag: str, key: str = "event_id") -> str:
    return (f"((('0x' || substr(md5('42:{tag}:' || CAST({key} AS VARCHAR)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)")


def _normal_sql(name: str) -> str:
    return f"sqrt(-2.0 * ln({_uniform_sql(name + ':a')})) * cos(2.0 * pi() * {_uniform_sql(name + ':b')})"


GAUSS_SQL = f"""g AS (SELECT event_id AS row_id, {_normal_sql('feature1')} AS feature1, {_normal_sql('feature2')} AS feature2,
  {_normal_sql('feature3')} AS feature3, {_normal_sql('noise')} AS noise FROM events)"""


def gaussian_table(spark, sf):
    from rowaudit.operators.poison import gaussian_features, linear_target
    g = gaussian_features(events(spark, sf).select("row_id"))
    return linear_target(g, ["feature1", "feature2", "feature3"], [30.0, 20.0, 10.0], noise=10.0)


@register("synth_gaussian_table", f"""WITH {GAUSS_SQL}
SELECT row_id, round(feature1, 6) AS feature1, round(feature2, 6) AS feature2, round(feature3, 6) AS feature3,
  round(30.0 * feature1 + 20.0 * feature2 + 10.0 * feature3 + 10.0 * noise, 6) AS target FROM g""")
def q_synth_gaussian_table(spark, sf):
    g = gaussian_table(spark, sf)
    return g.select("row_id", *[F.round(c, 6).alias(c) for c in ("feature1", "feature2", "feature3", "target")])


@register("inject_shift", """WITH r AS (
  SELECT event_id AS row_id, value, row_number() OVER (ORDER BY md5('42:shift:' || CAST(event_id AS VARCHAR)), event_id) AS rk FROM events),
k AS (SELECT CAST(floor(0.05 * count(*)) AS BIGINT) AS k FROM events)
SELECT row_id, round(CASE WHEN rk <= k THEN value + 10.0 ELSE value END, 6) AS value,
  CAST(rk <= k AS INTEGER) AS is_actual_poisoned FROM r, k""")
def q_inject_shift(spark, sf):
    from rowaudit.operators.poison import inject_shift
    d = inject_shift(events(spark, sf).select("row_id", "value"), "value", 0.05, 10.0, 42)
    return d.select("row_id", F.round("value", 6).alias("value"), "is_actual_poisoned")


# ------------------------------------------------------- I: detectors with SQL forms
def _lof_sql(within_label: bool) -> str:
    cond = "a.label = b.label AND a.vec_id <> b.vec_id" if within_label else "a.vec_id <> b.vec_id"
    return f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT a.vec_id AS row_id, b.vec_id AS nbr_id, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON {cond}),
knn AS (SELECT row_id, nbr_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, nbr_id) AS r FROM pairs) WHERE r <= 20),
kd AS (SELECT row_id, max(dist) AS kdist FROM knn GROUP BY row_id),
reach AS (SELECT k.row_id, greatest(kd.kdist, k.dist) AS rd FROM knn k JOIN kd ON k.nbr_id = kd.row_id),
lrd AS (SELECT row_id, 1.0 / (avg(rd) + 1e-10) AS lrd FROM reach GROUP BY row_id),
nl AS (SELECT k.row_id, avg(l.lrd) AS m FROM knn k JOIN lrd l ON k.nbr_id = l.row_id GROUP BY k.row_id)
SELECT nl.row_id, round(kd.kdist, 6) AS k_distance, round(nl.m / lrd.lrd, 6) AS lof
FROM nl JOIN lrd ON nl.row_id = lrd.row_id JOIN kd ON nl.row_id = kd.row_id"""


def embeddings(spark, sf):
    return table(spark, sf, "embeddings").withColumn("row_id", F.col("vec_id"))


@register("lof_scores", _lof_sql(False))
def q_lof_scores(spark, sf):
    from rowaudit.operators.lof import lof_scores
    s = lof_scores(embeddings(spark, sf), "embedding", k=20)
    return s.select("row_id", F.round("k_distance", 6).alias("k_distance"), F.round("lof", 6).alias("lof"))


@register("class_outliers", _lof_sql(True))
def q_class_outliers(spark, sf):
    from rowaudit.operators.lof import lof_scores
    s = lof_scores(embeddings(spark, sf), "embedding", k=20, by="label")
    return s.select("row_id", F.round("k_distance", 6).alias("k_distance"), F.round("lof", 6).alias("lof"))


GIVEN_SCORES_SQL = """st AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(user_id) AS mu FROM events),
sc AS (SELECT event_id AS row_id, abs(value - mv) / sv AS iso, abs(user_id - mu) AS lof, -value AS svm FROM events, st),
mm AS (SELECT min(iso) AS li, max(iso) AS hi, min(lof) AS ll, max(lof) AS hl, min(svm) AS ls, max(svm) AS hs FROM sc),
ens AS (SELECT row_id, ((iso - li) / (hi - li + 1e-8) + (lof - ll) / (hl - ll + 1e-8) + (svm - ls) / (hs - ls + 1e-8)) / 3.0 AS poison_score
        FROM sc, mm)"""


def _given_scores(spark, sf):
    """Three deterministic per-row scores standing in for detector outputs."""
    e = events(spark, sf)
    st = e.agg(F.avg("value").alias("mv"), F.stddev_pop("value").alias("sv"), F.avg("user_id").alias("mu")).first()
    return e.select("row_id", (F.abs(F.col("value") - st["mv"]) / st["sv"]).alias("iso"),
                    F.abs(F.col("user_id") - st["mu"]).alias("lof"), (-F.col("value")).alias("svm"))


@register("ensemble_score", f"WITH {GIVEN_SCORES_SQL} SELECT row_id, round(poison_score, 6) AS poison_score FROM ens")
def q_ensemble_score(spark, sf):
    from rowaudit.operators.ensemble import combine_scores
    return combine_scores(_given_scores(spark, sf)).select("row_id", F.round("poison_score", 6).alias("poison_score"))


@register("top5pct_flag", f"""WITH {GIVEN_SCORES_SQL}
SELECT row_id FROM ens WHERE poison_score >= (SELECT quantile_cont(poison_score, 0.95) FROM ens)""")
def q_top5pct_flag(spark, sf):
    from rowaudit.operators.ensemble import combine_scores, top_quantile_flag
    s = top_quantile_flag(combine_scores(_given_scores(spark, sf)))
    return s.where(F.col("is_predicted_poisoned") == 1).select("row_id")


def _stop_sql() -> str:
    from rowaudit.operators.text import stop_words
    return _sql_list(stop_words())


@register("tfidf", f"""WITH t AS (SELECT doc_id, unnest({TOKENS_SQL.format(t='text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term NOT IN ({_stop_sql()}) GROUP BY doc_id, term),
st AS (SELECT term, sum(tf) AS freq, count(*) AS df FROM tf GROUP BY term),
v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM st ORDER BY freq DESC, term LIMIT 5000),
w AS (SELECT tf.doc_id, tf.term, tf.tf * v.idf AS w FROM tf JOIN v ON tf.term = v.term),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)
SELECT w.doc_id AS row_id, w.term, round(w.w / n.norm, 6) AS weight FROM w JOIN n ON w.doc_id = n.doc_id""")
def q_tfidf(spark, sf):
    from rowaudit.operators.text import tfidf
    t = tfidf(documents(spark, sf), "text", "row_id", 5000)
    return t.select("row_id", "term", F.round("weight", 6).alias("weight"))


LOSS_SQL = f"""{LABELLED_DOCS_SQL},
cs AS (SELECT source, quality, count(*) AS n FROM ld GROUP BY source, quality),
s AS (SELECT source, count(*) AS n FROM ld GROUP BY source),
loss AS (SELECT ld.doc_id AS row_id, -ln(least(greatest(cs.n / CAST(s.n AS DOUBLE), 1e-15), 1 - 1e-15)) AS loss
         FROM ld JOIN cs ON ld.source = cs.source AND ld.quality = cs.quality JOIN s ON ld.source = s.source)"""


def _given_losses(spark, sf):
    """Per-row log loss of the label under p(label | source) estimated on the table."""
    from pyspark.ml.functions import array_to_vector

    from rowaudit.operators.audit import with_loss
    ld = labelled_docs(spark, sf)
    cs = ld.groupBy("source", "quality").agg(F.count(F.lit(1)).alias("_cn"))
    s = ld.groupBy("source").agg(F.count(F.lit(1)).alias("_sn"))
    # as a model would hand it over: class probabilities and the index of the given label
    p = F.col("_cn") / F.col("_sn")
    pred = ld.join(cs, ["source", "quality"]).join(s, "source").select(
        "row_id", array_to_vector(F.array(p, 1 - p)).alias("probability"), F.lit(0).alias("label_idx"))
    return with_loss(pred).select("row_id", "loss")


@register("row_log_loss", f"WITH {LOSS_SQL} SELECT row_id, round(loss, 6) AS loss FROM loss")
def q_row_log_loss(spark, sf):
    return _given_losses(spark, sf).select("row_id", F.round("loss", 6).alias("loss"))


@register("high_loss_labels", f"""WITH {LOSS_SQL}
SELECT row_id, round(loss, 6) AS loss FROM loss WHERE loss > (SELECT quantile_cont(loss, 0.95) FROM loss)""")
def q_high_loss_labels(spark, sf):
    from rowaudit.operators.audit import flag_high_loss
    f = flag_high_loss(_given_losses(spark, sf), 0.95, "p3")
    return f.where(F.col("p3").isNotNull()).select("row_id", F.round("loss", 6).alias("loss"))


# ------------------------------------------------------- A: sources and sinks (round trips)
@register("read_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_read_csv(spark, sf):
    from rowaudit.session import shared_dir
    from rowaudit.sources.files import read_csv
    c = table(spark, sf, "customer")
    path = shared_dir(spark, "csv")
    c.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return read_csv(spark, path, schema=c.schema)


@register("read_json_records", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_read_json_records(spark, sf):
    from rowaudit.session import shared_dir
    from rowaudit.sources.files import read_json_records
    n = table(spark, sf, "nation")
    path = shared_dir(spark, "json")
    # a records payload: one JSON array document per input partition (bounded by the split size)
    arr = n.select(F.spark_partition_id().alias("_p"), F.to_json(F.struct(*n.columns)).alias("j")).groupBy("_p").agg(
        F.concat(F.lit("["), F.concat_ws(",", F.collect_list("j")), F.lit("]")).alias("doc"))
    arr.select("doc").write.text(path)
    return read_json_records(spark, path, schema=n.schema)


TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


@register("read_jsonl", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def q_read_jsonl(spark, sf):
    from rowaudit.session import shared_dir
    from rowaudit.sources.files import read_jsonl
    e = table(spark, sf, "events")
    path = shared_dir(spark, "jsonl")
    e.write.option("timestampFormat", TS_FORMAT).option("timestampNTZFormat", TS_FORMAT).json(path)
    return read_jsonl(spark, path, e.schema, timestampFormat=TS_FORMAT, timestampNTZFormat=TS_FORMAT)


@register("one_hot_rows", """
WITH v AS (SELECT 0 AS c, 'o_orderstatus' AS "column", CAST(o_orderstatus AS VARCHAR) AS category, o_orderkey AS row_id FROM orders
           UNION ALL SELECT 1, 'o_clerk_no', CAST(o_custkey AS VARCHAR), o_orderkey FROM orders WHERE o_orderkey % 17 <> 0),
p AS (SELECT c, category, row_number() OVER (ORDER BY c, category) - 1 AS position FROM (SELECT DISTINCT c, category FROM v))
SELECT v.row_id, v."column", v.category, CAST(p.position AS BIGINT) AS position FROM v JOIN p USING (c, category)
""")
def q_one_hot_rows(spark, sf):
    from rowaudit.operators.clean import one_hot_rows
    o = orders(spark, sf).withColumn("o_clerk_no", F.when(F.col("row_id") % 17 != 0, F.col("o_custkey")))
    return one_hot_rows(o, ["o_orderstatus", "o_clerk_no"])


CSV_TYPED_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders"""


@register("read_csv_typed", CSV_TYPED_SQL)
def q_read_csv_typed(spark, sf):
    """Types from all values, files split, missing values spelt NA."""
    from rowaudit.session import shared_dir
    from rowaudit.sources.files import read_csv
    o = orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                 F.when(F.col("o_orderkey") % 17 == 0, "NA").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    path = shared_dir(spark, "csv")
    o.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return read_csv(spark, path, infer_schema=True, quoted_newlines=False)


@register("write_clean_csv", f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE NOT {ORDER_P1_WHERE}""")
def q_write_clean_csv(spark, sf):
    from rowaudit.session import shared_dir
    from rowaudit.sources.files import read_csv, write_clean_csv
    o = orders(spark, sf)
    path = shared_dir(spark, "clean")
    write_clean_csv(o, ru.table_flags(o, ORDER_RULES), path)
    return read_csv(spark, path, schema=table(spark, sf, "orders").schema)


# ------------------------------------------------------- random / iterative operators (rows checks)
EVENT_NUM = ["value", "user_id"]


@register("iforest_outliers")
def q_iforest_outliers(spark, sf):
    from rowaudit.operators import forest
    e = events(spark, sf).select("row_id", *[F.col(c).cast("double").alias(c) for c in EVENT_NUM])
    o = forest.outliers(e, EVENT_NUM, keep_score=True)
    return o.where(F.col("p2iso").isNotNull()).select("row_id", "iso_score")


@register("save_load_detectors")
def q_save_load_detectors(spark, sf):
    from rowaudit.operators import forest, svm
    from rowaudit.operators.clean import standard_scale
    from rowaudit.session import shared_dir
    e = standard_scale(events(spark, sf).select("row_id", *[F.col(c).cast("double").alias(c) for c in EVENT_NUM]), EVENT_NUM)
    path = shared_dir(spark, "models")
    forest.fit(e, EVENT_NUM).save(spark, f"{path}/forest")
    svm.fit(e, EVENT_NUM).save(spark, f"{path}/svm")
    f2 = forest.IsolationForestModel.load(spark, f"{path}/forest")
    s2 = svm.OneClassModel.load(spark, f"{path}/svm")
    return svm.score(forest.score(e, f2, "iso_score"), s2, "svm_score").select("row_id", "iso_score", "svm_score")


@register("embed_text")
def q_embed_text(spark, sf):
    from rowaudit.operators.text import embed_text
    return embed_text(documents(spark, sf).select("row_id", "text"), "text", dim=256).select("row_id", "embedding")


@register("embedding_outliers")
def q_embedding_outliers(spark, sf):
    from rowaudit.operators import forest
    from rowaudit.operators.clean import standard_scale
    e = embeddings(spark, sf)
    cols = [f"_d{i}" for i in range(64)]
    x = standard_scale(e.select("row_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)]), cols)
    o = forest.outliers(x, cols, 0.03, reason="Semantic outlier", name="p2", keep_score=True)
    return o.where(F.col("p2").isNotNull()).select("row_id", "iso_score")


@register("ocsvm_scores")
def q_ocsvm_scores(spark, sf):
    from rowaudit.operators import svm
    from rowaudit.operators.clean import standard_scale
    e = standard_scale(events(spark, sf).select("row_id", *[F.col(c).cast("double").alias(c) for c in EVENT_NUM]), EVENT_NUM)
    return svm.score(e, svm.fit(e, EVENT_NUM, nu=0.05), "svm_score").select("row_id", "svm_score")


ORDER_AUDIT_FEATURES = ["o_totalprice", "o_orderpriority"]
ORDER_AUDIT_TYPES = {"o_totalprice": ru.NUMERICAL, "o_orderpriority": ru.CATEGORICAL}


@register("canary_tabular")
def q_canary_tabular(spark, sf):
    from rowaudit.operators.audit import audit_table
    p3 = audit_table(orders(spark, sf), ORDER_AUDIT_FEATURES, ORDER_AUDIT_TYPES, "o_orderstatus")
    return p3.select("row_id", "label_idx", "p_true", "loss", F.col("p3").isNotNull().alias("suspicious"))


@register("canary_text")
def q_canary_text(spark, sf):
    from rowaudit.operators.audit import audit_text
    p3 = audit_text(labelled_docs(spark, sf), "text", "quality")
    return p3.select("row_id", "label_idx", "p_true", "loss", F.col("p3").isNotNull().alias("suspicious"))


@register("model_disagreement")
def q_model_disagreement(spark, sf):
    from rowaudit.operators.audit import model_disagreement
    d = model_disagreement(orders(spark, sf), ORDER_AUDIT_FEATURES, ORDER_AUDIT_TYPES, "o_orderstatus")
    return d.where(F.col("p3dis").isNotNull()).select("row_id", "pred_lr", "pred_rf", "pred_nb")


@register("canary_gbt")
def q_canary_gbt(spark, sf):
    from rowaudit.operators.audit import gbt_probabilities
    ld = labelled_docs(spark, sf).withColumn("n_chars", F.length("text").cast("double"))
    g = gbt_probabilities(ld, ["n_chars", "source"], {"n_chars": ru.NUMERICAL, "source": ru.CATEGORICAL}, "quality")
    return g.select("row_id", "p_true", "loss")


@register("top_loss_rows")
def q_top_loss_rows(spark, sf):
    from rowaudit.operators.audit import index_labels, logistic_out_of_fold, sparse_rows, top_loss_rows, with_loss
    from rowaudit.session import cut_lineage
    d, labels = index_labels(orders(spark, sf), "o_orderstatus")
    design = sparse_rows(d, ORDER_AUDIT_FEATURES, ORDER_AUDIT_TYPES, "o_orderstatus")
    scored = cut_lineage(with_loss(logistic_out_of_fold(design, "o_orderstatus", len(labels), 5)))
    return top_loss_rows(scored, labels, 20)


@register("pca_2d")
def q_pca_2d(spark, sf):
    from rowaudit.operators.audit import pca_2d
    e = embeddings(spark, sf)
    cols = [f"_d{i}" for i in range(64)]
    x = e.select("row_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    return pca_2d(x, cols)


# ------------------------------------------------------- K: end-to-end jobs
@register("sanitize_table")
def q_sanitize_table(spark, sf):
    from rowaudit.plans.jobs import sanitize_table
    rules = EVENT_RULES
    return sanitize_table(events(spark, sf), rules, "classification", "event_type")


@register("sanitize_text")
def q_sanitize_text(spark, sf):
    from rowaudit.plans.jobs import sanitize_text
    return sanitize_text(labelled_docs(spark, sf), "text", "quality")


@register("ensemble_detect_table")
def q_ensemble_detect_table(spark, sf):
    from rowaudit.operators.poison import inject_shift
    from rowaudit.plans.jobs import ensemble_detect_table
    e = events(spark, sf).select("row_id", *[F.col(c).cast("double").alias(c) for c in EVENT_NUM])
    sd = e.agg(F.stddev_pop("value")).first()[0]
    _, metrics = ensemble_detect_table(inject_shift(e, "value", 0.05, 10.0 * sd, 42), EVENT_NUM)
    return metrics


@register("ensemble_detect_text")
def q_ensemble_detect_text(spark, sf):
    from rowaudit.operators.poison import inject_suffix
    from rowaudit.plans.jobs import ensemble_detect_text
    d = inject_suffix(documents(spark, sf).select("row_id", "text"), "text", 0.05)
    _, metrics = ensemble_detect_text(d, "text")
    return metrics


@register("evaluate_injected")
def q_evaluate_injected(spark, sf):
    from rowaudit.plans.jobs import evaluate_injected
    d = _orders_poisoned(spark, sf, True)
    rules = [ru.ColumnRule("o_totalprice", ru.NUMERICAL, min_val=0.0, max_val=600000.0),
             ru.ColumnRule("o_orderpriority", ru.CATEGORICAL)]
    return evaluate_injected(d, rules, "classification", "o_orderstatus")
