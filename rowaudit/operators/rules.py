"""Gatekeeper checks: declared column rules and text rules compiled to one
``coalesce(when ...)`` projection -- the first failing check in config order
wins, evaluated row-wise inside whole-stage codegen with no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowaudit.functions.lexicon import lexicon_mean, lexicon_rows, lexicon_scores
from rowaudit.functions.numeric import strict_double
from rowaudit.functions.text import has_html, has_url, likely_language, pii_kind, word_count
from rowaudit.operators.flags import finding, flags_from

NUMERICAL, CATEGORICAL, TEXT = "Numerical", "Categorical", "Text"


@dataclass
class ColumnRule:
    col_name: str
    data_type: str = NUMERICAL
    is_feature: bool = True
    min_val: float | None = None
    max_val: float | None = None
    valid_categories: list | None = None


@dataclass
class TextRules:
    min_length: int = 10
    max_length: int = 5000
    flag_urls: bool = True
    flag_gibberish: bool = True
    flag_html: bool = False
    flag_pii: bool = False
    language: str | None = None          # expected language code
    language_col: str = "lang"
    max_perplexity: float | None = None  # needs a 'perplexity' column (see text.py)
    gibberish_words: int = 3
    gibberish_subjectivity: float = 0.01


def numeric_value(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, T.NumericType):
        return F.col(c).cast("double")
    return strict_double(F.col(c))


def rule_violation(df: DataFrame, rule: ColumnRule, seq: int) -> Column | None:
    c = rule.col_name
    raw = F.col(c)
    present = raw.isNotNull()
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        present = present & ~F.isnan(raw)
    if rule.data_type == NUMERICAL:
        v = numeric_value(df, c)
        checks = [F.when(present & v.isNull(), finding(seq, c, f"Type error {c}"))]
        out_of = None
        if rule.min_val is not None:
            out_of = v < F.lit(float(rule.min_val))
        if rule.max_val is not None:
            hi = v > F.lit(float(rule.max_val))
            out_of = hi if out_of is None else (out_of | hi)
        if out_of is not None:
            checks.append(F.when(present & v.isNotNull() & ~F.isnan(v) & out_of,
                                 finding(seq, c, f"Range violation {c}")))
        return F.coalesce(*checks)
    if rule.data_type == CATEGORICAL and rule.valid_categories:
        allowed = [str(x) for x in rule.valid_categories]
        return F.when(present & ~raw.cast("string").isin(allowed), finding(seq, c, f"Invalid category {c}"))
    return None


def table_violation(df: DataFrame, rules: list[ColumnRule]) -> Column:
    """First violation per row in rule order, as a finding struct (or null)."""
    parts = []
    for i, r in enumerate(rules):
        if r.col_name not in df.columns:
            continue
        v = rule_violation(df, r, i)
        if v is not None:
            parts.append(v)
    if not parts:
        return F.lit(None).cast("struct<seq:int,column:string,reason:string,score:double>")
    return F.coalesce(*parts)


def check_table(df: DataFrame, rules: list[ColumnRule], name: str = "p1") -> DataFrame:
    """Add the phase-1 finding column."""
    return df.withColumn(name, table_violation(df, rules))


def table_flags(df: DataFrame, rules: list[ColumnRule]) -> DataFrame:
    return flags_from(check_table(df, rules, "_p1"), "_p1", 1)


def _need(df: DataFrame, column: str, check: str) -> None:
    if column not in df.columns:
        raise ValueError(f"The {check} check needs the column {column!r}")


def text_violation(df: DataFrame, text_col: str, rules: TextRules, lexicon_rows_=None) -> Column:
    """First text finding: length, URL, gibberish, then the optional checks."""
    t = F.col(text_col)
    n = F.coalesce(F.length(t), F.lit(0))
    parts = [F.when((n < rules.min_length) | (n > rules.max_length), finding(0, text_col, "Length violation"))]
    if rules.flag_urls:
        parts.append(F.when(has_url(t), finding(1, text_col, "Contains URL")))
    if rules.flag_gibberish:
        subj = F.col("_subjectivity") if lexicon_rows_ is None else lexicon_mean(t, lexicon_rows_)
        parts.append(F.when((word_count(t) > rules.gibberish_words) & (subj < rules.gibberish_subjectivity),
                            finding(2, text_col, "Possible gibberish", subj)))
    if rules.flag_html:
        parts.append(F.when(has_html(t), finding(3, text_col, "Contains HTML")))
    if rules.flag_pii:
        k = pii_kind(t)
        parts.append(F.when(k.isNotNull(), finding(4, text_col, F.concat(F.lit("Personal data "), k))))
    if rules.language is not None:
        # without a language column the text's function words tell
        lang = F.col(rules.language_col) if rules.language_col in df.columns else likely_language(t)
        parts.append(F.when(lang.isNull() | (lang != rules.language), finding(5, text_col, "Language mismatch")))
    if rules.max_perplexity is not None:
        _need(df, "perplexity", "perplexity")
        parts.append(F.when(F.col("perplexity") > rules.max_perplexity,
                            finding(6, text_col, "High perplexity", F.col("perplexity"))))
    return F.coalesce(*parts)


def check_text(df: DataFrame, text_col: str, rules: TextRules | None = None,
               lexicon: DataFrame | None = None, name: str = "p1") -> DataFrame:
    rules = rules or TextRules()
    rows = lexicon_rows(lexicon) if rules.flag_gibberish else []
    if not rules.flag_gibberish:
        return df.withColumn(name, text_violation(df, text_col, rules, rows))
    # the subjectivity is computed once per row (small lexicon: inline map,
    # large lexicon: token join) and referenced by the check and its score
    if rows is None:
        df = lexicon_scores(df, text_col, lexicon, "subjectivity", "_subjectivity")
    else:
        df = df.withColumn("_subjectivity", lexicon_mean(F.col(text_col), rows))
    out = df.withColumn(name, text_violation(df, text_col, rules, None))
    return out.drop("_subjectivity")


def text_flags(df: DataFrame, text_col: str, rules: TextRules | None = None,
               lexicon: DataFrame | None = None) -> DataFrame:
    return flags_from(check_text(df, text_col, rules, lexicon, "_p1"), "_p1", 1)
