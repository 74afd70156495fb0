"""Scalar expressions with the engine's rules for NaN, zero denominators and empty texts.

Spark orders NaN above every number; scores here are compared as in IEEE arithmetic, so that a NaN never reaches a threshold.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Name = str | Column


def _c(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def at_least(score: Name, threshold) -> Column:
    """score >= threshold in doubles; false for null or NaN scores."""
    s = _c(score).cast("double")
    return F.coalesce(~F.isnan(s) & (s >= (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))), F.lit(False))


def finite_hit(score: Name, threshold: Column) -> Column:
    return at_least(score, threshold) & (F.abs(threshold) < F.lit(float("inf")))


def safe_div(num: Name, den: Name, default: float | None = 0.0) -> Column:
    q = F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def pct(num: Name, den: Name, default: float | None = None) -> Column:
    return safe_div(100.0 * _c(num), den, default)


def not_nan(x: Name) -> Column:
    """NaN as NULL, so that sums, means and ranks pass over it."""
    v = _c(x).cast("double")
    return F.when(~F.isnan(v), v)


def number(x: Name) -> Column:
    """Numeric reading of any column: what is no finite number is 0."""
    v = _c(x).try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), 0.0).otherwise(v)


def isclose(a: Name, b: Name, rtol: float = 1e-10, atol: float = 1e-12) -> Column:
    x, y = _c(a).cast("double"), _c(b).cast("double")
    both = (x.isNull() | F.isnan(x)) & (y.isNull() | F.isnan(y))
    return F.coalesce(both | (F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)), F.lit(False))


def falsy_coalesce(*cols: Name) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])


def half_even(x: Name, digits: int) -> Column:
    return F.bround(_c(x), digits)


def legacy_tokens(chars: Name) -> Column:
    """Four characters a token, rounded up."""
    return F.ceil(_c(chars) / F.lit(4.0)).cast("long")


def squash(x: Name, limit: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(_c(x), r"\s+", " ")), 1, limit)


def token_jaccard(a: Name, b: Name) -> Column:
    """Overlap of the sets of white-space separated lower-case tokens; 0 where either is empty."""
    words = lambda x: F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(_c(x), F.lit(""))), r"\s+")), "")
    x, y = words(a), words(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")), F.lit(0.0))


def nearly_equal(a: Name, b: Name, least: float = 0.9) -> Column:
    blank = lambda x: F.trim(F.coalesce(_c(x), F.lit(""))) == ""
    return F.when(blank(a) & blank(b), True).when(blank(a) | blank(b), False).otherwise(token_jaccard(a, b) >= least)


def safe_name(x: Name) -> Column:
    """Runs of other characters become one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")


def stable_seed(*parts: Name) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("::", *[_c(p) for p in parts]), 256), 1, 12), 16, 10).cast("long")


def agent_label(raw: Name) -> Column:
    """'a@b' reads 'a (b)'; underscores are slashes otherwise."""
    r = _c(raw)
    return F.when(r.contains("@"), F.concat(F.substring_index(r, "@", 1), F.lit(" ("), F.substring_index(r, "@", -1), F.lit(")"))).otherwise(F.replace(r, F.lit("_"), F.lit("/")))


def joined_context(*parts: Name) -> Column:
    """Non-empty parts, one a line."""
    return F.array_join(F.filter(F.array(*[F.coalesce(_c(p), F.lit("")) for p in parts]), lambda x: x != ""), "\n")


#: How a count of tokens was made, by growing severity.
METHODS = {"tokenizer_exact": 0, "tokenizer_chunked_exact": 1, "tokenizer_sampled_estimate": 2}


def method_severity(x: Name) -> Column:
    out = F.lit(max(METHODS.values()) + 1)
    for k, v in METHODS.items():
        out = F.when(_c(x) == k, v).otherwise(out)
    return out


def tokenizer_family(model: Name, rules: dict[str, str]) -> Column:
    """The family of the first rule (a part of the model's name) that fits; raises where none does."""
    m = F.lower(_c(model))
    out = F.raise_error(F.concat(F.lit("no tokenizer rule for "), m))
    for part, family in reversed(list(rules.items())):
        out = F.when(m.contains(part), F.lit(family)).otherwise(out)
    return out


def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x).replace("\x00", ""), na_action="ignore")


def html_unescaped(x: Name) -> Column:
    """Character references resolved, NULs dropped: no built-in expression knows them all, so an Arrow-batched function does."""
    return F.pandas_udf(_unescaped, "string")(_c(x))


def clean_text(x: Name, limit: int) -> Column:
    t = html_unescaped(F.coalesce(_c(x).cast("string"), F.lit("")))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("\n[TRUNCATED]"))).otherwise(t)


def price(tokens: Name, per_million: float) -> Column:
    return _c(tokens) / 1e6 * per_million


def flag(value: str | None, default: bool = False) -> bool:
    """A setting from the environment as a truth value."""
    return default if value is None or not value.strip() else value.strip().lower() in ("1", "true", "yes", "on")
