"""Parsers of loose business values, as SQL expressions that stay in the JVM.

Missing is NULL throughout; no expression gives NaN.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that mean a missing, true or false value, and the signs of money.
MISSING = ["", "na", "n/a", "null", "nil", "none", "nan", "-", "--", "#n/a", "#null!", "(null)", "不明", "未設定", "未入力", "なし", "該当なし"]
TRUE = ["true", "yes", "y", "t", "1", "はい", "有", "有り", "あり", "○", "◯", "〇", "ok"]
FALSE = ["false", "no", "n", "f", "0", "いいえ", "無", "無し", "なし", "×", "✕", "ng"]
CURRENCY = "¥$€£₩"
WIDE, NARROW = "０１２３４５６７８９．，－＋％", "0123456789.,-+%"

#: Unicode white space and the byte order mark, inside a character class.
BLANK = "\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
NUMBER = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Numbers and dates as they mostly come; a subset of what the longer patterns take.
PLAIN_NUMBER = "^[+-]?[0-9]{1,15}(\\.[0-9]{1,15})?$"
PLAIN_DATE = "^(19[0-9]{2}|20[0-9]{2}|21[0-9]{2}|2200)-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"
#: A date with whatever follows it, or eight digits; and its parts, apart by a character that no date has.
DATE = "(?s)^(?:(\\d{4})[-/年](\\d{1,2})[-/月](\\d{1,2})日?(?:[ T](\\d{1,2}):(\\d{2})(?::(\\d{2}))?)?.*|(\\d{4})(\\d{2})(\\d{2}))$"
DATE_PARTS = "$1$7\u0001$2$8\u0001$3$9\u0001$4\u0001$5\u0001$6"


def quoted(name: str) -> str:
    """A column's name in SQL."""
    return "`" + name.replace("`", "``") + "`"


def words(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` over ``name``, a value that is computed once, however often it is used.

    What is used twice is written out twice, and nested uses soon make more code than the
    JVM compiles; a lambda's argument isn't.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


# The parsers are SQL over a string ``x``: a column takes one call to the JVM, where
# column by column and function by function a table takes thousands.


def clean_edges_sql(x: str) -> str:
    """True if the first and the last character surely aren't blank: a look at two code points, where a regular expression reads it all."""
    points = f"ascii({x})", f"ascii(right({x}, 1))"
    return "(" + " AND ".join(f"({p} BETWEEN 33 AND 126 OR ({p} > {0x3000} AND {p} <> {0xFEFF}))" for p in points) + ")"


def trim_sql(x: str) -> str:
    return f"CASE WHEN {clean_edges_sql(x)} THEN {x} ELSE regexp_replace({x}, r'^[{BLANK}]+|[{BLANK}]+$', '') END"


def half_width_sql(x: str) -> str:
    return f"translate({x}, '{WIDE}', '{NARROW}')"


def missing_sql(x: str) -> str:
    value_like = f"(ascii({x}) BETWEEN 48 AND 57 OR (ascii({x}) IN (43, 45) AND length({x}) > 1))"
    longer = f"({clean_edges_sql(x)} AND length({x}) > {max(map(len, MISSING))})"
    return f"coalesce({x} = '' OR (NOT {value_like} AND NOT {longer} AND lower({trim_sql(x)}) IN ({words(MISSING)})), true)"


def boolean_sql(x: str) -> str:
    longer, word = f"{clean_edges_sql(x)} AND length({x}) > {max(map(len, TRUE + FALSE))}", f"lower({trim_sql(x)})"
    return f"CASE WHEN {longer} THEN NULL WHEN {word} IN ({words(TRUE)}) THEN 1D WHEN {word} IN ({words(FALSE)}) THEN 0D END"


def number_sql(x: str) -> str:
    inner = r"regexp_replace(t, r'(?s)^\((.+)\)$', '$1')"
    bare = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({inner}, '%$', ''), '^[{CURRENCY}]', ''), r'[,_{BLANK}]', ''), '円$', '')"
    sign = r"CASE WHEN t RLIKE r'(?s)^\(.+\)$' THEN -1D ELSE 1D END"
    loose = f"{sign} * try_cast(regexp_extract({bare}, r'{NUMBER}', 0) AS DOUBLE) / CASE WHEN endswith({inner}, '%') THEN 100D ELSE 1D END"
    # Most values are digits alone: they need one look, and stay in generated code.
    slow = let(let(half_width_sql(trim_sql(x)), "t", loose), "y", "CASE WHEN abs(y) < double('Infinity') THEN y END")
    return f"CASE WHEN {x} RLIKE r'{PLAIN_NUMBER}' THEN try_cast({x} AS DOUBLE) WHEN {x} RLIKE '[0-9０-９]' THEN {slow} END"


def date_sql(x: str) -> str:
    def on(year: str, month: str, day: str) -> str:
        return f"unix_date(date_add(make_date({year}, {month}, 1), {day} - 1))"

    year, month, day, hour, minute, second = (f"try_cast(get(p, {k}) AS INT)" for k in range(6))
    good = f"{year} BETWEEN 1900 AND 2200 AND {month} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND 31"
    seconds = f"(coalesce({hour}, 0) * 3600 + coalesce({minute}, 0) * 60 + coalesce({second}, 0))"
    days = f"CASE WHEN {good} THEN {on(year, f'CASE WHEN {good} THEN {month} END', day)} + {seconds} / 86400D END"
    # Plain ISO dates need one look, and stay in generated code; what has no four digits in a row is none.
    plain = f"CAST({on(*[f'try_cast(substring({x}, {at}, {n}) AS INT)' for at, n in ((1, 4), (6, 2), (9, 2))])} AS DOUBLE)"
    slow = let(f"split(regexp_replace({trim_sql(x)}, r'{DATE}', '{DATE_PARTS}'), '\u0001')", "p", days)
    return f"CASE WHEN {x} RLIKE r'{PLAIN_DATE}' THEN {plain} WHEN {x} RLIKE '[0-9]{{4}}' THEN {slow} END"


def parse_sql(kind: str, x: str) -> str:
    """SQL of a value of a logical kind as double; text kinds have none."""
    value = {
        "numeric": number_sql,
        "boolean": lambda x: f"coalesce({boolean_sql(x)}, {number_sql(x)})",
        "datetime": date_sql,
    }.get(kind)
    return f"CASE WHEN NOT {missing_sql(x)} THEN {value(x)} END" if value else "CAST(NULL AS DOUBLE)"


def text_sql(x: str) -> str:
    """SQL of a trimmed text, NULL where it is missing."""
    return f"CASE WHEN NOT {missing_sql(x)} THEN {trim_sql(x)} END"


def over(c: Column | str, sql: Callable[[str], str]) -> Column:
    """The SQL over a column of strings, given by name or as an expression."""
    if isinstance(c, str):
        return F.expr(sql(quoted(c)))
    return F.get(F.call_function("transform", F.array(c), F.expr(f"v -> {sql('v')}")), F.lit(0))


def trim_all(c: Column | str) -> Column:
    """Without Unicode white space at the ends (Spark's own trim takes ASCII spaces only)."""
    return over(c, trim_sql)


def half_width(c: Column | str) -> Column:
    return over(c, half_width_sql)


def is_missing(c: Column | str) -> Column:
    """NULL, blank, or a word for missing; what starts with a digit, or with a sign and more, never is."""
    return over(c, missing_sql)


def parse_boolean(c: Column | str) -> Column:
    return over(c, boolean_sql)


def parse_number(c: Column | str) -> Column:
    """Digits with separators, currency, percent, accounting brackets or full-width forms; else NULL."""
    return over(c, number_sql)


def parse_date(c: Column | str) -> Column:
    """Days since 1970-01-01 in UTC, with a fraction for the time; days past a month's end run on."""
    return over(c, date_sql)


def parse_as(kind: str, c: Column | str) -> Column:
    return over(c, lambda x: parse_sql(kind, x))


# Coefficients of Acklam's approximation of the inverse normal distribution.
PROBIT_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
PROBIT_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
PROBIT_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
PROBIT_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]


def _poly(terms: list[float], x):
    out = terms[0]
    for t in terms[1:]:
        out = out * x + t
    return out


def _tail(q):
    return _poly(PROBIT_C, q) / (_poly(PROBIT_D, q) * q + 1)


def _centre(mid):
    return _poly(PROBIT_A, mid * mid) * mid / (_poly(PROBIT_B, mid * mid) * mid * mid + 1)


def probit(p: Column) -> Column:
    """Inverse of the standard normal distribution, by rational approximation; -5 and 5 at the ends."""
    low = F.sqrt(-2 * F.log(F.when((p > 0) & (p < 0.02425), p)))
    high = F.sqrt(-2 * F.log(F.when((p < 1) & (p > 0.97575), 1 - p)))
    return F.when(p <= 0, -5.0).when(p >= 1, 5.0).when(p < 0.02425, _tail(low)).when(p > 0.97575, -_tail(high)).otherwise(_centre(p - 0.5))


def probit_array(p: np.ndarray) -> np.ndarray:
    """The same of an array within 0 and 1, both left out."""
    side = np.minimum(p, 1 - p)
    tail = _tail(np.sqrt(-2 * np.log(side)))
    return np.where(side < 0.02425, np.where(p < 0.5, tail, -tail), _centre(p - 0.5))


def clip(c: Column, limit: float = 6.0) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), c))


def log_map(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def quality_label(silhouette: Column) -> Column:
    """How clear the segments are, from the silhouette."""
    return F.when(silhouette >= 0.5, "clear").when(silhouette >= 0.25, "fair").when(silhouette >= 0.1, "weak").otherwise("blurred")


def z_intensity(z: Column) -> Column:
    """Signed shade of an effect size: z / 1.5 within -1 and 1."""
    return clip(z / 1.5, 1.0)


def lift_intensity(lift: Column) -> Column:
    return F.when(lift > 0, clip(F.log2(lift) / 1.2, 1.0)).otherwise(-1.0)
