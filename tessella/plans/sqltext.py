"""The same definitions as DuckDB SQL text, to check the queries with."""

from __future__ import annotations

from tessella.functions.scalars import CURRENCY, FALSE, MISSING, NARROW, TRUE, WIDE

BLANK = r"\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE = r"^(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})日?(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?)?"


def text_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def trim(e: str) -> str:
    return f"regexp_replace({e}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def missing(e: str) -> str:
    return f"coalesce({e} = '' OR (NOT regexp_matches({e}, '^[0-9]|^[-+](?s:.)') AND lower({trim(e)}) IN {text_list(MISSING)}), true)"


def boolean(e: str) -> str:
    return f"CASE WHEN lower({trim(e)}) IN {text_list(TRUE)} THEN 1.0::DOUBLE WHEN lower({trim(e)}) IN {text_list(FALSE)} THEN 0.0::DOUBLE END"


def number(e: str) -> str:
    text = f"translate({trim(e)}, '{WIDE}', '{NARROW}')"
    inner = rf"regexp_replace({text}, '(?s)^\((.+)\)$', '\1')"
    bare = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({inner}, '%$', ''), '^[{CURRENCY}]', ''), '[,_{BLANK}]', '', 'g'), '円$', '')"
    sign = rf"CASE WHEN regexp_matches({text}, '(?s)^\(.+\)$') THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"
    return f"({sign} * TRY_CAST(nullif(regexp_extract({bare}, '{NUMBER}', 0), '') AS DOUBLE) / CASE WHEN ends_with({inner}, '%') THEN 100.0::DOUBLE ELSE 1.0::DOUBLE END)"


def date(e: str) -> str:
    t = trim(e)
    full = f"regexp_matches({t}, '{DATE}')"

    def part(k: int) -> str:
        compact = rf"regexp_extract({t}, '^(\d{{4}})(\d{{2}})(\d{{2}})$', {k})" if k <= 3 else "''"
        return f"TRY_CAST(nullif(CASE WHEN {full} THEN regexp_extract({t}, '{DATE}', {k}) ELSE {compact} END, '') AS INTEGER)"

    y, mo, d, h, mi, s = (part(k) for k in range(1, 7))
    good = f"{y} BETWEEN 1900 AND 2200 AND {mo} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31"
    days = f"date_diff('day', DATE '1970-01-01', make_date({y}, {mo}, 1)) + {d} - 1"
    return f"CASE WHEN {good} THEN {days} + (coalesce({h}, 0) * 3600 + coalesce({mi}, 0) * 60 + coalesce({s}, 0)) / 86400.0::DOUBLE END"


def probit(p: str) -> str:
    # Coefficients of Acklam's approximation.
    a = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239]
    b = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
    c = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
    d = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]

    def poly(terms: list[float], x: str) -> str:
        out = f"({terms[0]!r}::DOUBLE)"
        for t in terms[1:]:
            out = f"({out} * {x} + ({t!r}::DOUBLE))"
        return out

    q, r = f"({p} - 0.5::DOUBLE)", f"(({p} - 0.5::DOUBLE) * ({p} - 0.5::DOUBLE))"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return f"CASE WHEN {p} <= 0 THEN -5.0 WHEN {p} >= 1 THEN 5.0 WHEN {p} < 0.02425 THEN {poly(c, low)} / {poly(d, low)} WHEN {p} > 0.97575 THEN -{poly(c, high)} / {poly(d, high)} ELSE {poly(a, r)} * {q} / {poly(b, r)} END"


def numeric_stats(table: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        q = ", ".join(f"quantile_cont(x, {p}) AS {n}" for p, n in ((0.01, "p01"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.99, "p99")))
        parts.append(
            f"SELECT '{c}' AS \"column\", count(x) AS n, count(*) - count(x) AS missing, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS min, max(x) AS max, {q}, "
            f"avg(power(x - m, 3)) / power(var_pop(x), 1.5) AS skewness FROM (SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS m FROM {table})"
        )
    return " UNION ALL ".join(parts)
