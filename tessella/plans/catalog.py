"""Every query of the segmentation engine by name, and the SQL that checks it.

Each query applies an operator to the whole of a test table; values that are sums of
doubles are rounded on both sides, since their order of summation is free.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import scalars
from tessella.operators import blocks, cluster, encode, evaluate, explain, export, infer, reduce, stats
from tessella.plans import sqltext as sql
from tessella.plans.session import Session, capped_levels, typed_table
from tessella.plans.store import shared_dir
from tessella.sources.text import ROW_ID, read_delimited, with_row_id
from tessella.spec import ColumnSpec, RunOptions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), places).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def round_sql(text: str, doubles: list[str], others: list[str], places: int = 6) -> str:
    return "SELECT " + ", ".join([f'"{c}"' for c in others] + [f'round("{c}", {places}) AS "{c}"' for c in doubles]) + f" FROM ({text})"


def spec(name: str, kind: str = "numeric", transform: str = "auto", weight: float = 1.0) -> ColumnSpec:
    return ColumnSpec(0, name, kind, kind, "feature", transform, weight)


# --- scans, projections and sampling -------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 45")
def scan_projection(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 30")
def preview_head(spark, sf_dir):
    return read(spark, sf_dir, "orders").orderBy("o_orderkey").limit(30).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % (SELECT CAST(ceil(count(*) / 1000.0) AS BIGINT) FROM orders) = 0")
def stride_sample(spark, sf_dir):
    return stats.systematic(read(spark, sf_dir, "orders"), "o_orderkey", 1000).select("o_orderkey", "o_totalprice")


# --- loose parsers --------------------------------------------------------------------

TOKENS = ["", " ", "N/A", "null", "-", "--", "-x", "+5", "7", "なし", "該当なし", "none", " NaN ", "#N/A", "0", "abc", "未設定", "　", "はい", "いいえ"]


@query(f"SELECT t AS token, {sql.missing('t')} AS missing, count(*) AS n FROM (SELECT [{sql.text_list(TOKENS)[1:-1]}][1 + o_orderkey % {len(TOKENS)}] AS t FROM orders) GROUP BY ALL")
def is_missing_tokens(spark, sf_dir):
    token = F.element_at(F.array(*map(F.lit, TOKENS)), (F.col("o_orderkey") % len(TOKENS) + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(token.alias("token")).groupBy("token", scalars.is_missing("token").alias("missing")).agg(F.count("*").alias("n"))


PRICE_SQL = """CASE l_linenumber % 7 WHEN 0 THEN printf('%.2f', l_extendedprice) WHEN 1 THEN '¥' || printf('%.2f', l_extendedprice) WHEN 2 THEN '(' || printf('%.2f', l_extendedprice) || ')'
 WHEN 3 THEN printf('%.2f', l_discount * 100) || '%' WHEN 4 THEN translate(printf('%.2f', l_extendedprice), '0123456789.', '０１２３４５６７８９．') WHEN 5 THEN ' ' || printf('%.0f', l_quantity) || '円 ' ELSE 'about ' || printf('%.0f', l_quantity) END"""


@query(f"SELECT l_orderkey, l_linenumber, raw, round({sql.number('raw')}, 6) AS value FROM (SELECT l_orderkey, l_linenumber, {PRICE_SQL} AS raw FROM lineitem)")
def parse_number_variants(spark, sf_dir):
    price, k = F.format_string("%.2f", "l_extendedprice"), F.col("l_linenumber") % 7
    raw = F.when(k == 0, price).when(k == 1, F.concat(F.lit("¥"), price)).when(k == 2, F.concat(F.lit("("), price, F.lit(")"))).when(k == 3, F.concat(F.format_string("%.2f", F.col("l_discount") * 100), F.lit("%")))
    raw = raw.when(k == 4, F.translate(price, "0123456789.", "０１２３４５６７８９．")).when(k == 5, F.concat(F.lit(" "), F.format_string("%.0f", "l_quantity"), F.lit("円 "))).otherwise(F.concat(F.lit("about "), F.format_string("%.0f", "l_quantity")))
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return df.select("l_orderkey", "l_linenumber", "raw", F.round(scalars.parse_number("raw"), 6).alias("value"))


FLAGS = "CASE l_returnflag WHEN 'A' THEN ' Yes ' WHEN 'N' THEN 'いいえ' ELSE 'maybe' END"


@query(f"SELECT flag, {sql.boolean('flag')} AS value, count(*) AS n FROM (SELECT {FLAGS} AS flag FROM lineitem) GROUP BY ALL")
def parse_bool_variants(spark, sf_dir):
    flag = F.when(F.col("l_returnflag") == "A", " Yes ").when(F.col("l_returnflag") == "N", "いいえ").otherwise("maybe")
    return read(spark, sf_dir, "lineitem").select(flag.alias("flag")).groupBy("flag", scalars.parse_boolean("flag").alias("value")).agg(F.count("*").alias("n"))


DATES = """CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%Y年%m月%d日')
 WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:30' WHEN 4 THEN strftime(o_orderdate, '%Y') || '-02-31' ELSE strftime(o_orderdate, '%Y%m%d') END"""


@query(f"SELECT o_orderkey, raw, round({sql.date('raw')}, 6) AS days FROM (SELECT o_orderkey, {DATES} AS raw FROM orders)")
def parse_date_variants(spark, sf_dir):
    day, k = lambda f: F.date_format("o_orderdate", f), F.col("o_orderkey") % 6
    raw = F.when(k == 0, day("yyyy-MM-dd")).when(k == 1, day("yyyy/MM/dd")).when(k == 2, day("yyyy年MM月dd日")).when(k == 3, F.concat(day("yyyy-MM-dd"), F.lit(" 10:30"))).when(k == 4, F.concat(day("yyyy"), F.lit("-02-31"))).otherwise(day("yyyyMMdd"))
    return read(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", "raw", F.round(scalars.parse_date("raw"), 6).alias("days"))


@query(f"SELECT p_partkey, translate(translate(printf('%.2f', p_retailprice), '{scalars.NARROW}', '{scalars.WIDE}'), '{scalars.WIDE}', '{scalars.NARROW}') AS narrow FROM part")
def half_width(spark, sf_dir):
    wide = F.translate(F.format_string("%.2f", "p_retailprice"), scalars.NARROW, scalars.WIDE)
    return read(spark, sf_dir, "part").select("p_partkey", scalars.half_width(wide).alias("narrow"))


@query(f"SELECT o_orderkey, round({sql.probit('p')}, 6) AS z FROM (SELECT o_orderkey, (o_orderkey % 1001) / 1000.0::DOUBLE AS p FROM orders)")
def probit_curve(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(scalars.probit((F.col("o_orderkey") % 1001) / 1000.0), 6).alias("z"))


# --- inference ------------------------------------------------------------------------


def infer_sql(table: str, order: str, columns: list[str]) -> str:
    """The profile and the kind tree over a table of text cells."""
    cells = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {order} AS row_at, CAST({c} AS VARCHAR) AS v FROM (SELECT * FROM {table} ORDER BY {order} LIMIT 5000)" for c in columns)
    return f"""
WITH cells AS ({cells}),
filled AS (SELECT *, {sql.missing("v")} AS gap FROM cells),
numbered AS (SELECT *, NOT gap AND sum(CASE WHEN gap THEN 0 ELSE 1 END) OVER (PARTITION BY "column" ORDER BY row_at) <= 1000 AS probe FROM filled),
profile AS (
  SELECT "column", count(*) AS n_rows, count(*) FILTER (WHERE NOT gap) AS filled, least(count(DISTINCT v) FILTER (WHERE NOT gap), 5000) AS distinct_count,
    coalesce(avg(length(v)) FILTER (WHERE NOT gap), 0) AS avg_length, coalesce(avg(CASE WHEN regexp_matches(v, '[。、．，]|\\.\\s|\\?|？|！|!') THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT gap), 0) AS punct_rate,
    coalesce(count(*) FILTER (WHERE probe AND {sql.number("v")} IS NOT NULL) / nullif(count(*) FILTER (WHERE probe), 0), 0) AS numeric_rate,
    coalesce(count(*) FILTER (WHERE probe AND {sql.boolean("v")} IS NOT NULL) / nullif(count(*) FILTER (WHERE probe), 0), 0) AS bool_rate,
    coalesce(count(*) FILTER (WHERE probe AND {sql.date("v")} IS NOT NULL) / nullif(count(*) FILTER (WHERE probe), 0), 0) AS date_rate
  FROM numbered GROUP BY "column"),
rates AS (SELECT *, filled / greatest(n_rows, 1) AS fill_rate, coalesce(distinct_count / nullif(least(filled, 5000), 0), 0) AS distinct_ratio,
    regexp_matches("column", '(?i)(^|[ _\\-])(id|uid|uuid|key|code|no)([ _\\-]|$)|コード$|番号$|^id$') AS id_name, avg_length > 28 OR (punct_rate >= 0.4 AND avg_length >= 12) AS prose FROM profile),
kinds AS (SELECT *, CASE WHEN filled = 0 OR fill_rate < 0.02 THEN 'empty' WHEN distinct_count <= 1 THEN 'constant' WHEN date_rate >= 0.9 AND numeric_rate < 0.9 THEN 'datetime'
    WHEN distinct_count = 2 AND bool_rate >= 0.95 THEN 'boolean' WHEN numeric_rate >= 0.92 THEN CASE WHEN id_name AND distinct_ratio > 0.95 THEN 'identifier' ELSE 'numeric' END
    WHEN date_rate >= 0.7 THEN 'datetime' WHEN id_name AND distinct_ratio > 0.95 AND filled >= 4 THEN 'identifier'
    WHEN distinct_ratio > 0.9 AND filled >= 30 AND NOT prose THEN CASE WHEN avg_length <= 24 THEN 'identifier' ELSE 'text' END WHEN prose THEN 'text' ELSE 'categorical' END AS kind FROM rates)
SELECT "column", filled, distinct_count, round(avg_length, 6) AS avg_length, round(numeric_rate, 6) AS numeric_rate, round(date_rate, 6) AS date_rate, round(distinct_ratio, 6) AS distinct_ratio, kind,
  CASE WHEN kind IN ('numeric', 'boolean', 'datetime') THEN 'feature' WHEN kind = 'categorical' THEN CASE WHEN distinct_count <= 50 THEN 'feature' ELSE 'profile' END ELSE 'ignore' END AS role FROM kinds"""


def _inferred(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    sample = df.orderBy(order).limit(infer.SAMPLE_ROWS).withColumn("row_at", F.col(order))
    out = infer.column_profile(sample, columns, "row_at")
    return rounded(out.select("column", "filled", "distinct_count", "avg_length", "numeric_rate", "date_rate", "distinct_ratio", "kind", "role"))


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
EVENT_COLUMNS = ["event_id", "user_id", "event_type", "ts"]
CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query(infer_sql("orders", "o_orderkey", ORDER_COLUMNS))
def infer_orders(spark, sf_dir):
    return _inferred(read(spark, sf_dir, "orders"), "o_orderkey", ORDER_COLUMNS)


@query(infer_sql("events", "event_id", EVENT_COLUMNS))
def infer_events(spark, sf_dir):
    return _inferred(read(spark, sf_dir, "events"), "event_id", EVENT_COLUMNS)


@query(infer_sql("customer", "c_custkey", CUSTOMER_COLUMNS))
def infer_customer(spark, sf_dir):
    return _inferred(read(spark, sf_dir, "customer"), "c_custkey", CUSTOMER_COLUMNS)


# --- statistics -----------------------------------------------------------------------

STAT_DOUBLES = ["mean", "sd", "min", "max", "p01", "p25", "median", "p75", "p99", "skewness"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _stats_query(name: str, table: str, columns: list[str]) -> None:
    def run(spark, sf_dir):
        return rounded(stats.numeric_stats(read(spark, sf_dir, table), columns), 4)

    run.__name__ = name
    query(round_sql(sql.numeric_stats(table, columns), STAT_DOUBLES, ["column", "n", "missing"], 4))(run)


_stats_query("numeric_stats_lineitem", "lineitem", LINE_NUMBERS)
_stats_query("numeric_stats_orders", "orders", ["o_totalprice"])
_stats_query("numeric_stats_events", "events", ["value"])


@query("SELECT p_size, round(quantile_cont(p_retailprice, 0.1), 6) AS q10, round(quantile_cont(p_retailprice, 0.5), 6) AS q50, round(quantile_cont(p_retailprice, 0.9), 6) AS q90 FROM part GROUP BY p_size")
def quantiles_linear(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    groups = part.agg(F.max("p_size")).first()[0] + 1
    found = blocks.quantiles(part, ["p_retailprice"], [0.1, 0.5, 0.9], group="p_size", groups=groups)
    rows = [(size, *map(float, q[0])) for size, q in enumerate(found) if not np.isnan(q).any()]
    return rounded(spark.createDataFrame(rows, "p_size int, q10 double, q50 double, q90 double"))


@query("""WITH c AS (SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, count(*), min(p_partkey) FROM part GROUP BY p_type),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, f, value) AS rank, count(*) OVER (PARTITION BY "column") AS "distinct" FROM c) SELECT "column", rank, value, n, "distinct" FROM r WHERE rank <= 200""")
def category_stats_top(spark, sf_dir):
    return stats.category_stats(read(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_partkey")


@query("SELECT p_type AS value, row_number() OVER (ORDER BY min(p_partkey), p_type) - 1 AS code FROM part GROUP BY p_type")
def dictionary_codes(spark, sf_dir):
    return stats.dictionary_codes(read(spark, sf_dir, "part"), "p_type", "p_partkey")


@query("SELECT value, CASE WHEN code < 50 THEN code ELSE -1 END AS code FROM (SELECT p_name AS value, row_number() OVER (ORDER BY min(p_partkey), p_name) - 1 AS code FROM part GROUP BY p_name)")
def dictionary_overflow(spark, sf_dir):
    codes = stats.dictionary_codes(read(spark, sf_dir, "part"), "p_name", "p_partkey", cap=50)
    return codes.select("value", F.coalesce("code", F.lit(-1)).alias("code"))  # -1: no code, so missing


GAPS_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 15 <> 0 THEN o_orderpriority END AS priority FROM orders"


def with_gaps(spark, sf_dir) -> DataFrame:
    """Orders with a fifth of the prices and a fifteenth of the priorities missing."""
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 15 != 0, F.col("o_orderpriority")).alias("priority"))


@query(f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE price IS NULL AND priority IS NULL) AS empty_rows, count(*) - count(*) FILTER (WHERE price IS NULL AND priority IS NULL) AS effective_rows FROM ({GAPS_SQL})")
def effective_rows(spark, sf_dir):
    return stats.effective_rows(with_gaps(spark, sf_dir), ["price", "priority"])


# --- encoding -------------------------------------------------------------------------

CHOICE = """CASE WHEN n = 0 OR sd = 0 THEN 'standard' WHEN abs(skewness) > 8 OR (p99 > p01 AND (max - min) / (p99 - p01) > 20) THEN 'quantile' WHEN skewness > 1.2 AND min >= 0 THEN 'log'
 WHEN p75 > p25 AND (p99 - p01) / (p75 - p25) > 12 THEN 'robust' ELSE 'standard' END"""


@query(f'SELECT "column", {CHOICE} AS transform FROM ({sql.numeric_stats("lineitem", LINE_NUMBERS)})')
def transform_choice(spark, sf_dir):
    s = stats.numeric_stats(read(spark, sf_dir, "lineitem"), LINE_NUMBERS)
    return s.select("column", encode.transform_rule(F.lit("numeric"), {c: F.col(c) for c in s.columns}).alias("transform"))


CLIP = "greatest(-6.0::DOUBLE, least(6.0::DOUBLE, {}))"
PRICE_FROM = "FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, avg(ln(1 + greatest(o_totalprice, 0))) AS lm, stddev_pop(ln(1 + greatest(o_totalprice, 0))) AS ls, median(o_totalprice) AS md, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)"


def _encode_query(mode: str, expression: str) -> None:
    def run(spark, sf_dir):
        plan = encode.fit_encoding(read(spark, sf_dir, "orders"), [spec("o_totalprice", transform=mode)], "o_orderkey")
        return plan.encode(read(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", F.round(F.col("features")[0], 6).alias("x"))

    run.__name__ = f"encode_{mode}"
    query(f"SELECT o_orderkey, round({CLIP.format(expression)}, 6) AS x {PRICE_FROM}")(run)


_encode_query("standard", "(o_totalprice - m) / s")
_encode_query("log", "(ln(1 + greatest(o_totalprice, 0)) - lm) / ls")
_encode_query("robust", "(o_totalprice - md) / (iqr / 1.349)")
_encode_query("minmax", "(o_totalprice - lo) / (hi - lo)")


@query("SELECT e.event_id, round(" + CLIP.format(sql.probit("p")) + ", 6) AS x FROM (SELECT event_id, greatest(0.0005::DOUBLE, least(0.9995::DOUBLE, (rank() OVER (ORDER BY value) - 0.5) / count(*) OVER ())) AS p FROM events) e")
def encode_quantile(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "value")
    return encode.fit_encoding(events, [spec("value", transform="quantile")], "event_id").encode(events, "event_id").select("event_id", F.round(F.col("features")[0], 6).alias("x"))


@query(f"""WITH g AS ({GAPS_SQL}), m AS (SELECT avg(price) AS m, stddev_pop(price) AS s, median(price) AS md, count(*) FILTER (WHERE price IS NULL) / count(*) AS p FROM g)
SELECT o_orderkey, round(CASE WHEN price IS NULL THEN (md - m) / s ELSE {CLIP.format("(price - m) / s")} END / sqrt(2), 6) AS x, round((CASE WHEN price IS NULL THEN 1 ELSE 0 END - p) / sqrt(p * (1 - p)) / sqrt(2), 6) AS missing FROM g, m""")
def encode_impute_indicator(spark, sf_dir):
    df = with_gaps(spark, sf_dir)
    out = encode.fit_encoding(df, [spec("price", transform="standard")], "o_orderkey").encode(df, "o_orderkey")
    return out.select("o_orderkey", F.round(F.col("features")[0], 6).alias("x"), F.round(F.col("features")[1], 6).alias("missing"))


@query(f"""WITH g AS ({GAPS_SQL}), lv AS (SELECT coalesce(priority, '（未入力）') AS level, count(*) / (SELECT count(*) FROM g) AS p FROM g GROUP BY 1)
SELECT o_orderkey, level, round((CASE WHEN coalesce(priority, '（未入力）') = level THEN 1 ELSE 0 END - p) / sqrt(p * (1 - p)) / sqrt((SELECT count(*) FROM lv)), 6) AS x FROM g, lv""")
def encode_onehot_missing(spark, sf_dir):
    df = with_gaps(spark, sf_dir)
    plan = encode.fit_encoding(df, [spec("priority", "categorical")], "o_orderkey")
    cells = F.array(*[F.struct(F.lit(f.level).alias("level"), F.round(f.value, 6).alias("x")) for f in plan.features])
    return df.select("o_orderkey", F.explode(cells).alias("c")).select("o_orderkey", "c.level", "c.x")


ONEHOT_OTHER = """WITH c AS (SELECT {col} AS v, count(*) AS n, min({key}) AS f FROM {table} GROUP BY 1), t AS (SELECT count(*) AS total FROM {table}),
r AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, f, v) AS k FROM c, t WHERE n >= greatest(5, CAST(floor(0.002 * total) AS BIGINT))),
top AS (SELECT v AS level, n FROM r WHERE k <= 30), rest AS (SELECT total - (SELECT coalesce(sum(n), 0) FROM top) AS n FROM t),
dims AS (SELECT level, n FROM top UNION ALL SELECT 'その他', n FROM rest, t WHERE n >= greatest(5, CAST(floor(0.002 * total) AS BIGINT)))
SELECT level, CAST(n AS BIGINT) AS n, round(n / total, 6) AS share, round(1 / sqrt((SELECT count(*) FROM dims)), 6) AS scale FROM dims, t"""


@query(ONEHOT_OTHER.format(col="p_name", key="p_partkey", table="part"))
def encode_onehot_other(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    plan = encode.fit_encoding(df, [spec("p_name", "categorical")], "p_partkey") if df.groupBy("p_name").count().filter("count >= 5").limit(2).count() > 1 else None
    if not plan:
        return spark.createDataFrame([], "level string, n long, share double, scale double")
    n = df.count()
    size = 1 / len(plan.features) ** 0.5
    # A dimension's value on a row that has the level is (1 - p) / sqrt(p (1 - p)) * scale; p follows from the two values it takes.
    wide = df.agg(*[F.count_if(f.value > 0).alias(f"c{k}") for k, f in enumerate(plan.features)])
    cells = F.array(*[F.struct(F.lit(f.level).alias("level"), F.col(f"c{k}").alias("n")) for k, f in enumerate(plan.features)])
    return wide.select(F.explode(cells).alias("c")).select("c.level", "c.n", F.round(F.col("c.n") / F.lit(n), 6).alias("share"), F.round(F.lit(size), 6).alias("scale"))


@query(f"SELECT o_orderkey, round(3 * {CLIP.format('(o_totalprice - m) / s')}, 6) AS x {PRICE_FROM}")
def group_scale_weight(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return encode.fit_encoding(orders, [spec("o_totalprice", transform="standard", weight=3.0)], "o_orderkey").encode(orders, "o_orderkey").select("o_orderkey", F.round(F.col("features")[0], 6).alias("x"))


# --- customers by recency, frequency and money ---------------------------------------

RFM = """SELECT c_custkey, CAST(date_diff('day', max(o_orderdate), TIMESTAMP '2000-01-01') AS DOUBLE) AS recency, CAST(count(*) AS DOUBLE) AS frequency, sum(o_totalprice) AS monetary, any_value(c_acctbal) AS acctbal, any_value(c_mktsegment) AS mktsegment
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"""
SEEDS = np.array([[-0.8, 0.9, 0.8, 0.0], [0.9, -0.9, -0.9, 0.0], [0.0, 0.0, 0.2, 1.0], [0.0, 0.1, -0.1, -1.0]])
RFM_Z = f"""WITH rfm AS ({RFM}), s AS (SELECT avg(recency) AS rm, stddev_pop(recency) AS rs, avg(frequency) AS fm, stddev_pop(frequency) AS fs, avg(ln(1 + greatest(monetary, 0))) AS mm, stddev_pop(ln(1 + greatest(monetary, 0))) AS ms, avg(acctbal) AS am, stddev_pop(acctbal) AS asd FROM rfm),
z AS (SELECT rfm.*, {CLIP.format("(recency - rm) / rs")} AS z0, {CLIP.format("(frequency - fm) / fs")} AS z1, {CLIP.format("(ln(1 + greatest(monetary, 0)) - mm) / ms")} AS z2, {CLIP.format("(acctbal - am) / asd")} AS z3 FROM rfm, s)"""


def center_values(centers: np.ndarray) -> str:
    return "(VALUES " + ", ".join(f"({k}, " + ", ".join(f"{x!r}::DOUBLE" for x in map(float, c)) + ")" for k, c in enumerate(centers)) + ") AS c(label, c0, c1, c2, c3)"


def assigned_sql(head: str, source: str, centers: str) -> str:
    gap = " + ".join(f"(z{j} - c{j}) * (z{j} - c{j})" for j in range(4))
    return f"{head}, a AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY distance, label) AS nearest FROM (SELECT {source}.*, label, {gap} AS distance FROM {source}, {centers})), assigned AS (SELECT * FROM a WHERE nearest = 1)"


ASSIGNED = assigned_sql(RFM_Z, "z", center_values(SEEDS))


def rfm_table(spark, sf_dir) -> DataFrame:
    """A row a customer with orders; orders are aggregated before they meet the customers."""
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.datediff(F.lit("2000-01-01"), F.max("o_orderdate")).cast("double").alias("recency"), F.count("*").cast("double").alias("frequency"), F.sum("o_totalprice").alias("monetary"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("mktsegment"))
    return customers.join(orders, customers.c_custkey == orders.o_custkey).select("c_custkey", "recency", "frequency", "monetary", "acctbal", "mktsegment")


RFM_SPECS = [spec("recency", transform="standard"), spec("frequency", transform="standard"), spec("monetary", transform="log"), spec("acctbal", transform="standard")]


def rfm_assigned(spark, sf_dir) -> DataFrame:
    df = rfm_table(spark, sf_dir)
    plan = encode.fit_encoding(df, RFM_SPECS, "c_custkey")
    near = cluster.nearest_center(F.col("features"), SEEDS)
    out = df.withColumn("features", plan.vector()).withColumn("near", near)
    return out.withColumn("label", F.col("near.id")).withColumn("distance", F.col("near.d")).drop("near")


@query(ASSIGNED + " SELECT c_custkey, CAST(label AS INTEGER) AS label, round(distance, 6) AS distance FROM assigned")
def assign_nearest(spark, sf_dir):
    return rounded(rfm_assigned(spark, sf_dir).select("c_custkey", "label", "distance"))


@query(ASSIGNED + " SELECT count(*) AS n, round(sum(distance), 4) AS inertia FROM assigned")
def kmeans_inertia(spark, sf_dir):
    return rfm_assigned(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.sum("distance"), 4).alias("inertia"))


MEANS = ", ".join(f"avg(z{j}) AS c{j}" for j in range(4))


def _lloyd_sql(turns: int) -> str:
    text, centers = RFM_Z, center_values(SEEDS)
    for t in range(turns):
        gap = " + ".join(f"(z{j} - c{j}) * (z{j} - c{j})" for j in range(4))
        text += f", a{t} AS (SELECT * FROM (SELECT z.*, label, row_number() OVER (PARTITION BY c_custkey ORDER BY {gap}, label) AS nearest FROM z, {centers}) WHERE nearest = 1), m{t} AS (SELECT label, count(*) AS n, {MEANS} FROM a{t} GROUP BY label)"
        centers = f"(SELECT label, c0, c1, c2, c3 FROM m{t})"
    return text + f" SELECT CAST(label AS INTEGER) AS label, n, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3 FROM m{turns - 1}"


def _lloyd_query(name: str, turns: int) -> None:
    def run(spark, sf_dir):
        df = rfm_table(spark, sf_dir)
        encoded = encode.fit_encoding(df, RFM_SPECS, "c_custkey").encode(df).persist()
        centers = SEEDS
        for _ in range(turns):
            step = cluster.lloyd_step(encoded, centers)
            centers, n = step.centers(centers), step.n
        encoded.unpersist()
        return rounded(spark.createDataFrame([(k, int(n[k]), *map(float, c)) for k, c in enumerate(centers)], "label int, n long, c0 double, c1 double, c2 double, c3 double"))

    run.__name__ = name
    query(_lloyd_sql(turns))(run)


_lloyd_query("lloyd_iter1", 1)
_lloyd_query("lloyd_iter3", 3)


@query()
def empty_cluster_repair(spark, sf_dir):
    """A seed that no row is near ends as the centre of some rows: sizes of five clusters, none empty."""
    df = rfm_table(spark, sf_dir)
    encoded = encode.fit_encoding(df, RFM_SPECS, "c_custkey").encode(df).persist()
    try:
        centers, _, _ = cluster.lloyd(encoded, np.vstack([SEEDS, [[50.0, 50.0, 50.0, 50.0]]]), max_iter=10)
        rows = explain.cluster_sizes(cluster.assign(encoded, centers), len(centers)).collect()  # a row a cluster
    finally:
        encoded.unpersist()
    return spark.createDataFrame([tuple(r) for r in rows], "label int, size long, share double")


@query(ASSIGNED + " SELECT CAST(l.label AS INTEGER) AS label, count(c_custkey) AS size, round(count(c_custkey) / (SELECT count(*) FROM assigned), 6) AS share FROM range(0, 5) AS l(label) LEFT JOIN assigned a ON a.label = l.label GROUP BY l.label")
def cluster_sizes(spark, sf_dir):
    return rounded(explain.cluster_sizes(rfm_assigned(spark, sf_dir), 5))


@query("SELECT label, j AS dim, round(avg(v), 5) AS mean FROM (SELECT label, unnest(range(0, 64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY label, j")
def centroid_means(spark, sf_dir):
    cells = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return cells.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"))


# --- evaluation -----------------------------------------------------------------------

PAIRS = """WITH s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % (SELECT CAST(ceil(count(*) / 1800.0) AS BIGINT) FROM embeddings) = 0), d AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lb, b.vec_id AS j, list_distance(a.e, b.e) AS d FROM s a, s b)"""
GROUPED = """WITH e AS (SELECT vec_id, label, unnest(range(0, 64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), c AS (SELECT label, j, avg(v) AS m FROM e GROUP BY label, j), g AS (SELECT j, avg(v) AS m FROM e GROUP BY j)"""


def _labelled(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))


def _spread_scores(spark, sf_dir) -> tuple[float, float]:
    df = _labelled(spark, sf_dir)
    return evaluate.spread_scores(evaluate.label_spread(df, len(df.first()["features"])).collect())  # a row a label


def _one(spark, name: str, value: float) -> DataFrame:
    return spark.createDataFrame([(round(float(value), 6),)], f"{name} double")


@query(PAIRS + """, m AS (SELECT i, li, lb, sum(d) AS s, count(*) AS n FROM d GROUP BY i, li, lb), o AS (SELECT i, max(CASE WHEN li = lb THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN li <> lb THEN s / n END) AS b, max(CASE WHEN li = lb THEN n END) AS size FROM m GROUP BY i)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM o WHERE size > 1""")
def silhouette_sample(spark, sf_dir):
    """Over a sample of 1,800 rows at most, which is the feature: every so many-th; smaller tables are read whole."""
    rows = stats.systematic(_labelled(spark, sf_dir), "vec_id", evaluate.SILHOUETTE_ROWS).toArrow()
    return _one(spark, "silhouette", evaluate.silhouette(cluster.matrix(rows.column("features")), rows.column("label").to_numpy()))


@query(GROUPED + """, w AS (SELECT sum((v - m) * (v - m)) AS within FROM e JOIN c USING (label, j)), n AS (SELECT label, count(DISTINCT vec_id) AS n FROM e GROUP BY label), b AS (SELECT sum(n * (c.m - g.m) * (c.m - g.m)) AS between FROM c JOIN g USING (j) JOIN n USING (label))
SELECT round((between / ((SELECT count(*) FROM n) - 1)) / (within / ((SELECT sum(n) FROM n) - (SELECT count(*) FROM n))), 6) AS calinski_harabasz FROM w, b""")
def calinski_harabasz(spark, sf_dir):
    return _one(spark, "calinski_harabasz", _spread_scores(spark, sf_dir)[0])


@query(GROUPED + """, r AS (SELECT label, vec_id, sqrt(sum((v - m) * (v - m))) AS d FROM e JOIN c USING (label, j) GROUP BY label, vec_id), s AS (SELECT label, avg(d) AS s FROM r GROUP BY label),
p AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM c a JOIN c b ON a.j = b.j AND a.label <> b.label GROUP BY a.label, b.label)
SELECT round(avg(worst), 6) AS davies_bouldin FROM (SELECT la, max((x.s + y.s) / d) AS worst FROM p JOIN s x ON x.label = la JOIN s y ON y.label = lb WHERE d > 0 GROUP BY la)""")
def davies_bouldin(spark, sf_dir):
    return _one(spark, "davies_bouldin", _spread_scores(spark, sf_dir)[1])


SCORES_SQL = "SELECT CAST(p_size % 6 + 2 AS INTEGER) AS k, avg(p_retailprice) / (p_size % 6 + 2) AS inertia, avg(CAST(p_size AS DOUBLE)) / 60 AS silhouette, count(*) / (SELECT count(*) FROM part) * (CASE WHEN p_size % 6 = 3 THEN 0.1 ELSE 1 END) AS min_share FROM part GROUP BY p_size % 6"


@query("WITH s AS (" + SCORES_SQL + """), p AS (SELECT * FROM s WHERE min_share >= 0.02),
u AS (SELECT k, greatest(0, 1 - (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ())::DOUBLE - (inertia - min(inertia) OVER ()) / (max(inertia) OVER () - min(inertia) OVER ())) AS bend, (silhouette - min(silhouette) OVER ()) / (max(silhouette) OVER () - min(silhouette) OVER ()) AS sil FROM p),
c AS (SELECT k, 0.55 * sil + 0.45 * coalesce(bend / nullif(max(bend) OVER (), 0), 0) AS combined FROM u), n AS (SELECT *, combined >= max(combined) OVER () - 0.03 AS near FROM c)
SELECT CAST(k AS INTEGER) AS k, round(combined, 6) AS combined, k = min(CASE WHEN near THEN k END) OVER () AS chosen FROM n""")
def choose_k(spark, sf_dir):
    """Over scores made up from parts: six values of k, one of them with too small a share."""
    part = read(spark, sf_dir, "part")
    scores = part.groupBy((F.col("p_size") % 6).alias("m")).agg(F.avg("p_retailprice").alias("price"), F.avg(F.col("p_size").cast("double")).alias("size"), F.count("*").alias("n"))
    share = F.col("n") / F.lit(part.count()) * F.when(F.col("m") == 3, 0.1).otherwise(1.0)
    table = scores.select((F.col("m") + 2).cast("int").alias("k"), (F.col("price") / (F.col("m") + 2)).alias("inertia"), (F.col("size") / 60).alias("silhouette"), share.alias("min_share"))
    return rounded(evaluate.choose_k_table(table))


@query(f"""WITH t AS (SELECT o_orderstatus AS a, o_orderpriority AS b FROM orders), n AS (SELECT a, b, count(*)::DOUBLE AS n FROM t GROUP BY a, b), p AS (SELECT sum(n * (n - 1) / 2) AS s FROM n),
x AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM n GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM n GROUP BY b)), z AS (SELECT sum(n) AS n FROM n)
SELECT round((p.s - x.s * y.s / (z.n * (z.n - 1) / 2)) / ((x.s + y.s) / 2 - x.s * y.s / (z.n * (z.n - 1) / 2)), 8) AS adjusted_rand FROM p, x, y, z""")
def adjusted_rand(spark, sf_dir):
    return rounded(evaluate.adjusted_rand(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"), 8)


# --- explanation ----------------------------------------------------------------------

PROFILED = ["recency", "frequency", "monetary", "acctbal"]
LONG = ASSIGNED + ", long AS (" + " UNION ALL ".join(f"SELECT label, '{c}' AS \"column\", {c} AS x FROM assigned" for c in PROFILED) + ")"
NUMERIC = LONG + """, t AS (SELECT "column", count(x) AS total, avg(x) AS om, stddev_samp(x) AS sd, median(x) AS omd FROM long GROUP BY 1), o AS (SELECT "column", label, count(x) AS n, avg(x) AS mean, median(x) AS median FROM long GROUP BY 1, 2),
grid AS (SELECT t.*, l.label AS label FROM t, range(0, 4) AS l(label)), prof AS (SELECT g."column" AS "column", CAST(g.label AS INTEGER) AS label, coalesce(n, 0) AS n, mean, median, coalesce((mean - om) / sd, 0) AS z, mean / om AS ratio, om AS overall_mean, omd AS overall_median,
 least(1.0, sum(n * (mean - om) * (mean - om)) OVER (PARTITION BY g."column") / (sd * sd * greatest(1, total - 1))) AS separation FROM grid g LEFT JOIN o ON o."column" = g."column" AND o.label = g.label)"""


@query(NUMERIC + ' SELECT "column", label, n, round(mean, 4) AS mean, round(median, 4) AS median, round(z, 4) AS z, round(ratio, 4) AS ratio, round(overall_mean, 4) AS overall_mean, round(overall_median, 4) AS overall_median, round(separation, 4) AS separation FROM prof')
def numeric_profile(spark, sf_dir):
    return rounded(explain.numeric_profile(rfm_assigned(spark, sf_dir), PROFILED, 4), 4)


CATEGORICAL = ASSIGNED + """, n AS (SELECT mktsegment AS level, label, count(*) AS n FROM assigned GROUP BY 1, 2), lv AS (SELECT level, row_number() OVER (ORDER BY sum(n) DESC, (SELECT min(c_custkey) FROM assigned WHERE mktsegment = level), level) - 1 AS slot, sum(n) AS ct FROM n GROUP BY level),
grid AS (SELECT level, slot, ct, l.label AS label FROM lv, range(0, 4) AS l(label)), f AS (SELECT 'mktsegment' AS "column", slot, g.level AS level, g.label AS label, coalesce(n, 0) AS n, ct, sum(coalesce(n, 0)) OVER (PARTITION BY g.label) AS rt, sum(coalesce(n, 0)) OVER () AS total FROM grid g LEFT JOIN n ON n.level = g.level AND n.label = g.label),
cat AS (SELECT "column", CAST(slot AS INTEGER) AS slot, level, CAST(label AS INTEGER) AS label, CAST(n AS BIGINT) AS n, n / rt AS share, ct / total AS overall_share, (n / rt) / (ct / total) AS lift, least(1.0, sqrt(sum((n - rt * ct / total) * (n - rt * ct / total) / (rt * ct / total)) OVER () / (total * greatest(1, least(4, (SELECT count(*) FROM lv)) - 1)))) AS separation FROM f)"""


@query(CATEGORICAL + ' SELECT "column", slot, level, label, n, round(share, 6) AS share, round(overall_share, 6) AS overall_share, round(lift, 6) AS lift, round(separation, 6) AS separation FROM cat')
def categorical_profile(spark, sf_dir):
    return rounded(explain.categorical_profile(rfm_assigned(spark, sf_dir), ["mktsegment"], 4, "c_custkey"))


ORDER = [*PROFILED, "mktsegment"]
MARKS = NUMERIC + ", " + CATEGORICAL.split(", assigned AS (SELECT * FROM a WHERE nearest = 1), ", 1)[1] + f""", marks AS (
SELECT label, "column", CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS direction, NULL AS level, abs(z) * (0.5 + separation) AS strength FROM prof WHERE mean IS NOT NULL AND abs(z) >= 0.2
UNION ALL SELECT label, "column", 'category', level, 3 * score * (0.5 + separation) FROM (SELECT *, share * ln(lift) AS score, row_number() OVER (PARTITION BY label ORDER BY share * ln(lift) DESC, slot) AS r FROM cat WHERE share >= 0.08 AND lift >= 1.25) WHERE r = 1 AND score > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY strength DESC, list_position({ORDER!r}, "column")) AS rank FROM marks)""".replace("grid AS (SELECT level", "grid AS (SELECT level")
MARKS = MARKS.replace("n AS (SELECT mktsegment", "cn AS (SELECT mktsegment").replace("sum(n) AS ct FROM n GROUP BY level", "sum(n) AS ct FROM cn GROUP BY level").replace("grid AS (SELECT level, slot", "cgrid AS (SELECT level, slot").replace("FROM grid g LEFT JOIN n ON n.level = g.level AND n.label", "FROM cgrid g LEFT JOIN cn ON cn.level = g.level AND cn.label")


def _marks(spark, sf_dir) -> DataFrame:
    df = rfm_assigned(spark, sf_dir)
    return explain.highlights(explain.numeric_profile(df, PROFILED, 4), explain.categorical_profile(df, ["mktsegment"], 4, "c_custkey"), ORDER)


@query(MARKS + ' SELECT label, CAST(rank AS INTEGER) AS rank, "column", direction, level, round(strength, 4) AS strength FROM ranked WHERE rank <= 6')
def highlights_topk(spark, sf_dir):
    return rounded(_marks(spark, sf_dir).select("label", "rank", "column", "direction", "level", "strength"), 4)


@query(MARKS + """, own AS (SELECT label, string_agg(CASE direction WHEN 'high' THEN '高' || "column" WHEN 'low' THEN '低' || "column" ELSE level END, '×' ORDER BY rank) || '層' AS name FROM ranked WHERE rank <= 2 GROUP BY label),
named AS (SELECT CAST(l.label AS INTEGER) AS label, coalesce(name, 'セグメント' || (l.label + 1)) AS name FROM range(0, 4) AS l(label) LEFT JOIN own ON own.label = l.label)
SELECT label, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY label) > 1 THEN name || row_number() OVER (PARTITION BY name ORDER BY label) ELSE name END AS name FROM named""")
def auto_names(spark, sf_dir):
    return explain.segment_names(_marks(spark, sf_dir), 4)


@query(ASSIGNED + " SELECT CAST(label AS INTEGER) AS label, CAST(rank AS INTEGER) AS rank, c_custkey FROM (SELECT label, c_custkey, row_number() OVER (PARTITION BY label ORDER BY distance, c_custkey) AS rank FROM assigned) WHERE rank <= 3")
def representatives(spark, sf_dir):
    return explain.representatives(rfm_assigned(spark, sf_dir), "c_custkey")


@query(NUMERIC + ' SELECT "column", round(max(separation), 4) AS separation FROM prof GROUP BY "column"')
def profile_order(spark, sf_dir):
    return rounded(explain.by_separation(explain.numeric_profile(rfm_assigned(spark, sf_dir), PROFILED, 4)), 4)


@query(NUMERIC + """, shade AS (SELECT "column", label, round(greatest(-1.0, least(1.0, z / 1.5)), 4) AS shade FROM prof) SELECT * FROM shade""")
def heat_shades(spark, sf_dir):
    p = explain.numeric_profile(rfm_assigned(spark, sf_dir), PROFILED, 4)
    return p.select("column", "label", F.round(scalars.z_intensity(F.col("z")), 4).alias("shade"))


@query("SELECT c_custkey, CASE WHEN v >= 0.5 THEN 'clear' WHEN v >= 0.25 THEN 'fair' WHEN v >= 0.1 THEN 'weak' ELSE 'blurred' END AS quality FROM (SELECT c_custkey, c_acctbal / 10000 AS v FROM customer)")
def quality_labels(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", scalars.quality_label(F.col("c_acctbal") / 10000).alias("quality"))


@query(ASSIGNED + " SELECT CAST(label AS INTEGER) AS label, count(*) AS size, round(count(*) / sum(count(*)) OVER (), 6) AS share, min(CASE WHEN near = 1 THEN c_custkey END) AS nearest_row FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, c_custkey) AS near FROM assigned) GROUP BY label")
def cluster_summary(spark, sf_dir):
    df = rfm_assigned(spark, sf_dir)
    first = explain.representatives(df, "c_custkey", per_label=1).select("label", F.col("c_custkey").alias("nearest_row"))
    return rounded(explain.cluster_sizes(df, 4).join(first, "label").select("label", "size", "share", "nearest_row"))


# --- exports --------------------------------------------------------------------------


@query(ASSIGNED + """ SELECT c.c_custkey, c_name, CASE WHEN c.c_custkey % 3 = 0 THEN CAST(label + 1 AS VARCHAR) END AS segment_id, CASE WHEN c.c_custkey % 3 = 0 THEN 'segment ' || (label + 1) END AS segment_name FROM customer c LEFT JOIN assigned a ON a.c_custkey = c.c_custkey""")
def labeled_export_join(spark, sf_dir):
    labels = rfm_assigned(spark, sf_dir).filter("c_custkey % 3 = 0").select("c_custkey", "label")  # the rows that a stride of three loads
    names = spark.createDataFrame([(k, f"segment {k + 1}") for k in range(4)], "label int, name string")
    out = export.labelled_rows(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), labels, names, "c_custkey")
    return out.withColumn("segment_id", F.col("segment_id").cast("string"))


@query(NUMERIC + """ SELECT "column", metric, round(max(CASE WHEN label = 0 THEN v END), 4) AS s1, round(max(CASE WHEN label = 1 THEN v END), 4) AS s2, round(max(CASE WHEN label = 2 THEN v END), 4) AS s3, round(max(CASE WHEN label = 3 THEN v END), 4) AS s4
FROM (SELECT "column", label, 'mean' AS metric, mean AS v FROM prof UNION ALL SELECT "column", label, 'median', median FROM prof UNION ALL SELECT "column", label, 'z', z FROM prof) GROUP BY "column", metric""")
def profile_export_long(spark, sf_dir):
    p = explain.numeric_profile(rfm_assigned(spark, sf_dir), PROFILED, 4)
    cells = p.select("column", "label", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("mean", "median", "z")])).alias("c")).select("column", "label", "c.metric", "c.v")
    wide = cells.groupBy("column", "metric").pivot("label", [0, 1, 2, 3]).agg(F.max("v"))
    return rounded(wide.toDF("column", "metric", "s1", "s2", "s3", "s4"), 4)


# --- whole runs -----------------------------------------------------------------------


@query(ASSIGNED + """, m AS (SELECT label, count(*) AS size, avg(recency) AS recency, avg(frequency) AS frequency, avg(monetary) AS monetary, avg(acctbal) AS acctbal, avg(z0) AS c0, avg(z1) AS c1, avg(z2) AS c2, avg(z3) AS c3 FROM assigned GROUP BY label)
SELECT CAST(label AS INTEGER) AS label, size, round(size / sum(size) OVER (), 6) AS share, round(recency, 4) AS recency, round(frequency, 4) AS frequency, round(monetary, 4) AS monetary, round(acctbal, 4) AS acctbal, round(c0, 5) AS c0, round(c1, 5) AS c1, round(c2, 5) AS c2, round(c3, 5) AS c3 FROM m""")
def rfm_segmentation(spark, sf_dir):
    """The flagship: customers by recency, frequency and money, encoded, assigned to four seeds, profiled, centres moved once."""
    df = rfm_assigned(spark, sf_dir)
    out = df.groupBy("label").agg(F.count("*").alias("size"), *[F.round(F.avg(c), 4).alias(c) for c in PROFILED], *[F.round(F.avg(F.col("features")[j]), 5).alias(f"c{j}") for j in range(4)])
    share = F.round(F.col("size") / F.sum("size").over(Window.partitionBy()), 6)
    return out.select("label", "size", share.alias("share"), *PROFILED, "c0", "c1", "c2", "c3")


def _session(spark, sf_dir, **options):
    """A run over customers; the table of aggregates is the session's input."""
    session = Session(spark)
    table = with_row_id(session.store.keep(rfm_table(spark, sf_dir).orderBy("c_custkey")))  # kept, since its ranges are cut anew in every job
    found = session.load(table, name="customers.csv")
    specs = [s.replace(role="ignore") if s.name == "c_custkey" else s for s in found.specs]
    return session, session.run(specs, RunOptions(**options))


@query()
def kmeans_full(spark, sf_dir):
    _, r = _session(spark, sf_dir, k=4)
    return explain.cluster_sizes(r.labels, r.k).join(r.names, "label")


@query()
def ward_cut(spark, sf_dir):
    _, r = _session(spark, sf_dir, k=4, algorithm="ward")
    return explain.cluster_sizes(r.labels, r.k).join(r.names, "label")


@query()
def k_scan_scores(spark, sf_dir):
    _, r = _session(spark, sf_dir, k_max=6)
    return spark.createDataFrame([(s.k, float(s.inertia), float(s.silhouette), float(s.calinski_harabasz), float(s.davies_bouldin), s.k == r.k) for s in r.scores], "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double, chosen boolean")


@query()
def scatter_sample(spark, sf_dir):
    return _session(spark, sf_dir, k=4)[1].scatter


@query()
def labelled_rows(spark, sf_dir):
    return _session(spark, sf_dir, k=4)[0].labelled()


def _pca(spark, sf_dir, k: int) -> tuple[DataFrame, reduce.Pca]:
    df = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    return df, reduce.fit_pca(df.select("features"), 64, k)


@query()
def pca_explained(spark, sf_dir):
    pca = _pca(spark, sf_dir, 50)[1]
    return spark.createDataFrame([(k, float(v), float(r)) for k, (v, r) in enumerate(zip(pca.variances, pca.ratios, strict=True))], "component int, variance double, ratio double")


@query("SELECT vec_id, round(sum((v - m) * (v - m)), 4) AS squared_norm FROM (SELECT vec_id, j, v, avg(v) OVER (PARTITION BY j) AS m FROM (SELECT vec_id, unnest(range(0, 64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)) GROUP BY vec_id")
def pca_distance_preserved(spark, sf_dir):
    """All components keep every row's distance from the mean."""
    df, pca = _pca(spark, sf_dir, 64)
    return reduce.project(df, pca).select("vec_id", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x), 4).alias("squared_norm"))


@query()
def axis_drivers(spark, sf_dir):
    pca = _pca(spark, sf_dir, 2)[1]
    names = [f"e{j}" for j in range(64)]
    return spark.createDataFrame([(a, k, d) for a in range(2) for k, d in enumerate(reduce.axis_drivers(pca.components[a], names))], "axis int, place int, driver string")


@query("SELECT o_orderkey, o_totalprice AS price, date_diff('day', TIMESTAMP '1970-01-01', o_orderdate)::DOUBLE AS day, o_orderpriority AS priority FROM orders")
def typed_load(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ROW_ID), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("day"), F.col("o_orderpriority").alias("priority"))
    return typed_table(df, [spec("price"), spec("day", "datetime"), spec("priority", "categorical")]).withColumnRenamed(ROW_ID, "o_orderkey")


# --- text files -----------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share."""
    where = shared_dir(spark)
    if not where:
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return f"{where}/{uuid.uuid4().hex}"


ORDER_TEXT = [
    "cast(o_orderkey AS string) AS key",
    "CASE o_orderkey % 3 WHEN 0 THEN '¥' || format_number(o_totalprice, 2) WHEN 1 THEN '(' || format_number(o_totalprice, 2) || ')' ELSE format_string('%.2f', o_totalprice) END AS price",
    "date_format(o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN 'yyyy/M/d' ELSE 'yyyy-MM-dd' END) AS day",
    "CASE o_orderstatus WHEN 'O' THEN 'はい' WHEN 'F' THEN 'いいえ' ELSE '不明' END AS open",
    "'say \"' || o_orderpriority || '\"; ' || o_orderstatus AS note",
]
ORDER_SPECS = [ColumnSpec(k, n, kind, kind, "feature") for k, (n, kind) in enumerate([("key", "numeric"), ("price", "numeric"), ("day", "datetime"), ("open", "boolean"), ("note", "categorical")])]


def _orders_as_text(spark, sf_dir) -> DataFrame:
    """Orders as a shop's export has them: money signs, brackets, mixed dates, words for yes and no, quotes; written and read again."""
    path = _scratch(spark)
    read(spark, sf_dir, "orders").selectExpr(*ORDER_TEXT).write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return read_delimited(spark, path)


@query("""SELECT CAST(o_orderkey AS DOUBLE) AS key, round(CASE WHEN o_orderkey % 3 = 1 THEN -1 ELSE 1 END * round(o_totalprice, 2), 2) AS price, date_diff('day', TIMESTAMP '1970-01-01', date_trunc('day', o_orderdate))::DOUBLE AS day,
CASE o_orderstatus WHEN 'O' THEN 1.0::DOUBLE WHEN 'F' THEN 0.0::DOUBLE END AS open, 'say "' || o_orderpriority || '"; ' || o_orderstatus AS note FROM orders""")
def csv_parse_as(spark, sf_dir):
    """A delimited file, sniffed, read and parsed by kind."""
    typed = typed_table(_orders_as_text(spark, sf_dir), ORDER_SPECS)
    return typed.select("key", F.round("price", 2).alias("price"), "day", "open", "note")


@query("""SELECT o_orderkey % 4 AS part, count(*) AS n, count(DISTINCT o_orderkey) AS keys, count(CASE WHEN o_orderkey % 2 = 0 THEN 1 END) AS labelled FROM orders GROUP BY 1""")
def csv_labelled_export(spark, sf_dir):
    """Labelled rows written as the export does, with its mark and the source's delimiter, and read again: no row lost or doubled."""
    raw = _orders_as_text(spark, sf_dir)
    labels = raw.filter("CAST(key AS LONG) % 2 = 0").select(ROW_ID, F.lit(0).alias("label"))
    path = f"{_scratch(spark)}.csv"
    export.write_labelled(export.labelled_rows(raw, labels, spark.createDataFrame([(0, "even; \"quoted\"")], "label int, name string"), ROW_ID), path, ROW_ID, delimiter=";")
    back = read_delimited(spark, path)
    named = (F.col("segment_id") == "1") & (F.col("segment_name") == 'even; "quoted"')
    return back.groupBy((F.col("key").cast("long") % 4).alias("part")).agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.count_if(named).alias("labelled"))


@query("WITH p AS (SELECT p_partkey, p_name, min(p_partkey) OVER (PARTITION BY p_name) AS first FROM part), c AS (SELECT p_name, row_number() OVER (ORDER BY min(first), p_name) AS code FROM p GROUP BY p_name) SELECT p_partkey, CASE WHEN code <= 50 THEN p.p_name END AS p_name FROM p JOIN c USING (p_name)")
def level_cap(spark, sf_dir):
    """Levels beyond the cap, by first appearance, are missing."""
    return capped_levels(read(spark, sf_dir, "part").select("p_partkey", "p_name"), [spec("p_name", "categorical")], "p_partkey", cap=50)


NOTE_SQL = """CASE WHEN l_orderkey % 50 = 49 THEN 'two' || chr(10) || 'lines, "' || l_returnflag || '"' WHEN l_orderkey % 50 = 48 THEN '"' || chr(13) || chr(10) || '"' WHEN l_orderkey % 50 = 47 THEN chr(10) || ',' || chr(13) || ';' ELSE l_returnflag || l_linestatus END"""


@query(f"SELECT l_orderkey, l_linenumber, {NOTE_SQL} AS note, round(l_extendedprice, 2) AS price FROM lineitem")
def csv_quoted_lines(spark, sf_dir):
    """Lines written as one delimited file a task, the ones with quoted line ends last in each, and read again in splits."""
    last = F.col("l_orderkey") % 50
    note = F.when(last == 49, F.concat(F.lit("two\nlines, \""), "l_returnflag", F.lit('"'))).when(last == 48, F.lit('"\r\n"')).when(last == 47, F.lit("\n,\r;")).otherwise(F.concat("l_returnflag", "l_linestatus"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", note.alias("note"), F.format_string("%.2f", "l_extendedprice").alias("price"))
    path = _scratch(spark)
    rows = rows.sortWithinPartitions(last >= 47, "l_orderkey", "l_linenumber")
    lines = rows.select(export.csv_lines(rows, rows.columns, ",").alias("line"))
    lines.mapInArrow(_with_header("l_orderkey,l_linenumber,note,price"), "line string").write.text(path, lineSep="\n")
    return read_delimited(spark, path).select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"), "note", F.round(F.col("price").cast("double"), 2).alias("price"))


def _with_header(line: str):
    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([line])], names=["line"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["line"])

    return run


# --- over all rows of a large table -----------------------------------------------------

LINE_SPECS = [spec("l_quantity", transform="standard"), spec("l_extendedprice", transform="standard"), spec("l_discount", transform="standard"), spec("l_tax", transform="standard")]


def encoded_lines(spark, sf_dir) -> DataFrame:
    """All lines with a key of their own and four standardised features."""
    lines = read(spark, sf_dir, "lineitem").withColumn("row", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return encode.fit_encoding(lines, LINE_SPECS, "row").encode(lines, "row")


@query()
def kmeans_lines(spark, sf_dir):
    """Seeds by oversampling and Lloyd's iterations over all lines: a row a cluster with its size, inertia and centre."""
    df = encoded_lines(spark, sf_dir).persist()
    try:
        centers = cluster.lloyd(df, cluster.parallel_seeds(df, "row", 6))[0]
        step = cluster.lloyd_step(df, centers)
        rows = [(c, int(step.n[c]), *map(float, centers[c]), step.inertia) for c in cluster.by_size(centers, step.n)]
    finally:
        df.unpersist()
    return rounded(spark.createDataFrame(rows, "seed int, size long, quantity double, price double, discount double, tax double, inertia double"))


@query()
def k_scan_lines(spark, sf_dir):
    """The search of k over all lines, one pass an iteration for all k."""
    df = encoded_lines(spark, sf_dir).persist()
    try:
        scores = evaluate.k_scan_rows(df, "row", range(2, 7))
    finally:
        df.unpersist()
    best = evaluate.choose_k(scores)
    return spark.createDataFrame([(s.k, s.inertia, s.silhouette, s.calinski_harabasz, s.davies_bouldin, s.min_share, s.k == best) for s in scores], "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double, min_share double, chosen boolean")
