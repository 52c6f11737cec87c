"""Every query of the analytics library by name, with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "detector"

#: Width of the windows over the event table, in microseconds.
HOUR = 3_600_000_000


def query(name: str, sql: str | None = None):
    """Registers a query under a name; ``sql`` is the same in DuckDB."""

    def enter(function: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return enter


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to four digits, a little up so that exact halves go the same way in any engine; arrays of plain values as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.round(c + 1e-7, digits) + 0.0
        elif kind.startswith("array<") and "struct" not in kind:
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(name))
    return df.select(*out)


def r(*columns: str, digits: int = 4) -> str:
    """The SQL of :func:`rounded` for these columns."""
    return ", ".join(f"round({c} + 1e-7, {digits}) + 0e0 AS {c}" for c in columns)


#: Common table expressions of the frame projection, its egress side and its one-hour windows.
FRAMES = """
ev AS (SELECT event_id, user_id, epoch_us(ts) AS ts_us, event_type, value, props FROM events),
frames AS (
  SELECT event_id, user_id, ts_us, ts_us // 3600000000 AS bucket, props AS payload,
    CASE WHEN event_type IN ('view', 'purchase') THEN 3 WHEN event_type IN ('click', 'signup') THEN 16 WHEN user_id % 10 = 0 THEN 136 ELSE 16 END AS function_code,
    CASE WHEN event_type = 'error' AND user_id % 25 = 0 THEN 7 ELSE 4 END AS address,
    CASE WHEN event_type = 'signup' THEN 3 ELSE 1 END AS destination,
    CASE WHEN event_type IN ('view', 'purchase') THEN 23 ELSE length(props)::INTEGER END AS frame_len,
    CASE WHEN event_type = 'error' AND user_id % 10 = 0 THEN 5 WHEN event_type = 'view' AND value > 100 THEN 1 ELSE 0 END AS category,
    CASE WHEN event_type IN ('view', 'purchase') THEN value END AS pressure,
    row_number() OVER (ORDER BY ts_us, event_id) AS record_index
  FROM ev),
egress AS (
  SELECT *, -list_sum(list_transform(list_distinct(string_split(payload, '')), lambda x: (len(list_filter(string_split(payload, ''), lambda y: y = x)) / length(payload)::DOUBLE) * log2(len(list_filter(string_split(payload, ''), lambda y: y = x)) / length(payload)::DOUBLE))) AS entropy
  FROM frames WHERE destination = 1)"""


def windows_sql(source: str, name: str) -> str:
    return f"""
{name}_gaps AS (SELECT *, ts_us - lag(ts_us) OVER w AS gap, (payload = lag(payload) OVER w)::INT AS again FROM {source} WINDOW w AS (PARTITION BY bucket ORDER BY ts_us, record_index)),
{name} AS (
  SELECT bucket, count(*)::DOUBLE AS packet_count, count(*) / 3600.0::DOUBLE AS packets_per_sec, sum(frame_len) / 3600.0::DOUBLE AS bytes_per_sec, avg(frame_len) AS mean_frame_len,
    avg(gap) / 1e6 AS iat_mean, coalesce(stddev_pop(gap), 0) / 1e6 AS iat_std, min(gap) / 1e6 AS iat_min, max(gap) / 1e6 AS iat_max,
    avg((function_code IN (3, 16))::INT) AS frac_func_valid, avg((function_code = 3)::INT) AS frac_func_read, avg((function_code = 16)::INT) AS frac_func_write, avg((function_code NOT IN (3, 16))::INT) AS rare_func_rate,
    count(DISTINCT payload) / count(*)::DOUBLE AS distinct_frame_ratio, coalesce(sum(again), 0) / (count(*) - 1)::DOUBLE AS repeat_frame_rate, avg(entropy) AS payload_entropy_mean, coalesce(stddev_pop(entropy), 0) AS payload_entropy_std,
    list_sort(list(DISTINCT category)) AS categories, list_sort(list(DISTINCT function_code)) AS func_codes, list_sort(list(DISTINCT address)) AS addresses, max((category <> 0)::INT) AS is_attack
  FROM {name}_gaps GROUP BY bucket HAVING count(*) >= 2)"""


WINDOWS = FRAMES + "," + windows_sql("egress", "windows")
BLOCKS = WINDOWS + """,
placed AS (SELECT *, row_number() OVER (ORDER BY bucket) - 1 AS position, count(*) OVER () AS n FROM windows),
blocks AS (
  SELECT *, CASE WHEN position < floor(n * 0.6::DOUBLE) - 1 THEN 'train' WHEN position >= floor(n * 0.6::DOUBLE) + 1 AND position < floor(n * 0.8::DOUBLE) - 1 THEN 'validation' WHEN position >= floor(n * 0.8::DOUBLE) + 1 THEN 'test' ELSE 'guard' END AS block
  FROM placed),
normal AS (SELECT * FROM blocks WHERE block = 'train' AND is_attack = 0),
dominated AS (SELECT *, coalesce(list_min(list_filter(categories, lambda c: c <> 0)), 0) AS dominant FROM blocks)"""
#: Readings of the egress side in order.
SERIES = """
series AS (SELECT row_number() OVER (ORDER BY ts_us, record_index) AS position, ts_us, bucket, pressure FROM egress WHERE pressure IS NOT NULL)"""
