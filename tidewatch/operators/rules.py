"""Deterministic rules fitted on normal training windows: fitted state is a table of one row, a hit a struct<fired, reasons>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT = "struct<fired:boolean,reasons:array<string>>"


def significant(x: Column) -> Column:
    """Six significant digits without trailing zeros."""
    text = F.format_string("%.6g", x)
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, r"0+($|e)", "$1"), r"\.($|e)", "$1")).otherwise(text)


def _hit(*reasons: Column) -> Column:
    every = F.filter(F.array(*reasons), lambda r: r.isNotNull())
    return F.struct((F.size(every) > 0).alias("fired"), every.alias("reasons"))


def fit_protocol(normal: DataFrame) -> DataFrame:
    """Function codes and addresses that normal windows hold."""
    union = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_set(c))))
    return normal.agg(union("func_codes").alias("valid_codes"), union("addresses").alias("valid_addresses"))


def finite(column: str | Column) -> Column:
    """A number, null where it is none or not finite."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _needed(value: Column, what: str, needed: bool = True) -> Column:
    """An aggregate; an error if there was nothing to take it of, or null where that is not ``needed``."""
    if not needed:
        return value
    return F.when(value.isNull(), F.raise_error(F.lit(f"no finite value to fit: {what}"))).otherwise(value)


def fit_bounds(normal_values: DataFrame, column: str, *, needed: bool = True) -> DataFrame:
    """Least and largest finite value; where there is none an error, or null unless ``needed``."""
    return normal_values.agg(_needed(F.min(finite(column)), column, needed).alias("low"), F.max(finite(column)).alias("high"))


def fit_rate(normal: DataFrame, column: str = "packets_per_sec") -> DataFrame:
    return fit_bounds(normal, column).select(F.col("high").alias("max_rate"))


def fit_all(normal: DataFrame, rate_column: str = "packets_per_sec") -> DataFrame:
    """The state of all three rules from normal windows with ``p_min`` and ``p_max``, in one pass."""
    return normal.agg(*fit_columns(rate_column))


def fit_columns(rate_column: str = "packets_per_sec", *, needed: bool = True) -> list[Column]:
    """The aggregates of :func:`fit_all`, to be taken with others in one pass.

    Only finite rates and readings count; without a normal window, or without any finite value of one kind, the fit is an
    error: a rule that knows nothing would never fire.  Unless they are ``needed``, what is not known is null, and the rules say so:
    nothing is invalid, novel or outside, and whether the rate fires is null.
    """
    union = lambda c: F.when(F.count(c) > 0, F.sort_array(F.array_distinct(F.flatten(F.collect_set(c)))))
    return [
        union("func_codes").alias("valid_codes"), union("addresses").alias("valid_addresses"), _needed(F.max(finite(rate_column)), rate_column, needed).alias("max_rate"),
        _needed(F.min(finite("p_min")), "p_min", needed).alias("low"), _needed(F.max(finite("p_max")), "p_max", needed).alias("high"),
    ]


def _protocol_hit() -> Column:
    codes, addresses = (F.sort_array(F.array_except(a, b)) for a, b in (("func_codes", "valid_codes"), ("addresses", "valid_addresses")))
    shown = F.array_join(F.transform(codes, lambda c: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c)), 2, "0"))), ",")
    return _hit(F.when(F.size(codes) > 0, F.concat(F.lit("invalid_function_code="), shown)), F.when(F.size(addresses) > 0, F.concat(F.lit("novel_address="), F.array_join(addresses.cast("array<string>"), ","))))


def _bounds_hit() -> Column:
    below = F.when(F.col("p_min") < F.col("low"), F.concat(F.lit("pressure_below_train_normal_min="), significant(F.col("p_min")), F.lit("<"), significant(F.col("low"))))
    above = F.when(F.col("p_max") > F.col("high"), F.concat(F.lit("pressure_above_train_normal_max="), significant(F.col("p_max")), F.lit(">"), significant(F.col("high"))))
    return _hit(below, above)


def _rate_hit(column: str) -> Column:
    hit = _hit(F.when(F.col(column) > F.col("max_rate"), F.concat(F.lit(f"{column}_above_train_normal_max="), significant(F.col(column)), F.lit(">"), significant(F.col("max_rate")))))
    return F.struct(F.when(F.col("max_rate").isNotNull(), hit["fired"]).alias("fired"), hit["reasons"].alias("reasons"))


def protocol(windows: DataFrame, fitted: DataFrame, out: str = "protocol") -> DataFrame:
    """Hits on codes or addresses that the fit hasn't seen."""
    return windows.crossJoin(F.broadcast(fitted)).withColumn(out, _protocol_hit()).drop("valid_codes", "valid_addresses")


def bounds(windows: DataFrame, fitted: DataFrame, out: str = "pressure") -> DataFrame:
    """Hits on windows whose least or largest reading is strictly outside; none where there is no reading."""
    return windows.crossJoin(F.broadcast(fitted)).withColumn(out, _bounds_hit()).drop("low", "high")


def rate(windows: DataFrame, fitted: DataFrame, column: str = "packets_per_sec", out: str = "rate") -> DataFrame:
    """Hits on windows strictly above the largest normal rate."""
    return windows.crossJoin(F.broadcast(fitted)).withColumn(out, _rate_hit(column)).drop("max_rate")


def apply_all(windows: DataFrame, fitted: DataFrame, rate_column: str = "packets_per_sec") -> DataFrame:
    """``windows`` with the hits ``protocol``, ``pressure`` and ``rate`` of a state from :func:`fit_all`."""
    hits = {"protocol": _protocol_hit(), "pressure": _bounds_hit(), "rate": _rate_hit(rate_column)}
    state = ("valid_codes", "valid_addresses", "max_rate", "low", "high")
    return windows.crossJoin(F.broadcast(fitted)).withColumns(hits).drop(*state)


def outside(windows: DataFrame, fitted: DataFrame, out: str = "outside") -> DataFrame:
    """``windows`` with whether a reading lies outside the fitted bounds; null, not false, where there is no reading at all."""
    bounds_ = fitted.select(F.col("low").alias("__low"), F.col("high").alias("__high"))
    known = F.col("p_min").isNotNull() & F.col("p_max").isNotNull()
    rows = windows.crossJoin(F.broadcast(bounds_))  # a table of one row
    return rows.withColumn(out, F.when(known, (F.col("p_min") < F.col("__low")) | (F.col("p_max") > F.col("__high")))).drop("__low", "__high")


def any_of(*hits: str) -> Column:
    """The union of hits: fired if one is, null if none is and one cannot tell, with the reasons of all in order."""
    fired = F.lit(False)
    for h in hits:
        fired = fired | F.when(F.col(h).isNotNull(), F.col(h)["fired"]).otherwise(F.lit(False))
    return F.struct(fired.alias("fired"), F.concat(*[F.coalesce(F.col(h)["reasons"], F.array().cast("array<string>")) for h in hits]).alias("reasons"))


def naive(means: dict[str, str] | None = None) -> Column:
    """The naive baseline on a row with means of normal windows: more than twice or less than half, or invalid codes."""
    means = means or {"iat_mean": "mean_iat_mean", "packets_per_sec": "mean_packets_per_sec", "bytes_per_sec": "mean_bytes_per_sec"}
    out = F.col("frac_func_valid") < 0.99
    for x, m in means.items():
        out = out | (F.col(x) > 2 * F.col(m)) | (F.col(x) < 0.5 * F.col(m))
    return out
