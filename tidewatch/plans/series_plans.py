"""Queries over ordered series: gaps, cadence, rates, residuals, robust scores, lags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered, series, windows
from ..sources.frames import event_frames
from ..sources.scratch import written
from .detector import blocked, egress
from .registry import BLOCKS, HOUR, SERIES, query, r, rounded


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(_readings(spark, sf_dir), "readings")


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_frames(spark, sf_dir).where("destination = 1 and pressure is not null").select("ts_us", "record_index", windows.bucket("ts_us", HOUR).alias("bucket"), "pressure")
    return ordered.indexed(rows, "ts_us", "record_index", out="position").drop("record_index")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings with ``normal``: their window is a normal one of the training block."""
    b = blocked(spark, sf_dir).select("bucket", (F.coalesce((F.col("block") == "train") & (F.col("is_attack") == 0), F.lit(False))).alias("normal"))
    return written(_readings(spark, sf_dir).join(b, "bucket", "left").withColumn("normal", F.coalesce("normal", F.lit(False))), "labelled")


LABELLED = BLOCKS + "," + SERIES + """,
marked AS (SELECT s.*, coalesce(b.block = 'train' AND b.is_attack = 0, FALSE) AS normal FROM series s LEFT JOIN blocks b USING (bucket))"""

CADENCE = BLOCKS + """,
streamed AS (SELECT row_number() OVER (ORDER BY ts_us, record_index) AS position, ts_us, bucket, function_code FROM egress WHERE function_code IN (3, 16)),
pre AS (SELECT s.*, block, coalesce(block = 'train' AND is_attack = 0, FALSE) AS normal FROM streamed s LEFT JOIN blocks USING (bucket)),
epochs AS (SELECT *, sum((NOT normal)::INT) OVER (ORDER BY position) AS epoch FROM pre),
normal_gaps AS (SELECT function_code, bucket, gap_us FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY epoch, function_code ORDER BY position) AS gap_us FROM epochs WHERE normal) WHERE gap_us > 0),
base AS (SELECT function_code, count(*) AS n, avg(gap_us / 1e6) AS expected, median(gap_us / 1e6) AS median, stddev_pop(gap_us / 1e6) AS std, stddev_pop(gap_us / 1e6) / avg(gap_us / 1e6) AS cv, greatest(stddev_pop(gap_us / 1e6), 1e-6, 0.01 * avg(gap_us / 1e6)) AS scale FROM normal_gaps GROUP BY function_code),
gaps AS (SELECT s.*, (ts_us - lag(ts_us) OVER (PARTITION BY function_code ORDER BY position)) / 1e6 AS raw_gap FROM pre s WHERE block IN ('train', 'validation')),
events_ AS (SELECT g.*, CASE WHEN raw_gap > 0 THEN raw_gap END AS gap, expected, scale FROM gaps g JOIN base USING (function_code)),
valued AS (SELECT *, gap - expected AS deviation, CASE WHEN gap IS NOT NULL THEN greatest(0, gap - expected) END AS positive_deviation, CASE WHEN gap IS NOT NULL THEN greatest(0, gap - expected) / scale END AS positive_z, CASE WHEN gap IS NOT NULL THEN greatest(0, round_even(gap / expected, 0) - 1) END AS missed_cycles FROM events_),
summed AS (SELECT *, coalesce(sum(positive_z - 0.5) OVER (PARTITION BY function_code ORDER BY position), 0) AS total FROM valued),
states AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY function_code ORDER BY position)) AS cusum FROM summed),
train_normal AS (SELECT bucket FROM blocks WHERE block = 'train' AND is_attack = 0),
most AS (SELECT b.bucket, k.function_code, coalesce(max(cusum), 0) AS most FROM train_normal b CROSS JOIN (SELECT DISTINCT function_code FROM states) k LEFT JOIN states s ON s.bucket = b.bucket AND s.function_code = k.function_code GROUP BY b.bucket, k.function_code),
limits AS (SELECT function_code, greatest(0.5, max(most) FILTER (spot = ceil((n - 1) * 0.99))) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY function_code ORDER BY most) - 1 AS spot, count(*) OVER (PARTITION BY function_code) AS n FROM most) GROUP BY function_code)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Egress frames of the two regular types in order."""
    rows = event_frames(spark, sf_dir).where("destination = 1 and function_code in (3, 16)")
    rows = rows.select("ts_us", "record_index", windows.bucket("ts_us", HOUR).alias("bucket"), "function_code")
    return written(ordered.indexed(rows, "ts_us", "record_index", out="position"), "responses")


def cadence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(blocks, baselines, events with their state, thresholds)."""
    b = blocked(spark, sf_dir)
    marks = b.select("bucket", "block", ((F.col("block") == "train") & (F.col("is_attack") == 0)).alias("normal"))
    stream = responses(spark, sf_dir)
    gaps = series.normal_gaps(stream, marks.select("bucket", "normal")).withColumn("gap", F.col("gap_us") / 1e6)
    base = series.baselines(written(gaps, "gaps"))
    events = written(series.cusum(stream.join(marks.where("block in ('train', 'validation')").select("bucket", "block"), "bucket"), base), "cusum")
    limits = series.cusum_thresholds(events.where("block = 'train'"), marks.where("normal"))
    return b, base, events, limits


@query("cadence_baselines", f"WITH {CADENCE} SELECT function_code, n, {r('expected', 'median', 'std', 'cv', 'scale')} FROM base")
def q_baselines(spark, sf_dir):
    return rounded(cadence(spark, sf_dir)[1])


@query("cusum_states", f"WITH {CADENCE} SELECT function_code, position, {r('gap', 'deviation', 'positive_z', 'missed_cycles', 'cusum')} FROM states")
def q_cusum(spark, sf_dir):
    return rounded(cadence(spark, sf_dir)[2].select("function_code", F.col("position").cast("long").alias("position"), "gap", "deviation", "positive_z", "missed_cycles", "cusum"))


@query("cusum_thresholds", f"WITH {CADENCE} SELECT function_code, {r('threshold')} FROM limits")
def q_thresholds(spark, sf_dir):
    return rounded(cadence(spark, sf_dir)[3])


_TYPED = ("event_count", "iat_count", "iat_mean", "iat_std", "iat_max", "deviation_mean", "positive_z_max", "missed_cycles_sum", "cusum_end", "cusum_max", "cusum_alarm_count")


def _typed_sql(code: int) -> str:
    at = f"FILTER (s.function_code = {code})"
    exprs = {
        "event_count": f"count(s.position) {at}::DOUBLE", "iat_count": f"count(gap) {at}::DOUBLE", "iat_mean": f"avg(gap) {at}", "iat_std": f"stddev_pop(gap) {at}", "iat_max": f"max(gap) {at}", "deviation_mean": f"avg(deviation) {at}",
        "positive_z_max": f"max(positive_z) {at}", "missed_cycles_sum": f"sum(missed_cycles) {at}", "cusum_end": f"arg_max(cusum, s.position) {at}", "cusum_max": f"max(cusum) {at}", "cusum_alarm_count": f"sum((gap IS NOT NULL AND cusum >= threshold)::INT) {at}::DOUBLE",
    }
    return ", ".join(f"round(coalesce({x}, 0) + 1e-7, 4) + 0e0 AS func_{code:02x}_{n}" for n, x in exprs.items())


@query("cadence_windows", f"WITH {CADENCE} SELECT b.bucket, {_typed_sql(3)}, {_typed_sql(16)}, ((count(s.position) FILTER (s.function_code = 3) > 0)::INT + (count(s.position) FILTER (s.function_code = 16) > 0)::INT)::DOUBLE AS active_type_count FROM blocks b LEFT JOIN states s USING (bucket) LEFT JOIN limits l ON l.function_code = s.function_code WHERE b.block IN ('train', 'validation') GROUP BY b.bucket")
def q_cadence(spark, sf_dir):
    b, _, events, limits = cadence(spark, sf_dir)
    out = series.cadence_windows(events.drop("block"), limits, b.where("block in ('train', 'validation')").select("bucket"))
    return rounded(out.select("bucket", *[f"func_{c}_{n}" for c in ("03", "10") for n in _TYPED], "active_type_count"))


_RESET = CADENCE.replace("WITH ", "") + """,
seq AS (SELECT s.function_code, s.block AS segment, s.position, s.ts_us, (s.ts_us - lag(s.ts_us) OVER w) / 1e6 AS gap, s.expected, s.scale, threshold, row_number() OVER w AS k FROM states s JOIN limits USING (function_code) WINDOW w AS (PARTITION BY s.function_code, s.block ORDER BY s.position)),
zed AS (SELECT *, CASE WHEN gap > 0 THEN greatest(0, gap - expected) / scale - 0.5 END AS push FROM seq),
run AS (SELECT function_code, segment, position, ts_us, k, 0.0::DOUBLE AS cusum, 0.0::DOUBLE AS alarm, 0.0::DOUBLE AS cusum_end FROM zed WHERE k = 1
  UNION ALL SELECT z.function_code, z.segment, z.position, z.ts_us, z.k, CASE WHEN push IS NULL THEN cusum_end ELSE greatest(0, cusum_end + push) END,
    (push IS NOT NULL AND greatest(0, cusum_end + push) >= threshold - 1e-9)::INT::DOUBLE, CASE WHEN push IS NULL THEN cusum_end WHEN greatest(0, cusum_end + push) >= threshold - 1e-9 THEN 0 ELSE greatest(0, cusum_end + push) END
  FROM run r JOIN zed z ON z.function_code = r.function_code AND z.segment = r.segment AND z.k = r.k + 1)"""


@query("cusum_with_reset", f"WITH RECURSIVE {_RESET} SELECT function_code, segment, position, ts_us, {r('cusum', 'cusum_end')}, alarm FROM run")
def q_reset(spark, sf_dir):
    _, base, events, limits = cadence(spark, sf_dir)
    rows = events.select("function_code", F.col("position").cast("long").alias("position"), "ts_us", F.col("block").alias("segment"))
    return rounded(series.cusum_reset(rows, base, limits))


@query("pressure_ranges", f"WITH {BLOCKS} SELECT bucket, min(pressure) AS p_min, max(pressure) AS p_max, count(*) AS p_count FROM egress WHERE pressure IS NOT NULL GROUP BY bucket")
def q_ranges(spark, sf_dir):
    return windows.pressure_range(egress(spark, sf_dir).drop("bucket"), HOUR)


@query("pressure_features", f"""WITH {LABELLED}, base AS (SELECT 3 AS function_code, avg(pressure) AS mean FROM marked WHERE normal),
changes AS (SELECT *, pressure - lag(pressure) OVER (PARTITION BY bucket ORDER BY position) AS change FROM series),
got AS (SELECT bucket, arg_max(pressure, position) AS last, avg(pressure) AS average, min(pressure) AS least, max(pressure) AS most, max(abs(pressure - mean)) AS deviation_max, arg_max(coalesce(change, 0), position) AS change_last FROM changes, base GROUP BY bucket),
every AS (SELECT b.bucket, function_code, coalesce(last, mean) AS last, coalesce(average, mean) AS average, coalesce(least, mean) AS least, coalesce(most, mean) AS most, coalesce(deviation_max, 0) AS deviation_max, abs(coalesce(last, mean) - mean) AS deviation_last, coalesce(change_last, 0) AS change_last, (last IS NOT NULL)::INT AS available FROM blocks b CROSS JOIN base LEFT JOIN got USING (bucket))
SELECT bucket, function_code, {r('last', 'average', 'least', 'most', 'deviation_max', 'deviation_last', 'change_last')}, available FROM every""")
def q_pressure(spark, sf_dir):
    base = labelled(spark, sf_dir).where("normal").agg(F.avg("pressure").alias("mean")).select(F.lit(3).alias("function_code"), "mean")
    rows = egress(spark, sf_dir).where("pressure is not null").withColumn("function_code", F.lit(3)).drop("bucket")
    return rounded(windows.pressure_features(rows, blocked(spark, sf_dir), base, HOUR))


@query("native_windows", f"""WITH {BLOCKS}, kept AS (SELECT bucket // 3 AS wide, block FROM blocks WHERE block <> 'guard' GROUP BY ALL HAVING count(DISTINCT bucket) = 3),
rows_ AS (SELECT bucket // 3 AS wide, pressure, abs(pressure - lag(pressure) OVER (PARTITION BY bucket // 3 ORDER BY ts_us, record_index)) AS step, (ts_us - (bucket // 3) * 10800000000) / 1e6 AS t FROM egress WHERE pressure IS NOT NULL),
got AS (SELECT wide, count(*) AS n, avg(pressure) AS mean, CASE WHEN count(*) >= 2 THEN stddev_pop(pressure) END AS std, CASE WHEN count(*) >= 2 THEN max(pressure) - min(pressure) END AS range, max(step) AS step_max, CASE WHEN count(*) >= 2 THEN coalesce(abs(regr_slope(pressure, t)), 0) END AS slope FROM rows_ GROUP BY wide),
every AS (SELECT g.*, block, CASE WHEN g.n >= 2 THEN abs(g.mean - p.mean) END AS mean_shift FROM kept JOIN got g USING (wide) LEFT JOIN got p ON p.wide = g.wide - 1)
SELECT wide, block, n, {r('mean', 'std', 'range', 'step_max', 'mean_shift')}, round(slope + 1e-9, 6) + 0e0 AS slope FROM every""")
def q_native(spark, sf_dir):
    out = windows.native_windows(egress(spark, sf_dir).drop("bucket"), blocked(spark, sf_dir), HOUR, 3)
    return rounded(out.drop("slope")).join(out.select("wide", (F.round(F.col("slope") + 1e-9, 6) + 0.0).alias("slope")), "wide")


STEPS = LABELLED + """,
pairs AS (SELECT *, lag(pressure) OVER (ORDER BY position) AS p_before, lag(ts_us) OVER (ORDER BY position) AS ts_before, lag(bucket) OVER (ORDER BY position) AS bucket_before, lag(normal) OVER (ORDER BY position) AS normal_before FROM marked),
rates AS (SELECT *, abs(pressure - p_before) / ((ts_us - ts_before) / 1e6) AS rate FROM pairs WHERE ts_us > ts_before)"""


@query("step_rates", f"WITH {STEPS} SELECT bucket, round(max(rate) + 1e-9, 6) + 0e0 AS rate_max, count(*) AS pairs FROM rates GROUP BY bucket")
def q_steps(spark, sf_dir):
    out = series.largest_rates(series.step_rates(readings(spark, sf_dir)))
    return out.select("bucket", (F.round(F.col("rate_max") + 1e-9, 6) + 0.0).alias("rate_max"), "pairs")


@query("gated_rates", f"WITH {STEPS}, bounds AS (SELECT quantile_cont(pressure, 0.05) AS low, quantile_cont(pressure, 0.95) AS high FROM marked WHERE normal), g AS (SELECT * FROM rates, bounds WHERE p_before BETWEEN low AND high) SELECT bucket, round(max(rate) + 1e-9, 6) + 0e0 AS rate_max, count(*) AS pairs, arg_max(bucket_before, (rate, -position)) AS source FROM g GROUP BY bucket")
def q_gated(spark, sf_dir):
    bounds = labelled(spark, sf_dir).where("normal").agg(F.percentile("pressure", F.lit(0.05)).alias("low"), F.percentile("pressure", F.lit(0.95)).alias("high"))
    out = series.largest_rates(series.step_rates(readings(spark, sf_dir)), bounds)
    return out.select("bucket", (F.round(F.col("rate_max") + 1e-9, 6) + 0.0).alias("rate_max"), "pairs", "source")


AR = STEPS + """,
mu AS (SELECT avg(pressure) AS mu FROM marked WHERE normal),
centred AS (SELECT p.*, pressure - mu AS c, p_before - mu AS c_before, normal AND coalesce(normal_before, FALSE) AS normal_pair FROM pairs p, mu),
phi AS (SELECT sum(c * c_before) FILTER (normal_pair) / sum(c_before * c_before) FILTER (normal_pair) AS phi FROM centred),
residuals AS (SELECT *, c - phi * c_before AS residual FROM centred, phi),
fit AS (SELECT any_value(mu) AS mu, any_value(phi) AS phi, stddev_pop(residual) FILTER (normal_pair) AS sigma, sum(normal_pair::INT)::BIGINT AS pairs FROM residuals, mu),
z2 AS (SELECT r.*, (residual / sigma) ** 2 AS z2 FROM residuals r, fit),
rolled AS (SELECT *, count(z2) OVER w = 15 AS whole, avg(z2) OVER w AS e, min(normal::INT) OVER w AS all_normal FROM z2 WINDOW w AS (ORDER BY position ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
energy AS (SELECT bucket, arg_max(CASE WHEN whole THEN e ELSE -1 END, position) AS energy, arg_max(whole AND all_normal = 1, position) AS calibrates FROM rolled GROUP BY bucket)"""


@query("autoregression", f"WITH {AR} SELECT {r('mu', 'phi', 'sigma')}, pairs FROM fit")
def q_ar(spark, sf_dir):
    return rounded(series.autoregression(labelled(spark, sf_dir))[0])


@query("rolling_energy", f"WITH {AR} SELECT bucket, {r('energy')}, calibrates FROM energy WHERE energy >= 0")
def q_energy(spark, sf_dir):
    return rounded(series.rolling_energy(series.autoregression(labelled(spark, sf_dir))[1]))


@query("robust_z", f"WITH {LABELLED}, w AS (SELECT *, list(pressure) OVER (ORDER BY position ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS past FROM series), m AS (SELECT *, list_median(past) AS med FROM w WHERE len(past) = 5), z AS (SELECT bucket, abs((pressure - med) / (list_median(list_transform(past, lambda x: abs(x - med))) + 1e-6)) AS z FROM m) SELECT bucket, round(max(z) + 1e-7, 3) + 0e0 AS z_max FROM z GROUP BY bucket")
def q_robust(spark, sf_dir):
    z = series.robust_z(readings(spark, sf_dir), 5)
    return z.where("z is not null").groupBy("bucket").agg((F.round(F.max(F.abs("z")) + 1e-7, 3) + 0.0).alias("z_max"))


_LAGS = [f"lag_{i}" for i in range(1, 6)]


@query("lag_features", f"WITH {BLOCKS}, l AS (SELECT bucket, block, {', '.join(f'lag(packet_count, {i}) OVER w AS lag_{i}' for i in range(1, 6))}, var_pop(packet_count) OVER (PARTITION BY block ORDER BY bucket ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS variance FROM blocks WINDOW w AS (PARTITION BY block ORDER BY bucket)), f AS (SELECT *, (-2 * lag_5 - lag_4 + lag_2 + 2 * lag_1) / 10 AS slope FROM l WHERE lag_5 IS NOT NULL) SELECT bucket, block, {r(*_LAGS, 'slope', 'variance')}, sign(slope)::DOUBLE AS direction FROM f")
def q_lags(spark, sf_dir):
    out = series.lags(blocked(spark, sf_dir), "packet_count", index="bucket")
    return rounded(out.select("bucket", "block", *_LAGS, "slope", "variance")).join(out.select("bucket", "direction"), "bucket")


def distribution_sql(low: str, high: str) -> str:
    """Common table expressions of the distribution features of each bucket's trailing buffer, its histogram over [low, high]."""
    return f"""
w AS (SELECT bucket, position, list(pressure) OVER (ORDER BY position ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS buffer FROM series),
b AS (SELECT bucket, arg_max(buffer, position) AS buffer FROM w GROUP BY bucket),
x AS (SELECT bucket, unnest(buffer) AS v FROM b),
s AS (SELECT bucket, count(*) AS n, {', '.join(f"quantile_cont(v, {p / 100}) AS q{p:02d}" for p in (1, 5, 10, 25, 50, 75, 90, 95, 99))}, avg(v) AS mean, count(DISTINCT v)::DOUBLE AS unique_count, 1 - count(DISTINCT v) / count(*)::DOUBLE AS repetition_rate, kurtosis_pop(v) AS kurtosis FROM x GROUP BY bucket),
m AS (SELECT x.bucket, avg((v - mean) ** 2) AS m2, avg((v - mean) ** 3) AS m3, avg((v - mean) ** 4) AS m4 FROM x JOIN s USING (bucket) GROUP BY x.bucket),
h AS (SELECT bucket, least(floor((v - {low}) / ({high} - {low}) * 10), 9) AS slot, count(*) AS k FROM x WHERE v BETWEEN {low} AND {high} GROUP BY ALL),
e AS (SELECT bucket, -sum(k / t::DOUBLE * log2(k / t::DOUBLE)) AS entropy, count(*) / 10.0::DOUBLE AS histogram_occupancy FROM (SELECT *, sum(k) OVER (PARTITION BY bucket) AS t FROM h) GROUP BY bucket),
g AS (SELECT bucket, coalesce(max(hole), 0) AS max_gap FROM (SELECT bucket, v - lag(v) OVER (PARTITION BY bucket ORDER BY v) AS hole FROM (SELECT DISTINCT bucket, v FROM x)) GROUP BY bucket),
every AS (SELECT s.*, q90 - q10 AS iqr_10_90, q75 - q25 AS iqr_25_75, CASE WHEN n >= 3 AND m2 > 0 THEN m3 / m2 ** 1.5 ELSE 0 END AS skewness, CASE WHEN n >= 4 AND m2 > 0 THEN m4 / m2 ** 2 - 3 ELSE 0 END AS kurt, abs(coalesce(entropy, 0)) AS entropy, coalesce(histogram_occupancy, 0) AS histogram_occupancy, max_gap FROM s JOIN m USING (bucket) LEFT JOIN e USING (bucket) JOIN g USING (bucket))"""


DISTRIBUTION = ("q01", "q05", "q10", "q25", "q50", "q75", "q90", "q95", "q99", "iqr_10_90", "iqr_25_75", "skewness", "unique_count", "repetition_rate", "entropy", "histogram_occupancy", "max_gap")


@query("trailing_distribution", f"WITH {LABELLED}, {distribution_sql('0.0', '500.0')} SELECT bucket, {r(*DISTRIBUTION)}, round(kurt + 1e-7, 4) + 0e0 AS kurtosis FROM every")
def q_trailing(spark, sf_dir):
    return rounded(series.distribution(series.trailing(readings(spark, sf_dir)), 0.0, 500.0).drop("buffer", "wasserstein"))


#: Distances of trailing buffers to the normal readings.
WASSERSTEIN = """
sample AS (SELECT pressure AS v FROM marked WHERE normal),
grid AS (SELECT bucket, v, 1 / count(*) OVER (PARTITION BY bucket)::DOUBLE AS own, 0.0::DOUBLE AS other FROM x UNION ALL SELECT bucket, v, 0, 1 / (SELECT count(*) FROM sample)::DOUBLE FROM (SELECT DISTINCT bucket FROM x), sample),
steps AS (SELECT bucket, abs(sum(own) OVER o - sum(other) OVER o) * (lead(v) OVER o - v) AS area FROM grid WINDOW o AS (PARTITION BY bucket ORDER BY v)),
wasser AS (SELECT bucket, sum(area) AS wasserstein FROM steps GROUP BY bucket)"""
#: Readings of the sample that window_rows compares with, and the same distances to it: those lowest by a hash of their place that any engine has.
SAMPLE = 500
SAMPLED_WASSERSTEIN = WASSERSTEIN.replace("WHERE normal)", f"WHERE normal ORDER BY md5(position::VARCHAR), position LIMIT {SAMPLE})")


def normal_sample(rows: DataFrame) -> list[float]:
    """At most :data:`SAMPLE` normal readings."""
    return [x[0] for x in rows.where("normal").orderBy(F.md5(F.col("position").cast("string").cast("binary")), "position").select("pressure").limit(SAMPLE).collect()]


@query("wasserstein_to_normal", f"WITH {LABELLED}, {distribution_sql('0.0', '500.0')}, {WASSERSTEIN} SELECT bucket, {r('wasserstein')} FROM wasser")
def q_wasserstein(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return rounded(series.wasserstein(series.trailing(rows), rows.where("normal")))


@query("last_per_bucket", f"WITH {LABELLED} SELECT bucket, arg_min(pressure, position) AS first, arg_max(pressure, position) AS last FROM series GROUP BY bucket")
def q_last(spark, sf_dir):
    return series.last_first(readings(spark, sf_dir))
