"""Queries of the remaining operators: response types, means, divergences, samples, importances and several classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import number, number_sql
from ..operators import explain, models, ordered, series, windows
from ..sources.frames import CATEGORIES, discovered_types, event_frames, iso_utc, response_types
from .detector import blocked, egress, normal
from .model_plans import _TREES, _X, data
from .registry import BLOCKS, FRAMES, HOUR, query, r, rounded
from .series_plans import CADENCE, cadence, readings


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the parts of a shape: even lengths count as requests, and the source follows the user."""
    return event_frames(spark, sf_dir).withColumn("bucket", windows.bucket("ts_us", 3_600_000_000)).select(
        "record_index", "bucket", "function_code", "destination", F.when(F.col("user_id") % 7 == 0, 1).otherwise(3).alias("source"), (F.col("frame_len") % 2).alias("is_request"), F.col("frame_len").alias("frame_len_bytes"), F.lit(-1).alias("byte_count"), F.lit(0).alias("length_anomaly"),
    )


@query("response_types", f"""WITH {BLOCKS}, sh AS (SELECT record_index, bucket, function_code, destination, CASE WHEN user_id % 7 = 0 THEN 1 ELSE 3 END AS source, frame_len % 2 AS is_request, frame_len FROM frames),
known AS (SELECT DISTINCT function_code, is_request, frame_len FROM sh JOIN normal USING (bucket) WHERE destination = 1 AND source = 3)
SELECT CASE WHEN destination = 1 AND source = 3 THEN k.function_code END AS type, count(*) AS n FROM sh LEFT JOIN known k ON k.function_code = sh.function_code AND k.is_request = sh.is_request AND k.frame_len = sh.frame_len GROUP BY ALL""")
def q_response_types(spark, sf_dir):
    rows = shaped(spark, sf_dir)
    known = discovered_types(rows, normal(blocked(spark, sf_dir)))
    return response_types(rows, known).groupBy("type").agg(F.count("*").alias("n"))


@query("window_means", f"WITH {FRAMES} SELECT bucket, round(avg(frame_len * (1 + category)) + 1e-7, 4) + 0e0 AS mean FROM egress GROUP BY bucket")
def q_means(spark, sf_dir):
    return rounded(windows.means(egress(spark, sf_dir), F.col("frame_len") * (1 + F.col("category"))))


@query("code_divergence", f"""WITH {BLOCKS}, c AS (SELECT bucket, function_code, count(*) AS n FROM egress GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY bucket)::DOUBLE AS p FROM c),
m AS (SELECT function_code, sum(c.n)::DOUBLE AS m FROM c JOIN normal USING (bucket) GROUP BY function_code), q AS (SELECT function_code, m / sum(m) OVER () AS q FROM m),
f AS (SELECT bucket, function_code, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM (SELECT DISTINCT bucket FROM c) b CROSS JOIN (SELECT DISTINCT function_code FROM c) k LEFT JOIN p USING (bucket, function_code) LEFT JOIN q USING (function_code)),
d AS (SELECT bucket, sum(abs(p - q)) AS l1, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS js FROM f GROUP BY bucket)
SELECT bucket, {r('l1', 'js')} FROM d""")
def q_divergence(spark, sf_dir):
    return rounded(windows.code_divergence(egress(spark, sf_dir), normal(blocked(spark, sf_dir))))


@query("cadence_tightening", f"""WITH {CADENCE}, pooled AS (SELECT stddev_pop(gap_us / 1e6) / avg(gap_us / 1e6) AS pooled_cv FROM (SELECT ts_us - lag(ts_us) OVER (PARTITION BY epoch ORDER BY position) AS gap_us FROM epochs WHERE normal) WHERE gap_us > 0),
typed AS (SELECT sum(cv * n) / sum(n) AS weighted_cv FROM base) SELECT {r('pooled_cv', 'weighted_cv', 'ratio')} FROM (SELECT pooled_cv, weighted_cv, weighted_cv / pooled_cv AS ratio FROM pooled, typed)""")
def q_tightening(spark, sf_dir):
    """How much tighter gaps are within types than pooled: ratios of deviation to mean."""
    _, base, _, _ = cadence(spark, sf_dir)
    marks = blocked(spark, sf_dir).select("bucket", ((F.col("block") == "train") & (F.col("is_attack") == 0)).alias("normal"))
    stream = ordered.indexed(egress(spark, sf_dir).where("function_code in (3, 16)").select("ts_us", "record_index", "bucket", F.lit(0).alias("function_code")), "ts_us", "record_index", out="position")
    gaps = series.normal_gaps(stream, marks).withColumn("gap", F.col("gap_us") / 1e6)
    pooled = series.baselines(gaps).agg(F.max("cv").alias("pooled_cv"))  # one row, with or without a gap
    typed = base.agg((F.sum(F.col("cv") * F.col("n")) / F.sum("n")).alias("weighted_cv"))
    return rounded(pooled.crossJoin(typed).withColumn("ratio", F.col("weighted_cv") / F.col("pooled_cv")))


@query("ack_categories", f"WITH {BLOCKS} SELECT array_to_string(categories, ',') AS categories, category, count(*) AS n FROM egress e JOIN blocks b USING (bucket) WHERE e.function_code = 16 GROUP BY ALL")
def q_ack_categories(spark, sf_dir):
    held = blocked(spark, sf_dir).select("bucket", "categories")
    rows = egress(spark, sf_dir).where("function_code = 16").join(held, "bucket")
    return rows.groupBy(F.array_join(F.col("categories").cast("array<string>"), ",").alias("categories"), "category").agg(F.count("*").alias("n"))


@query("alert_times", f"WITH {BLOCKS} SELECT bucket, strftime(make_timestamp(bucket * 3600000000), '%Y-%m-%dT%H:%M:%S+00:00') AS at_utc FROM blocks WHERE is_attack = 1")
def q_times(spark, sf_dir):
    return blocked(spark, sf_dir).where("is_attack = 1").select("bucket", iso_utc(F.col("bucket") * 3_600_000_000).alias("at_utc"))


@query("monotonic_readings", f"WITH {FRAMES} SELECT count(*) AS n FROM egress WHERE pressure IS NOT NULL")
def q_monotonic(spark, sf_dir):
    return ordered.assert_monotonic(readings(spark, sf_dir), "position", "ts_us").agg(F.count("*").alias("n"))


@query("seeded_sample", f"WITH {BLOCKS} SELECT bucket FROM normal ORDER BY {number_sql('42', 'bucket')}, bucket LIMIT 50")
def q_sample(spark, sf_dir):
    """At most 50 normal windows, the same for the same seed: a sampling operator."""
    return normal(blocked(spark, sf_dir)).orderBy(number(42, "bucket"), "bucket").limit(50).select("bucket")


_UNTIL = ("packets_per_sec", "mean_frame_len", "payload_entropy_mean")


@query("windows_until", f"WITH {BLOCKS} SELECT bucket, {r(*_UNTIL)} FROM blocks WHERE bucket <= (SELECT max(bucket) FROM blocks WHERE block = 'train')")
def q_until(spark, sf_dir):
    """The windows up to the last one of the training block, from the frames up to its end alone."""
    last = blocked(spark, sf_dir).where("block = 'train'").agg(F.max("bucket")).first()[0]
    rows = egress(spark, sf_dir).drop("bucket")
    own = windows.until(rows, last, HOUR) if last is not None else rows.limit(0)
    return rounded(windows.feature_windows(own, HOUR).select("bucket", *_UNTIL))


@query("forest_grid")
def q_grid(spark, sf_dir):
    """Confusion on the validation block of forests of every depth and least leaf."""
    rows = data(spark, sf_dir)
    return models.forest_grid(rows.where("block = 'train'"), rows.where("block = 'validation'"), _X, "label", trees=_TREES)


@query("feature_importances")
def q_importances(spark, sf_dir):
    model = models.random_forest(data(spark, sf_dir).where("block = 'train'"), _X, "label", trees=_TREES, depth=8)
    notes = spark.createDataFrame([("iat_mean", "causal"), ("packet_count", "causal")], "feature string, note string")
    return explain.importances(list(zip(_X, model.featureImportances.toArray().tolist(), strict=True)), spark, notes)


@query("multiclass_forest")
def q_multiclass(spark, sf_dir):
    """The dominant category of test windows by a forest over categories."""
    rows = blocked(spark, sf_dir).withColumn("label", windows.dominant("categories").cast("double")).select("bucket", "block", "label", *_X)
    model = models.multiclass_forest(rows.where("block = 'train'"), _X, "label", trees=_TREES, depth=8)
    names = F.create_map(*[F.lit(x) for k, v in CATEGORIES.items() for x in (float(k), v)])
    out = model.transform(models.assembled(rows.where("block = 'test'"), _X))
    return out.select("bucket", F.element_at(names, F.col("label")).alias("category"), F.element_at(names, F.col("prediction")).alias("predicted"))
