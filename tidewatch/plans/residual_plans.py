"""Queries of full window rows, residual attacks, probes of feature families, held-out runs and folds with refits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, evaluate, models, probes, rules, series, splits, windows
from ..sources.scratch import scratch, written
from .detector import RULES, blocked, ruled
from .registry import query, r, rounded
from .series_plans import CADENCE, LABELLED, SAMPLED_WASSERSTEIN, distribution_sql, labelled, normal_sample, responses

F1, F2, F3 = (series.ROW_FEATURES[f] for f in ("F1", "F2", "F3"))
#: The attack whose residual windows the probes look at.
CATEGORY = 1


def _bits(x: str, name: str, source: str) -> str:
    """SQL of the parts of a double: exponent e and the 52 bits m."""
    return f"""
{name}_e AS (SELECT *, floor(log2({x}))::INTEGER AS e0 FROM {source}),
{name}_f AS (SELECT *, CASE WHEN {x} < 2.0::DOUBLE ** e0 THEN e0 - 1 WHEN {x} >= 2.0::DOUBLE ** (e0 + 1) THEN e0 + 1 ELSE e0 END AS e FROM {name}_e),
{name} AS (SELECT *, (({x} / 2.0::DOUBLE ** e - 1) * 4503599627370496)::BIGINT AS m FROM {name}_f)"""


def _grid(steps: list[float]) -> str:
    parts = ", ".join(f"abs(x / {s}::DOUBLE - round_even(x / {s}::DOUBLE, 0)) * {s}::DOUBLE" for s in steps)
    return f"least({parts})"


FLOATS = f"""
tail AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY position DESC) AS back FROM (SELECT *, lag(pressure) OVER (ORDER BY position) AS p_before, lag(ts_us) OVER (ORDER BY position) AS ts_before, list(pressure) OVER (ORDER BY position ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS trail FROM marked)),
ends AS (SELECT bucket, pressure AS x, coalesce(abs(pressure - p_before), 0) AS abs_delta_predecessor, CASE WHEN ts_us > ts_before THEN abs(pressure - p_before) / ((ts_us - ts_before) / 1e6) ELSE 0 END AS step_rate, trail FROM tail WHERE back = 1),
{_bits('x', 'parts', 'ends').strip()},
{_bits('v', 'trails', '(SELECT bucket, len(trail) AS size, unnest(trail) AS v FROM ends)').strip()},
lows AS (SELECT bucket, size, m & 255 AS low, count(*) AS k FROM trails GROUP BY ALL),
entropies AS (SELECT bucket, CASE WHEN any_value(size) >= 2 THEN abs(-sum(k / size::DOUBLE * log2(k / size::DOUBLE))) ELSE 0 END AS mantissa_entropy_local FROM lows GROUP BY bucket),
near AS (SELECT bucket, min(abs(x - v)) AS ulp_distance_to_train_normal FROM ends CROSS JOIN (SELECT DISTINCT pressure AS v FROM marked WHERE normal) GROUP BY bucket),
floats AS (SELECT bucket, x AS last_pressure, abs_delta_predecessor, step_rate, (e + 1023)::DOUBLE AS exponent, (m & 255)::DOUBLE AS mantissa_low_bits, (CASE WHEN m = 0 THEN 52 ELSE bit_count((m & -m) - 1) END)::DOUBLE AS trailing_zero_bits, ulp_distance_to_train_normal, {_grid(series.QUANTIZATION_STEPS)} AS quantization_distance, {_grid(series.LATTICE_STEPS)} AS adc_lattice_distance, mantissa_entropy_local FROM parts LEFT JOIN near USING (bucket) JOIN entropies USING (bucket))"""


@query("float_rows", f"WITH {LABELLED}, {FLOATS} SELECT bucket, {r(*F1, *F2)} FROM floats")
def q_float_rows(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return rounded(series.float_rows(rows, rows.where("normal")).drop("buffer"))


@query("mantissa_entropy", f"WITH {LABELLED}, {FLOATS} SELECT bucket, round(mantissa_entropy_local + 1e-7, 4) + 0e0 AS entropy FROM floats")
def q_mantissa(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return rounded(series.float_rows(rows, rows.where("normal")).select("bucket", F.col("mantissa_entropy_local").alias("entropy")))


_RANGE = "(SELECT {f}(pressure) FROM marked WHERE normal)"


@query("window_rows", f"WITH {LABELLED}, {distribution_sql(_RANGE.format(f='min'), _RANGE.format(f='max'))}, {SAMPLED_WASSERSTEIN}, {FLOATS} SELECT bucket, {r(*F1, *F2, *[c for c in F3 if c not in ('kurtosis', 'wasserstein_to_train_normal')])}, round(kurt + 1e-7, 4) + 0e0 AS kurtosis, round(wasserstein + 1e-7, 4) + 0e0 AS wasserstein_to_train_normal FROM floats JOIN every USING (bucket) JOIN wasser USING (bucket)")
def q_window_rows(spark, sf_dir):
    return rounded(full_rows(spark, sf_dir, sampled=True))


def full_rows(spark: SparkSession, sf_dir: str, *, sampled: bool = False) -> DataFrame:
    """The full row of every window with a reading, against all normal readings, or for ``window_rows`` against its SQL's sample."""
    rows = labelled(spark, sf_dir)
    normal = rows.where("normal")
    low, high = normal.agg(F.min("pressure"), F.max("pressure")).first()
    return series.window_rows(rows, normal, low, high, normal_sample(rows) if sampled else None)


@query("pressure_proxy", f"WITH {RULES} SELECT bucket, CASE WHEN p_min IS NOT NULL THEN p_min < low OR p_max > high END AS outside FROM ruled")
def q_proxy(spark, sf_dir):
    return proxied(spark, sf_dir).select("bucket", "outside")


def proxied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows with their readings' range and whether the pressure bounds alone would fire; null without a reading."""
    rows = blocked(spark, sf_dir, windows.readings())
    fitted = rules.fit_bounds(rows.where("block = 'train' and is_attack = 0").select(F.explode(F.array("p_min", "p_max")).alias("p")), "p", needed=False)
    return rules.outside(rows, fitted)


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with the label of the residual cohort: the attack alone, defined and missed by the bounds, against pure Normal."""
    return probes.residual(proxied(spark, sf_dir), CATEGORY, ~F.col("outside"), F.col("outside").isNotNull())


@query("residual_cohorts", f"""WITH {RULES}, o AS (SELECT block, categories, CASE WHEN p_min IS NOT NULL THEN p_min < low OR p_max > high END AS outside FROM ruled)
SELECT block, count(*) FILTER (outside = FALSE AND list_contains(categories, {CATEGORY}) AND len(list_filter(categories, lambda c: c NOT IN (0, {CATEGORY}))) = 0) AS n_residual, count(*) FILTER (outside IS NOT NULL AND categories = [0]) AS n_normal, count(*) FILTER (outside IS NULL) AS n_undefined FROM o GROUP BY block""")
def q_residual(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    return rows.groupBy("block").agg(F.count_if(F.col("label") == 1).alias("n_residual"), F.count_if(F.col("label") == 0).alias("n_normal"), F.count_if(F.col("outside").isNull()).alias("n_undefined"))


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The residual cohort with its full rows."""
    return written(cohort(spark, sf_dir).select("bucket", "block", "label").join(full_rows(spark, sf_dir), "bucket"), "probed")


@query("family_probe")
def q_family(spark, sf_dir):
    """Each family's model against its permuted null, with its interval and its single test."""
    return probes.family_probe(probed(spark, sf_dir), series.ROW_FEATURES)


@query("family_verdict")
def q_verdict(spark, sf_dir):
    """Which detectors the probes speak for."""
    family_of = {f: name for name in ("F1", "F2", "F3") for f in series.ROW_FEATURES[name]}
    return probes.family_verdict(q_family(spark, sf_dir), family_of)


@query("residual_runs", f"""WITH {RULES}, o AS (SELECT bucket, block, categories, CASE WHEN p_min IS NOT NULL THEN p_min < low OR p_max > high END AS outside FROM ruled),
hits AS (SELECT bucket, bucket - row_number() OVER (ORDER BY bucket) AS g, count(*) OVER () AS total FROM o WHERE block IN ('train', 'validation') AND outside = FALSE AND list_contains(categories, {CATEGORY}) AND len(list_filter(categories, lambda c: c NOT IN (0, {CATEGORY}))) = 0)
SELECT min(bucket) AS first, max(bucket) AS last, count(*) AS n FROM hits GROUP BY g, total HAVING count(*) >= {probes.LEAST_RUN} AND total - count(*) >= {probes.LEAST_POSITIVE}""")
def q_residual_runs(spark, sf_dir):
    """The runs of residual attacks that are held out, each with its number of windows."""
    return probes.attack_runs(cohort(spark, sf_dir)).select("first", "last", "n")


@query("leave_one_run_out")
def q_loro(spark, sf_dir):
    """Recall of every held-out run of residual attacks by a model refitted without it."""
    return probes.held_out_runs(probed(spark, sf_dir), series.ROW_FEATURES["combined"])


@query("run_dependence")
def q_runs(spark, sf_dir):
    return probes.run_summary(q_loro(spark, sf_dir))


@query("probability_rule")
def q_rule(spark, sf_dir):
    """The float-provenance rule: boosted trees on the bit features of residual attacks, saved, loaded and applied to the test windows."""
    rows, tested = probed(spark, sf_dir), blocked(spark, sf_dir).where("block = 'test'").select("bucket")
    train, checked = rows.where("block = 'train' and label is not null"), rows.where("block = 'validation' and label = 0")
    if train.isEmpty() or checked.isEmpty():  # no model or no threshold: nothing can be said of any window
        return tested.select("bucket", F.lit(None).cast("boolean").alias("fired"), F.lit("").alias("reasons"))
    model = models.fit_boosted(train, F2, "label", "bucket")
    scored = models.boosted_probability(checked, model, F2)
    cut = evaluate.fit_threshold(scored, "probability", probes.MAX_FPR).first()["threshold"]
    path = f"{scratch(spark, 'rule')}/rule.json"
    models.ProbabilityRule(model, cut, F2).save(spark, path)
    every = tested.join(full_rows(spark, sf_dir), "bucket", "left")
    return models.ProbabilityRule.load(spark, path).apply(every, "hit").select("bucket", "hit.fired", F.array_join("hit.reasons", ";").alias("reasons"))


# ---- forward folds, everything refitted in each

_FOLDS = CADENCE[: CADENCE.index(",\nstreamed AS")] + """,
seen AS (SELECT bucket, is_attack, position, sum(is_attack) OVER (ORDER BY position) - is_attack AS before, sum(is_attack) OVER () AS total FROM blocks),
segs AS (SELECT *, least(5, floor(before * 6 / greatest(total, 1)::DOUBLE))::INTEGER AS segment FROM seen),
edges AS (SELECT segment AS fold, min(position) AS cut, max(position) AS last_ FROM segs GROUP BY segment HAVING segment > 0),
folds AS (SELECT fold, segment, bucket, is_attack, CASE WHEN position < cut - 1 THEN 'train' WHEN position >= cut + 1 THEN 'validation' END AS role FROM segs JOIN edges ON position <= last_),
kept AS (SELECT * FROM folds WHERE role IS NOT NULL),
streamed AS (SELECT row_number() OVER (ORDER BY ts_us, record_index) AS position, ts_us, bucket, function_code FROM egress WHERE function_code IN (3, 16)),
pre AS (SELECT s.*, segment, coalesce(is_attack = 0, FALSE) AS normal FROM streamed s LEFT JOIN segs USING (bucket)),
epochs AS (SELECT *, sum((NOT normal)::INT) OVER (ORDER BY s.position) AS epoch FROM pre s),
normal_gaps AS (SELECT function_code, bucket, gap_us FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY epoch, segment, function_code ORDER BY position) AS gap_us FROM epochs WHERE normal) WHERE gap_us > 0),
base AS (SELECT fold, function_code, count(*) AS n, avg(gap_us / 1e6) AS expected, stddev_pop(gap_us / 1e6) AS std, greatest(stddev_pop(gap_us / 1e6), 1e-6, 0.01 * avg(gap_us / 1e6)) AS scale FROM normal_gaps JOIN kept USING (bucket) WHERE role = 'train' GROUP BY fold, function_code),
held AS (SELECT s.position, ts_us, function_code, fold, segment, role, bucket, is_attack, (ts_us - lag(ts_us) OVER (PARTITION BY fold, function_code, segment ORDER BY s.position)) / 1e6 AS raw_gap FROM streamed s JOIN kept USING (bucket)),
valued AS (SELECT h.*, CASE WHEN raw_gap > 0 THEN greatest(0, raw_gap - expected) / scale - 0.5 END AS push FROM held h JOIN base USING (fold, function_code)),
summed AS (SELECT *, sum(coalesce(push, 0)) OVER (PARTITION BY fold, function_code, segment ORDER BY position) AS total FROM valued),
states AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY fold, function_code, segment ORDER BY position)) AS cusum FROM summed),
most AS (SELECT k.fold, k.function_code, b.bucket, coalesce(max(cusum), 0) AS most FROM base k JOIN kept b ON b.fold = k.fold AND b.role = 'train' AND b.is_attack = 0 LEFT JOIN states s ON s.fold = k.fold AND s.function_code = k.function_code AND s.bucket = b.bucket GROUP BY ALL),
limits AS (SELECT fold, function_code, greatest(0.5, max(most) FILTER (spot = ceil((n - 1) * 0.99))) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY fold, function_code ORDER BY most) - 1 AS spot, count(*) OVER (PARTITION BY fold, function_code) AS n FROM most) GROUP BY fold, function_code),
alarms AS (SELECT fold, function_code, count(*) FILTER (cusum >= threshold - 1e-9 AND push IS NOT NULL) AS n_alarms, count(*) AS n_events FROM states JOIN limits USING (fold, function_code) WHERE role = 'validation' GROUP BY fold, function_code)"""


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fold, segment, bucket, role, is_attack) of forward folds over segments with about as many attacks each."""
    seg = splits.forward_segments(blocked(spark, sf_dir).drop("position").select("bucket", "is_attack"), "is_attack")
    return written(splits.forward_folds(written(seg, "segments")).select("fold", "segment", "bucket", "role", "is_attack"), "folds")


def fold_cadence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(folds, baselines, events with state, thresholds), all of a fold from its own training windows; segments are sequences."""
    held = folds(spark, sf_dir)
    stream = responses(spark, sf_dir)
    segments = splits.forward_segments(blocked(spark, sf_dir).drop("position").select("bucket", "is_attack"), "is_attack")
    every = written(segments.select("bucket", "segment", (F.col("is_attack") == 0).alias("normal")), "marks")
    gaps = series.normal_gaps(stream, every).join(held.where("role = 'train'").select("fold", "bucket"), "bucket").withColumn("gap", F.col("gap_us") / 1e6)
    base = written(series.baselines(gaps, ("fold", "function_code")), "baselines")
    events = stream.join(held, "bucket").select("fold", "segment", "role", "is_attack", "bucket", "position", "ts_us", "function_code")
    states = written(series.cusum(events, base, within=("fold",)), "cusum")
    limits = series.cusum_thresholds(states, held.where("role = 'train' and is_attack = 0"), within=("fold",))
    return held, base, states, written(limits, "limits")


@query("fold_cadence", f"WITH {_FOLDS} SELECT fold, function_code, n, {r('expected', 'std', 'threshold')}, coalesce(n_events, 0) AS n_events, coalesce(n_alarms, 0) AS n_alarms FROM base JOIN limits USING (fold, function_code) LEFT JOIN alarms USING (fold, function_code)")
def q_fold_cadence(spark, sf_dir):
    _, base, states, limits = fold_cadence(spark, sf_dir)
    alarm = F.col("gap").isNotNull() & (F.col("cusum") >= F.col("threshold") - 1e-9)
    seen = states.where("role = 'validation'").join(limits, ["fold", "function_code"]).groupBy("fold", "function_code").agg(F.count("*").alias("n_events"), F.count_if(alarm).alias("n_alarms"))
    out = base.join(limits, ["fold", "function_code"]).join(seen, ["fold", "function_code"], "left").na.fill(0, ["n_events", "n_alarms"])
    return rounded(out.select("fold", "function_code", "n", "expected", "std", "threshold", "n_events", "n_alarms"))


@query("fold_models")
def q_fold_models(spark, sf_dir):
    """Each fold's confusion of a model refitted on its cadence features, without (X) and with (Y) the lags of windows before."""
    held, _, states, limits = fold_cadence(spark, sf_dir)
    parts = None
    seen = [x["fold"] for x in held.select("fold").distinct().orderBy("fold").collect()]  # a few folds
    for fold in seen:
        own = held.where(F.col("fold") == fold)
        events = states.where(F.col("fold") == fold).drop("fold", "segment", "role", "is_attack")
        one = series.cadence_windows(events, limits.where(F.col("fold") == fold).drop("fold"), own.select("bucket", "segment", "role", "is_attack"))
        one = series.lags(one, "cadence_event_count_total", index="bucket", key="segment").withColumn("fold", F.lit(fold))
        parts = one if parts is None else parts.unionByName(one, allowMissingColumns=True)
    rows = written(parts.withColumn("label", F.col("is_attack")), "folds")
    x = [c for c in rows.columns if c.startswith("func_")] + ["cadence_event_count_total", "missed_cycles_sum_total", "cusum_alarm_count_total", "cusum_max_any_type", "active_type_count"]
    y = [*x, *[f"lag_{i}" for i in range(1, 6)], "slope", "direction", "variance"]
    # a fold's two models see the rows and bins of the fold alone; all folds train side by side
    made = [(fold, name, boosting.BoostedTrees(allowed=list(range(len(use))))) for fold in seen for name, use in (("X", x), ("Y", y))]
    boosting.train(rows.where("role = 'train'"), y, "bucket", [m for _, _, m in made], "label", tag=F.col("fold"), only=[fold for fold, _, _ in made])
    names = F.array(*[F.struct(F.lit(fold).alias("fold"), F.lit(name).alias("features")) for fold, name, _ in made])
    scored = boosting.scores(rows.where("role = 'validation'"), [m for _, _, m in made], y, "p", known=False)
    each = scored.select("label", F.col("fold").alias("own"), F.posexplode("p").alias("at", "probability")).withColumn("of", F.get(names, F.col("at"))).where("of.fold = own").select("label", "probability", "of.fold", "of.features")
    return evaluate.confusion(each, F.col("label") == 1, F.col("probability") >= 0.5, ("fold", "features"))


@query("fold_model_summary")
def q_fold_model_summary(spark, sf_dir):
    return evaluate.fold_summary(q_fold_models(spark, sf_dir), ["recall", "precision", "fpr", "f1"], ("features",))


@query("residual_recall", f"""WITH {RULES}, o AS (SELECT *, CASE WHEN p_min IS NOT NULL THEN p_min < low OR p_max > high END AS outside FROM flagged WHERE block = 'test')
SELECT count(*) AS n_residual, count(*) FILTER (protocol_fired OR rate_fired) AS n_found FROM o WHERE outside = FALSE AND list_contains(categories, {CATEGORY}) AND len(list_filter(categories, lambda c: c NOT IN (0, {CATEGORY}))) = 0""")
def q_residual_recall(spark, sf_dir):
    """What the other rules find of the residual attacks of the test block."""
    rows = cohort(spark, sf_dir).where("block = 'test' and label = 1").select("bucket")
    hits = ruled(spark, sf_dir).select("bucket", (F.col("protocol.fired") | F.col("rate.fired")).alias("found"))
    return rows.join(hits, "bucket").agg(F.count("*").alias("n_residual"), F.count_if("found").alias("n_found"))
