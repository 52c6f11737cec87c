"""Queries of audits, gates and coverage with their verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, joins, ordered, series, stats, windows
from ..sources.frames import event_frames, table
from ..sources.scratch import written
from .detector import RULES, blocked, egress, q_confusion, q_explanations, q_per_category, ruled
from .joins_plans import _ACKS, acks
from .registry import BLOCKS, FRAMES, HOUR, query, r, rounded
from .series_plans import CADENCE, STEPS, labelled, readings, responses
from .stats_plans import _SCORES, scores

_BEST = "round(max(rate) + 1e-9, 6) + 0e0 AS rate_max, count(*) AS pairs"


def _rated(out: DataFrame) -> DataFrame:
    return out.select("bucket", (F.round(F.col("rate_max") + 1e-9, 6) + 0.0).alias("rate_max"), "pairs")


def _normal_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = labelled(spark, sf_dir)
    normal = rows.where("normal")
    return series.both_normal(series.step_rates(rows.drop("normal")), normal), normal


@query("normal_step_rates", f"WITH {STEPS} SELECT bucket, {_BEST} FROM rates WHERE normal AND normal_before GROUP BY bucket")
def q_normal_steps(spark, sf_dir):
    return _rated(series.largest_rates(_normal_pairs(spark, sf_dir)[0]))


@query("normal_gated_rates", f"WITH {STEPS}, bounds AS (SELECT quantile_cont(pressure, 0.05) AS low, quantile_cont(pressure, 0.95) AS high FROM marked WHERE normal) SELECT bucket, {_BEST} FROM rates, bounds WHERE normal AND normal_before AND p_before BETWEEN low AND high GROUP BY bucket")
def q_normal_gated(spark, sf_dir):
    pairs, normal = _normal_pairs(spark, sf_dir)
    bounds = normal.agg(F.percentile("pressure", F.lit(0.05)).alias("low"), F.percentile("pressure", F.lit(0.95)).alias("high"))
    return _rated(series.largest_rates(pairs, bounds))


@query("regression_by_category", f"WITH {RULES} SELECT dominant AS category, count(*) AS n, count(*) FILTER (protocol_fired) AS old_flagged, count(*) FILTER (fired) AS new_flagged, count(*) FILTER (fired) - count(*) FILTER (protocol_fired) AS delta FROM flagged WHERE block = 'test' GROUP BY dominant")
def q_regression_by(spark, sf_dir):
    rows = ruled(spark, sf_dir).where("block = 'test'").withColumn("category", F.col("dominant"))
    return evaluate.regression_by(rows, "category", F.col("protocol.fired"), F.col("hit.fired"))


@query("regression_bar", f"WITH {RULES}, b AS (SELECT avg(protocol_fired::INT) AS fpr_old, avg(fired::INT) AS fpr_new, count(*) FILTER (fired) - count(*) FILTER (protocol_fired) AS new_fp FROM flagged WHERE block = 'test' AND is_attack = 0) SELECT {r('fpr_old', 'fpr_new')}, new_fp, fpr_new <= 0.01 AS within_bar FROM b")
def q_regression_bar(spark, sf_dir):
    rows = ruled(spark, sf_dir).where("block = 'test'")
    return rounded(evaluate.regression_bar(rows, F.col("is_attack") == 1, F.col("protocol.fired"), F.col("hit.fired"), 0.01))


@query("rederived_flags", f"WITH {RULES} SELECT bucket, protocol_fired AS flag, rate_fired OR pressure_fired AS term, protocol_fired OR rate_fired OR pressure_fired AS combined FROM flagged WHERE block = 'test'")
def q_rederived(spark, sf_dir):
    """Saved flags of one rule, and a new term from another pass over the windows."""
    saved = written(ruled(spark, sf_dir).where("block = 'test'").select("bucket", F.col("protocol.fired").alias("flag")), "saved")
    term = ruled(spark, sf_dir).select("bucket", (F.col("rate.fired") | F.col("pressure.fired")).alias("term"))
    return evaluate.rederived(saved, term, "bucket", "flag", "term")


#: Seconds after an acknowledgement in which readings are sought, readings wanted, and seconds that make a cluster.
HORIZONS, WANTED, CLUSTER = (600, 1800, 3600), 2, 120
_US = 1_000_000
_HORIZON_SQL = ", ".join(
    f"count(*) FILTER (next_us < {h * _US}) AS censored_{h}, count(*) FILTER (after_{h} >= {WANTED}) AS scorable_{h}, count(*) FILTER (cut_{h} >= {WANTED}) AS scorable_truncated_{h}" for h in HORIZONS
)
_COUNT_SQL = ", ".join(
    f"count(s.ts_us) FILTER (s.ts_us > a.ts_us AND s.ts_us <= a.ts_us + {h * _US}) AS after_{h}, count(s.ts_us) FILTER (s.ts_us > a.ts_us AND s.ts_us <= a.ts_us + {h * _US} AND s.ts_us < a.ts_us + coalesce(next_us, {(h + 1) * _US})) AS cut_{h}" for h in HORIZONS
)
_INFEASIBLE = "CASE WHEN n_acks = 0 THEN 'INFEASIBLE (no data)' WHEN 100.0 - {x} >= 50 THEN 'LIKELY INFEASIBLE' ELSE 'not flagged by this rule' END"


@query("ack_horizons", f"""WITH {_ACKS}, d AS (SELECT DISTINCT ts_us FROM acks), g AS (SELECT ts_us, lead(ts_us) OVER (ORDER BY ts_us) - ts_us AS next_us, ts_us - lag(ts_us) OVER (ORDER BY ts_us) AS prev_us FROM d),
c AS (SELECT a.point_id, any_value(a.category) AS category, any_value(next_us) AS next_us, any_value(least(prev_us, next_us)) AS near_us, count(s.ts_us) FILTER (s.ts_us >= a.ts_us - {HOUR // 2} AND s.ts_us < a.ts_us) AS before, {_COUNT_SQL} FROM acks a JOIN g USING (ts_us) LEFT JOIN series s ON s.ts_us BETWEEN a.ts_us - {HOUR // 2} AND a.ts_us + {HORIZONS[-1] * _US} GROUP BY a.point_id),
t AS (SELECT category, count(*) AS n_acks, count(*) FILTER (before >= 3) AS baseline_ok, count(*) FILTER (near_us <= {CLUSTER * _US}) AS clustered, {_HORIZON_SQL} FROM c GROUP BY category)
SELECT *, {_INFEASIBLE.format(x=f'100.0 * scorable_{HORIZONS[-1]} / n_acks')} AS verdict, {_INFEASIBLE.format(x=f'100.0 * scorable_truncated_{HORIZONS[-1]} / n_acks')} AS verdict_truncated FROM t""")
def q_horizons(spark, sf_dir):
    """Coverage of acknowledgements by readings within nominal horizons and horizons cut at the next acknowledgement, with verdicts."""
    points = written(joins.neighbour_gaps(acks(spark, sf_dir)), "acks")
    t, following = F.col("ts_us"), F.rint(F.col("next_gap") * 1e6).cast("long")
    ranges = {"before": (t - HOUR // 2, t - 1)}
    for h in HORIZONS:
        ranges[f"after_{h}"] = (t + 1, t + h * _US)
        ranges[f"cut_{h}"] = (t + 1, t + F.least(F.lit(h * _US), F.coalesce(following - 1, F.lit(h * _US))))
    got = joins.range_counts(points, readings(spark, sf_dir).select("ts_us"), ranges, HOUR)
    sums = [F.count("*").alias("n_acks"), F.count_if(F.col("before") >= 3).alias("baseline_ok"), F.count_if(F.col("nearest_gap") <= CLUSTER).alias("clustered")]
    for h in HORIZONS:
        sums += [F.count_if(following < h * _US).alias(f"censored_{h}"), F.count_if(F.col(f"after_{h}") >= WANTED).alias(f"scorable_{h}"), F.count_if(F.col(f"cut_{h}") >= WANTED).alias(f"scorable_truncated_{h}")]
    out = got.groupBy("category").agg(*sums)
    share = lambda c: 100.0 * F.col(c) / F.col("n_acks")
    return out.withColumns({"verdict": evaluate.infeasible(share(f"scorable_{HORIZONS[-1]}"), F.col("n_acks")), "verdict_truncated": evaluate.infeasible(share(f"scorable_truncated_{HORIZONS[-1]}"), F.col("n_acks"))})


_SESSIONS = _ACKS + f""",
gaps AS (SELECT *, ts_us - lag(ts_us) OVER (ORDER BY ts_us, point_id) AS gap FROM acks),
cut AS (SELECT *, sum((coalesce(gap, 0) > {CLUSTER * _US})::INT) OVER (ORDER BY ts_us, point_id) AS session FROM gaps),
bursts AS (SELECT session, count(*) AS n_acks, min(ts_us) AS start_us, max(ts_us) AS end_us, list(DISTINCT category) AS cats FROM cut GROUP BY session),
spans AS (SELECT *, lead(start_us) OVER (ORDER BY start_us) AS until FROM bursts),
clean AS (SELECT b.session, any_value(n_acks) AS n_acks, any_value(cats) AS cats, count(s.ts_us) AS samples FROM spans b LEFT JOIN series s ON s.ts_us > b.end_us AND s.ts_us < coalesce(b.until, 9223372036854775807) GROUP BY b.session)"""


@query("burst_composition", f"""WITH {_SESSIONS}, e AS (SELECT unnest(cats) AS category, * FROM clean),
t AS (SELECT category, count(*) AS n_bursts, median(n_acks)::DOUBLE AS median_acks, avg(n_acks) AS mean_acks, max(n_acks) AS most_acks, 100.0 * count(*) FILTER (len(cats) > 1) / count(*) AS several_percent, 100.0 * count(*) FILTER (list_contains(cats, 0)) / count(*) AS normal_percent, 100.0 * count(*) FILTER (samples >= 2) / count(*) AS clean_percent FROM e GROUP BY category)
SELECT category, n_bursts, most_acks, {r('median_acks', 'mean_acks', 'several_percent', 'normal_percent', 'clean_percent')}, CASE WHEN 100.0 - clean_percent >= 50 THEN 'LIKELY INFEASIBLE' ELSE 'not flagged by this rule' END AS verdict FROM t""")
def q_composition(spark, sf_dir):
    """What bursts with each category hold, the clean readings after them, and whether that is enough."""
    rows = written(ordered.indexed(acks(spark, sf_dir), "ts_us", "point_id", out="position"), "acks")
    cut = windows.sessions(rows, CLUSTER * _US)
    found = written(cut.groupBy("session").agg(F.count("*").alias("n_acks"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("ts_us"), F.collect_set("category").alias("cats")), "bursts")
    later = ordered.indexed(found, "start_us", "session", out="position")
    until = later.select((F.col("position") - 1).alias("position"), F.col("start_us").alias("until"))
    points = written(later.join(until, "position", "left"), "spans")
    end = written(readings(spark, sf_dir).select("ts_us"), "times")
    last = end.agg(F.max("ts_us").alias("last"))
    points = points.crossJoin(F.broadcast(last)).withColumn("until", F.coalesce("until", F.greatest(F.col("last"), F.col("ts_us")) + 1))  # one row
    got = joins.range_counts(points, end, {"samples": (F.col("ts_us") + 1, F.col("until") - 1)}, HOUR, point_key="session")
    each = got.withColumn("category", F.explode("cats"))
    percent = lambda c: 100.0 * F.count_if(c) / F.count("*")
    out = each.groupBy("category").agg(F.count("*").alias("n_bursts"), F.max("n_acks").alias("most_acks"), F.median("n_acks").alias("median_acks"), F.avg("n_acks").alias("mean_acks"), percent(F.size("cats") > 1).alias("several_percent"), percent(F.array_contains("cats", 0)).alias("normal_percent"), percent(F.col("samples") >= 2).alias("clean_percent"))
    return rounded(out.withColumn("verdict", evaluate.infeasible(F.col("clean_percent"), F.col("n_bursts"))))


_SEP = ("least", "q25", "median", "q75", "most")


def _separation_sql(group: str, name: str) -> str:
    at = f"FILTER ({group})"
    return f"count(*) {at} AS rows_{name}, count(pressure) {at} AS n_{name}, min(pressure) {at} AS least_{name}, quantile_cont(pressure, 0.25) {at} AS q25_{name}, quantile_cont(pressure, 0.5) {at} AS median_{name}, quantile_cont(pressure, 0.75) {at} AS q75_{name}, max(pressure) {at} AS most_{name}, count(DISTINCT pressure) {at} AS distinct_{name}"


@query("payload_separation", f"""WITH {BLOCKS}, p AS (SELECT block, is_attack = 1 AS attack, pressure FROM egress e JOIN blocks b USING (bucket)),
s AS (SELECT block, {_separation_sql('attack', 'true')}, {_separation_sql('NOT attack', 'false')} FROM p GROUP BY block),
c AS (SELECT block, count(*) AS values_in_common FROM (SELECT block, pressure FROM p WHERE pressure IS NOT NULL GROUP BY ALL HAVING bool_or(attack) AND bool_or(NOT attack)) GROUP BY block),
g AS (SELECT s.*, coalesce(values_in_common, 0) AS values_in_common, coalesce(least_true > most_false OR most_true < least_false, FALSE) AS separated FROM s LEFT JOIN c USING (block)),
w AS (SELECT *, list_filter([CASE WHEN n_true = 0 THEN 'absent from attacks' END, CASE WHEN n_false = 0 THEN 'absent from normal rows' END, CASE WHEN distinct_false <= 1 THEN 'constant among normal rows' END, CASE WHEN separated THEN 'separates perfectly' END], lambda x: x IS NOT NULL) AS why FROM g)
SELECT block, rows_true, rows_false, n_true, n_false, distinct_true, distinct_false, values_in_common, separated, {r(*[f'{c}_{g}' for c in _SEP for g in ('true', 'false')])}, array_to_string(why, ',') AS reasons, len(why) = 0 AS passes FROM w""")
def q_separation(spark, sf_dir):
    rows = egress(spark, sf_dir).join(blocked(spark, sf_dir).select("bucket", "block", (F.col("is_attack") == 1).alias("attack")), "bucket")
    return rounded(stats.payload_gate(stats.separation(rows, "attack", "pressure", ("block",))))


@query("support_reasons", f"""WITH {BLOCKS}, j AS (SELECT e.bucket, e.function_code, b.block, b.categories FROM egress e JOIN blocks b USING (bucket)),
t AS (SELECT block, function_code, count(*) FILTER (categories = [0]) AS normal_frames, count(DISTINCT bucket) FILTER (categories = [0]) AS normal_windows, count(DISTINCT bucket) FILTER (list_contains(categories, 5)) AS attack_windows FROM j GROUP BY GROUPING SETS ((block, function_code), (block))),
w AS (SELECT *, list_filter([CASE WHEN normal_windows < 30 THEN 'too few normal windows' END, CASE WHEN attack_windows < 20 THEN 'too few attack windows' END], lambda x: x IS NOT NULL) AS why FROM t)
SELECT block, function_code, normal_windows, attack_windows, array_to_string(why, ',') AS reasons, len(why) = 0 AS supported FROM w""")
def q_support(spark, sf_dir):
    found = stats.support_gate(stats.typed_support(egress(spark, sf_dir), blocked(spark, sf_dir), 5), 30, 20)
    return rounded(found.drop("normal_frames"))


@query("register_audit", "WITH t AS (SELECT l_orderkey % 256 AS b0, l_partkey % 256 AS b1, l_linenumber AS b2, l_suppkey % 256 AS b3 FROM lineitem), w AS (SELECT 0 AS register, b0 * 256 + b1 AS word FROM t UNION ALL SELECT 1, b2 * 256 + b3 FROM t) SELECT register, count(*) AS n, count(DISTINCT word) AS distinct, min(word) AS least, max(word) AS most, count(DISTINCT word) = 1 AS constant FROM w GROUP BY register")
def q_registers(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("row"), F.array(F.col("l_orderkey") % 256, F.col("l_partkey") % 256, F.col("l_linenumber").cast("long"), F.col("l_suppkey") % 256).alias("b"))
    return stats.register_audit(t.select("row", F.posexplode("b").alias("at", "value")), "row")


@query("length_by_direction", f"WITH {FRAMES} SELECT destination, count(*) AS n, round(avg(frame_len) + 1e-7, 4) + 0e0 AS mean_length FROM frames GROUP BY destination")
def q_lengths(spark, sf_dir):
    return rounded(stats.lengths_by(event_frames(spark, sf_dir, numbered=False), "destination"))


_NATIVE = ("std", "range", "step_max", "slope", "mean_shift")


@query("window_size_gate", f"""WITH {BLOCKS}, kept AS (SELECT bucket // 3 AS wide, max(is_attack) AS attack FROM blocks WHERE block <> 'guard' GROUP BY bucket // 3, block HAVING count(DISTINCT bucket) = 3),
rows_ AS (SELECT bucket // 3 AS wide, pressure, abs(pressure - lag(pressure) OVER (PARTITION BY bucket // 3 ORDER BY ts_us, record_index)) AS step, (ts_us - (bucket // 3) * 10800000000) / 1e6 AS t FROM egress WHERE pressure IS NOT NULL),
got AS (SELECT wide, count(*) AS n, avg(pressure) AS mean, CASE WHEN count(*) >= 2 THEN stddev_pop(pressure) END AS std, CASE WHEN count(*) >= 2 THEN max(pressure) - min(pressure) END AS range, max(step) AS step_max, CASE WHEN count(*) >= 2 THEN coalesce(abs(regr_slope(pressure, t)), 0) END AS slope FROM rows_ GROUP BY wide),
every AS (SELECT attack = 1 AS attack, g.std, g.range, g.step_max, g.slope, CASE WHEN g.n >= 2 THEN abs(g.mean - p.mean) END AS mean_shift FROM kept JOIN got g USING (wide) LEFT JOIN got p ON p.wide = g.wide - 1),
long AS (UNPIVOT every ON {', '.join(_NATIVE)} INTO NAME feature VALUE value),
e AS (SELECT feature, count(value) FILTER (attack) AS n_true, count(value) FILTER (NOT attack) AS n_false, avg(value) FILTER (attack) - avg(value) FILTER (NOT attack) AS difference, sqrt((var_pop(value) FILTER (attack) + var_pop(value) FILTER (NOT attack)) / 2) AS pooled FROM long GROUP BY feature)
SELECT feature, n_true, n_false, round(CASE WHEN pooled > 0 THEN difference / pooled ELSE 0 END + 1e-7, 4) + 0e0 AS d, abs(CASE WHEN pooled > 0 THEN difference / pooled ELSE 0 END) >= 0.5 AND n_true >= 30 AS clears_gate FROM e""")
def q_size_gate(spark, sf_dir):
    """Effect sizes of native window features at three times the width, and which clear the gate."""
    b = blocked(spark, sf_dir)
    wide = windows.native_windows(egress(spark, sf_dir).drop("bucket"), b, HOUR, 3)
    marks = b.where("block <> 'guard'").groupBy(F.floor(F.col("bucket") / 3).alias("wide"), "block").agg((F.max("is_attack") == 1).alias("attack"))
    rows = written(wide.join(marks, ["wide", "block"]), "native")
    effects = stats.cohens_d(stats.long_form(rows, ["wide", "attack"], list(_NATIVE)), "attack")
    return rounded(evaluate.size_gate(effects).select("feature", "n_true", "n_false", "d", "clears_gate"))


@query("verdicts", f"""{_SCORES}, c AS (SELECT threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp, count(*) FILTER (label <> 1 AND score >= threshold) AS fp, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM s CROSS JOIN (SELECT unnest([{', '.join(str(t) for t in evaluate.THRESHOLDS)}])::DOUBLE AS threshold) GROUP BY threshold),
v AS (SELECT threshold, CASE WHEN p > 0 THEN tp / p::DOUBLE ELSE 0 END AS a, CASE WHEN n > 0 THEN fp / n::DOUBLE ELSE 0 END AS b, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS c FROM c)
SELECT round(threshold, 2) AS threshold, CASE WHEN a >= 0.25 AND b <= 0.003 AND c >= 0.97 THEN 'STRONG' WHEN a >= 0.1 AND b <= 0.003 AND c >= 0.97 THEN 'ACCEPTABLE' ELSE 'WEAK / HYPOTHESIS NOT SUPPORTED' END AS verdict FROM v""")
def q_verdicts(spark, sf_dir):
    """The gate at every threshold of the sweep."""
    rows = evaluate.sweep(scores(spark, sf_dir))
    return rows.select(F.round("threshold", 2).alias("threshold"), evaluate.verdict(F.col("recall"), F.col("fpr"), F.col("precision")).alias("verdict"))


@query("mapped_baselines", f"WITH {CADENCE}, g AS (SELECT (ts_us - lag(ts_us) OVER (PARTITION BY epoch ORDER BY position)) / 1e6 AS gap FROM epochs WHERE normal), k AS (SELECT gap FROM g WHERE gap > 0) SELECT 1 AS kind, count(*) AS n, round(avg(gap) + 1e-7, 4) + 0e0 AS expected, round(median(gap) + 1e-7, 4) + 0e0 AS median FROM k")
def q_mapped(spark, sf_dir):
    """Baselines by a caller's types: reads and writes as one."""
    stream = series.mapped(responses(spark, sf_dir), lambda f: F.when(F.col("function_code").isin(3, 16), F.lit(1)))
    marks = blocked(spark, sf_dir).select("bucket", ((F.col("block") == "train") & (F.col("is_attack") == 0)).alias("normal"))
    gaps = series.normal_gaps(stream, marks).withColumn("gap", F.col("gap_us") / 1e6)
    found = series.baselines(gaps).select(F.col("function_code").alias("kind"), "n", "expected", "median")
    return rounded(spark.range(1).select(F.lit(1).alias("kind")).join(found, "kind", "left").na.fill(0, ["n"]))  # the one type there is


def dashboard(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four tables that a dashboard shows: metrics, the windows' timeline with hits, explanations, and flags by category."""
    timeline = ruled(spark, sf_dir).where("block = 'test'").select("bucket", "is_attack", "dominant", "packets_per_sec", F.col("hit.fired").alias("flagged"), F.col("protocol.fired").alias("baseline"))
    return {"metrics": q_confusion(spark, sf_dir), "timeline": timeline, "explanations": q_explanations(spark, sf_dir), "categories": q_per_category(spark, sf_dir)}
