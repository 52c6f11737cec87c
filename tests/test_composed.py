"""Ordered passes over blocks and slices against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tidewatch.operators import evaluate, ordered, rules, series, stats
from tidewatch.sources import scratch


def sequence(spark, seed: int, n: int = 300):
    pick = random.Random(seed)
    rows = [(i + 1, pick.choice("aaab"), pick.choice([None, -1.5, 0.5, 2.0]), pick.randrange(40)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "i long, k string, v double, w int")


@pytest.mark.parametrize("block", [7, 1000])
def test_carried_and_accumulated(spark, block):
    rows, df = sequence(spark, 1)
    out = ordered.carried(df, ["k"], "i", F.col("v"), "last", block=block)
    out = ordered.carried(out, ["k"], "i", F.col("i"), "before", strict=True, block=block)
    got = {r["i"]: r for r in ordered.accumulated(out, ["k"], "i", F.col("v"), "total", "least", block=block).collect()}
    last, before, total, least = {}, {}, {}, {}
    for i, k, v, _ in rows:
        last[k] = v if v is not None else last.get(k)
        total[k] = total.get(k, 0.0) + (v or 0.0)
        least[k] = min(least.get(k, total[k]), total[k])
        assert (got[i]["last"], got[i]["before"]) == (last[k], before.get(k))
        assert (got[i]["total"], got[i]["least"]) == pytest.approx((total[k], least[k]))
        before[k] = i


@pytest.mark.parametrize("descending", [False, True])
def test_cumulated(spark, descending):
    rows, df = sequence(spark, 2)
    counts = df.groupBy("k", "w").agg(F.count("*").alias("n"))
    got = {(r["k"], r["w"]): r["upto"] for r in ordered.cumulated(counts, ["k"], "w", {"upto": F.col("n")}, descending=descending, block=7).collect()}
    for (k, w), upto in got.items():
        assert upto == sum(1 for _, a, _, b in rows if a == k and (b >= w if descending else b <= w))
    assert ordered.cumulated(counts.where("false"), ["k"], "w", {"upto": F.col("n")}).count() == 0


def test_ordered_passes_are_cut_by_rows(spark, monkeypatch):
    """A key with nearly all values, and a time with nearly all rows, are many tasks of about as many rows."""
    sizes = []

    def watched(df, kind):
        rows = scratch.written(df, kind)
        sizes.append(sorted(r["count"] for r in rows.groupBy(F.shiftright("__id", 33)).count().collect()))
        return rows

    monkeypatch.setattr(ordered, "written", watched)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join ranges as small as these
    rows = spark.range(20_000).select(F.when(F.col("id") < 19_000, 5).otherwise(F.col("id")).alias("ts"), F.expr("(id * 7919) % 20000").alias("tie"))
    got = ordered.indexed(rows.withColumn("ts", F.col("ts").cast("long")), "ts", "tie").orderBy("record_index").collect()
    assert [r["record_index"] for r in got] == list(range(1, 20_001))
    assert [(r["ts"], r["tie"]) for r in got] == sorted((r["ts"], r["tie"]) for r in got)
    counts = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("k"), F.col("id").alias("w"), F.lit(1).alias("n"))
    got = ordered.cumulated(counts, ["k"], "w", {"upto": F.col("n")}, block=1000)
    assert got.where(F.col("upto") != F.when(F.col("k") == "b", F.floor(F.col("w") / 50) + 1).otherwise(F.col("w") - F.floor(F.col("w") / 50))).count() == 0
    assert len(sizes) == 2 and all(len(x) == 8 and x[-1] < 20_000 / 8 * 2 for x in sizes)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_shared_folder_is_named_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
    Session.conf.set("spark.checkpoint.dir", "hdfs://shared/x/")
    assert scratch.shared_dir(Session()) == "hdfs://shared/x"


def test_higher_quantile_and_ranks(spark):
    rows, df = sequence(spark, 3)
    got = {r["k"]: r["quantile"] for r in series.higher_quantile(df, "w", 0.9, ["k"]).collect()}
    for k in "ab":
        own = sorted(w for _, a, _, w in rows if a == k)
        assert got[k] == own[-(-(len(own) - 1) * 9 // 10)]
    ranks = {r["i"]: r["rank"] for r in stats.average_ranks(df, "w", ["k"]).collect()}
    for i, k, _, w in rows:
        own = [b for _, a, _, b in rows if a == k]
        assert ranks[i] == sum(b < w for b in own) + (sum(b == w for b in own) + 1) / 2


@pytest.mark.parametrize("block", [3, 1000])
def test_resetting_sum_equals_a_plain_pass(spark, block):
    pick = random.Random(5)
    at, events = 0, []
    for i in range(400):
        at += pick.choice([0, 1, 2, 2, 3, 9]) * 1_000_000
        events.append((i + 1, pick.choice([3, 3, 16]), at, "a" if i < 250 else "b"))
    df = spark.createDataFrame(events, "position long, function_code int, ts_us long, segment string")
    fitted = spark.createDataFrame([(3, 2.0, 1.5), (16, 4.0, 2.0)], "function_code int, expected double, scale double")
    limits = spark.createDataFrame([(3, 2.5), (16, 1.5)], "function_code int, threshold double")
    got = {r["position"]: (r["cusum"], r["alarm"], r["cusum_end"]) for r in series.cusum_reset(df, fitted, limits, block=block).collect()}
    state, last = {}, {}
    for i, code, ts, segment in events:
        key = code, segment
        expected, scale, limit = {3: (2.0, 1.5, 2.5), 16: (4.0, 2.0, 1.5)}[code]
        gap = (ts - last[key]) / 1e6 if key in last else 0
        s, alarm = state.get(key, 0.0), False
        if gap > 0:
            s = max(0.0, s + max(0.0, gap - expected) / scale - 0.5)
            alarm = s >= limit - 1e-9
        assert got[i] == pytest.approx((s, float(alarm), 0.0 if alarm else s))
        state[key], last[key] = 0.0 if alarm else s, ts


WINDOW = "bucket long, packets_per_sec double, p_min double, p_max double, func_codes array<int>, addresses array<int>"


def test_rules_fit_finite_values_only(spark):
    nan, inf = float("nan"), float("inf")
    normal = [(1, 2.0, 1.0, 5.0, [3], [4]), (2, nan, nan, inf, [3], [4]), (3, inf, None, None, [3], [4])]
    fitted = rules.fit_all(spark.createDataFrame(normal, WINDOW))
    assert fitted.first()["max_rate"] == 2.0 and (fitted.first()["low"], fitted.first()["high"]) == (1.0, 5.0)
    hit = rules.apply_all(spark.createDataFrame([(9, 1e9, 0.5, 1e9, [3], [4])], WINDOW), fitted).first()
    assert hit["rate"]["fired"] and hit["pressure"]["fired"] and not hit["protocol"]["fired"]


@pytest.mark.parametrize("rows", [[], [(1, float("nan"), 1.0, 2.0, [3], [4])], [(1, 1.0, None, None, [3], [4])]])
def test_rules_without_finite_values_fail(spark, rows):
    with pytest.raises(Exception, match="no finite value"):
        rules.fit_all(spark.createDataFrame(rows, WINDOW)).collect()


def test_bounds_alone_are_null_without_readings(spark):
    rows = spark.createDataFrame([(1, 1.0, None, None, [3], [4]), (2, 1.0, 0.5, 3.0, [3], [4]), (3, 1.0, 1.5, 2.0, [3], [4])], WINDOW)
    fitted = spark.createDataFrame([(1.0, 4.0)], "low double, high double")
    assert {r["bucket"]: r["outside"] for r in rules.outside(rows, fitted).collect()} == {1: None, 2: True, 3: False}


def test_gates(spark):
    effects = spark.createDataFrame([("a", 0.6, 40), ("b", -0.7, 29), ("c", 0.4, 90)], "feature string, d double, n_true int")
    assert [r["clears_gate"] for r in evaluate.size_gate(effects).orderBy("feature").collect()] == [True, False, False]
    saved = spark.createDataFrame([("a", 0.605), ("b", -0.5), ("x", 0.1)], "feature string, d double")
    assert {r["feature"]: r["within"] for r in evaluate.reproduced(effects, saved, ["feature"]).collect()} == {"a": True, "b": False, "x": False}
    flags = spark.createDataFrame([(1, False), (2, True)], "k int, flag boolean")
    term = spark.createDataFrame([(1, True), (2, False)], "k int, new boolean")
    assert [r["combined"] for r in evaluate.rederived(flags, term, "k", "flag", "new").orderBy("k").collect()] == [True, True]
    with pytest.raises(Exception, match="no term for 2"):
        evaluate.rederived(flags, term.where("k = 1"), "k", "flag", "new").collect()


def test_payload_gate(spark):
    rows = [("x", True, 5.0), ("x", False, 1.0), ("x", False, 2.0), ("y", False, 1.0), ("y", True, None), ("z", True, 1.0), ("z", False, 1.0), ("z", False, 3.0)]
    found = stats.payload_gate(stats.separation(spark.createDataFrame(rows, "k string, g boolean, v double"), "g", "v", ("k",)))
    got = {r["k"]: (r["values_in_common"], r["separated"], r["reasons"], r["passes"]) for r in found.collect()}
    assert got["x"] == (0, True, ["separates perfectly"], False) and got["z"] == (1, False, [], True)
    assert got["y"] == (0, False, ["absent from attacks", "constant among normal rows"], False)


def test_gaps_end_where_told(spark):
    """Frames of other buckets end all stretches; with ``ends`` only those of the told source do."""
    rows = [(i + 1, b, (i + 1) * 1_000_000, 3, s) for i, (b, s) in enumerate([(0, 3), (0, 3), (1, 1), (0, 3), (1, 3), (0, 3), (0, 1)])]
    frames = spark.createDataFrame(rows, "position long, bucket long, ts_us long, function_code int, source int")
    buckets = spark.createDataFrame([(0, True), (1, False)], "bucket long, normal boolean")
    gaps = lambda **how: sorted(r["gap_us"] for r in series.normal_gaps(frames, buckets, **how).collect())
    assert gaps() == [1_000_000, 1_000_000] and gaps(ends=F.col("source") == 3) == [1_000_000, 1_000_000, 2_000_000]
