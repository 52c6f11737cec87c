"""Small cases whose results are known."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import frame_bytes as fb
from tidewatch.operators import evaluate, explain, joins, models, ordered, rules, series, similarity, splits, stats, windows
from tidewatch.sources import frames, sinks
from tidewatch.streaming import live

S = 1_000_000


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    return spark.createDataFrame([tuple(v for _, v in values.values()) or (1,)], kinds).select(column.alias("v")).first()["v"]


def points(spark, values, start=0):
    return spark.createDataFrame([(i + 1, int(t * S), float(p), int(t // 5)) for i, (t, p) in enumerate(values, start)], "position long, ts_us long, pressure double, bucket long")


def test_a_reading_frame(spark):
    text = "04031210000e000c7600000000000000003f308d3e3044"
    row = fb.decoded(spark.createDataFrame([(text,)], "hex string"), "hex").withColumn("b", fb.byte_values(F.col("hex"))).withColumn("r", fb.reading(F.col("b"))).withColumn("u", fb.undecoded(F.col("b"))).first()
    assert (row["frame_len_bytes"], row["function_code"], row["is_request"], row["byte_count"], row["length_anomaly"]) == (23, 3, 0, 18, 0)
    assert row["r"] == pytest.approx(0.689655, rel=1e-3) and bytes(row["u"]).hex() == "10000e000c760000000000000000"


def test_short_and_odd_frames(spark):
    rows = {r["hex"]: r for r in fb.decoded(spark.createDataFrame([("",), ("04",), ("0403",), ("042b0000",), ("04100000000a0b0c",), ("041000",), ("0410000000",)], "hex string"), "hex").collect()}
    assert [(rows[h]["rare_function_code"], rows[h]["address"], rows[h]["function_code"], rows[h]["crc_ok"]) for h in ("", "04", "0403")] == [(1, -1, -1, -1), (1, 4, -1, -1), (1, 4, 3, -1)]
    assert rows["042b0000"]["rare_function_code"] == 1 and rows["04100000000a0b0c"]["quantity"] == 10 and rows["0410000000"]["rare_function_code"] == 1


def test_checksum_against_python(spark):
    def crc(data: bytes) -> int:
        c = 0xFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ 0xA001 if c & 1 else c >> 1
        return c

    texts = ["", "00", "010203", "ff" * 30, "0403006b0003"]
    got = [r["v"] for r in spark.createDataFrame([(t,) for t in texts], "h string").select(fb.crc16(fb.byte_values(F.col("h"))).alias("v")).collect()]
    assert got == [crc(bytes.fromhex(t)) for t in texts]


def test_singles_and_doubles(spark):
    for value in (0.0, -1.5, 1e-40, 3.4e38, float("inf"), 0.1):
        raw = list(np.array([value], ">f4").tobytes())
        assert one(spark, fb.float32(F.col("b"), 0), b=("array<int>", raw)) == float(np.float32(value))
    values = [1.0, 2.0, 4.0, 0.1, 123.456, 5e-324, 0.0, 1e308]
    rows = spark.createDataFrame([(v,) for v in values], "x double").withColumn("p", fb.double_parts(F.col("x"))).select("x", "p.*", fb.trailing_zeros(F.col("p.mantissa")).alias("z")).collect()
    for r in rows:
        bits = int(np.float64(r["x"]).view(np.uint64))
        assert (r["exponent"], r["mantissa"]) == ((bits >> 52) & 2047, bits & ((1 << 52) - 1))
    assert [r["z"] for r in rows[:3]] == [52, 52, 52]


def test_entropy_and_grid(spark):
    assert one(spark, fb.entropy(F.col("a")), a=("array<int>", [5, 5, 5, 5])) == 0 and one(spark, fb.entropy(F.col("a")), a=("array<int>", [0, 1, 0, 1])) == 1
    assert one(spark, fb.entropy(F.col("a")), a=("array<int>", [])) == 0
    assert one(spark, fb.grid_distance(F.col("x"), [0.1, 1.0]), x=("double", 1.05)) == pytest.approx(0.05)


def test_gap_values(spark):
    v = series.gap_values(F.col("g"), F.lit(2.0), F.lit(0.5))
    assert one(spark, F.struct(*[c.alias(n) for n, c in v.items()]), g=("double", 6.1)) == pytest.approx((4.1, 4.1, 8.2, 2.0))


def test_cumulative_sums(spark):
    events = spark.createDataFrame([(3, i + 1, int(t * S), int(t // 5)) for i, t in enumerate((0.1, 3.1, 5.1, 8.1))], "function_code int, position long, ts_us long, bucket long")
    base = spark.createDataFrame([(3, 2.0, 0.5)], "function_code int, expected double, scale double")
    got = [r["cusum"] for r in series.cusum(events, base).orderBy("position").collect()]
    assert got == pytest.approx([0.0, 1.5, 1.0, 2.5])
    reset = series.cusum_reset(events, base, spark.createDataFrame([(3, 1.5)], "function_code int, threshold double")).orderBy("position").collect()
    assert [(r["alarm"], r["cusum_end"]) for r in reset] == [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0), (1.0, 0.0)]


def test_contiguous_blocks(spark):
    rows = splits.contiguous(spark.range(100).select(F.col("id").alias("bucket"))).collect()
    at = {b: sorted(r["position"] for r in rows if r["block"] == b) for b in ("train", "validation", "test", "guard")}
    assert (at["train"][-1], at["validation"][0], at["validation"][-1], at["test"][0], at["guard"]) == (58, 61, 78, 81, [59, 60, 79, 80])


def test_step_rates(spark):
    rows = series.step_rates(points(spark, [(0, 10), (2, 16), (5, 16), (5, 99), (9, 8)])).orderBy("position").collect()
    assert [r["rate"] for r in rows] == [None, 3.0, 0.0, None, 22.75]


def test_robust_z(spark):
    rows = series.robust_z(points(spark, [(i, p) for i, p in enumerate((1, 2, 3, 100))]), 3).orderBy("position").collect()
    assert [r["z"] for r in rows[:3]] == [None] * 3 and rows[3]["z"] == pytest.approx(98 / (1 + 1e-6))


def test_sessions_and_runs(spark):
    rows = windows.sessions(points(spark, [(t, 0) for t in (0, 3, 6, 20, 23)]), 5 * S).orderBy("position").collect()
    assert [r["session"] for r in rows] == [0, 0, 0, 1, 1]
    for gap, n in ((2.0, 1), (2.01, 2)):
        assert windows.sessions(points(spark, [(0, 0), (gap, 0)]), 2 * S).select("session").distinct().count() == n


def test_warping():
    assert similarity.warped(np.array([0.0, 2.0]), np.array([[0.0, 0.0]])).tolist() == [2.0]


def test_range_counts(spark):
    samples = spark.createDataFrame([(int(t * S),) for t in (69.9, 70, 85, 99.9, 100, 100.1, 105, 110, 110.1)], "ts_us long")
    ack = spark.createDataFrame([(1, 100 * S)], "point_id long, ts_us long")
    t = F.col("ts_us")
    got = joins.range_counts(ack, samples, {"before": (t - 30 * S, t - 1), "after": (t + 1, t + 10 * S)}, 7 * S).first()
    assert (got["before"], got["after"]) == (3, 3)


def test_lags(spark):
    rows = series.lags(spark.createDataFrame([(i, float(i), "a") for i in range(7)], "position long, v double, block string"), "v").orderBy("position").collect()
    r = rows[0]
    assert [r[f"lag_{i}"] for i in range(1, 6)] == [4, 3, 2, 1, 0] and (r["slope"], r["direction"], r["variance"], len(rows)) == (1, 1, 2, 2)


def test_nearest_takes_the_later_of_two(spark):
    rows = spark.createDataFrame([(5,), (100,), (0,)], "k long")
    got = {r["k"]: r["match"] for r in joins.nearest(rows, spark.createDataFrame([(3,), (7,), (40,)], "k long"), "k", slice_=4).collect()}
    assert got == {5: 7, 100: 40, 0: 3}


def test_rules(spark):
    kind = "bucket long, func_codes array<int>, addresses array<int>"
    fitted = rules.fit_protocol(spark.createDataFrame([(i, [3, 16], [4]) for i in range(20)], kind))
    got = {r["bucket"]: r["protocol"]["reasons"] for r in rules.protocol(spark.createDataFrame([(1, [3, 0x88, 0x2B], [4]), (2, [0x2B], [9]), (3, [3], [4])], kind), fitted).collect()}
    assert got == {1: ["invalid_function_code=0x2b,0x88"], 2: ["invalid_function_code=0x2b", "novel_address=9"], 3: []}
    bounds = rules.fit_bounds(spark.createDataFrame([(0.8,), (float("nan"),), (None,), (20.0,)], "v double"), "v")
    hits = [tuple(r["pressure"]) for r in rules.bounds(spark.createDataFrame([(0.8, 20.0), (0.5, 30.0), (None, None)], "p_min double, p_max double"), bounds).collect()]
    assert hits == [(False, []), (True, ["pressure_below_train_normal_min=0.5<0.8", "pressure_above_train_normal_max=30>20"]), (False, [])]
    with pytest.raises(Exception, match="no finite value"):
        rules.fit_bounds(spark.createDataFrame([(None,)], "v double"), "v").collect()


def test_explanations(spark):
    feats = ["packets_per_sec", "bytes_per_sec", "iat_mean", "payload_entropy_mean"]
    row = spark.createDataFrame([(-7.0, 4.0, 3.0, -6.0)], ", ".join(f"z_{f} double" for f in feats)).select(explain.deviations(feats, 4).alias("d")).select("d", explain.sentence(F.col("d")).alias("s")).first()
    assert [d["feature"] for d in row["d"]] == ["packets_per_sec", "payload_entropy_mean", "bytes_per_sec", "iat_mean"]
    assert row["s"] == "Flagged; the most statistically unusual features were unusually low packet rate (7.0 standard deviations below the TRAIN-normal mean) and unusually low mean payload entropy (6.0 standard deviations below the TRAIN-normal mean)."
    for bad in (2, 6, True):
        with pytest.raises(ValueError):
            explain.deviations(feats, bad)


def test_floods(spark):
    kind = "bucket long, ts_us long, record_index long, payload string, frame_len int, function_code int, category int, address int, entropy double"
    base = spark.createDataFrame([(0, i * S, i, f"p{i}", 10, 3, 0, 4, 1.0) for i in range(4)], kind)
    a, b = (windows.feature_windows(similarity.flood(base, 5, p, 5 * S).drop("bucket"), 5 * S).first() for p in "AB")
    assert a["packet_count"] == 20 and a["iat_std"] == 0 and a["distinct_frame_ratio"] == 1 and b["distinct_frame_ratio"] == 0.2
    assert similarity.flood(base, 1, "A", 5 * S).count() == 4


def test_verdicts_and_thresholds(spark):
    f = lambda *v: one(spark, evaluate.verdict(*map(F.lit, v)))
    assert [f(0.25, 0.003, 0.97), f(0.3, 0.0031, 0.98)[:4], f(0.15, 0.001, 0.98)] == ["STRONG", "WEAK", "ACCEPTABLE"]
    scores = spark.createDataFrame([(float(i),) for i in range(100)], "s double")
    assert tuple(evaluate.fit_threshold(scores, "s", 0.05).first()) == (95.0, 0.04)
    assert tuple(evaluate.fit_threshold(scores, "s", 0.001).first()) == (99.0 + 1e-9, 0.0)


def test_higher_quantile(spark):
    rows = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    assert series.higher_quantile(rows, "v", 0.99, ["k"]).first()["quantile"] == 99


def test_global_order_in_slices(spark):
    rows = spark.createDataFrame([(int(t), i) for i, t in enumerate(np.random.default_rng(1).integers(0, 1000, 300))], "ts long, tie long")
    got = [r["record_index"] for r in ordered.indexed(rows, "ts", "tie").orderBy("ts", "tie").collect()]
    assert got == list(range(1, 301))
    summed = ordered.running_sum(ordered.indexed(rows, "ts", "tie"), "record_index", F.col("tie"), "s", block=11).orderBy("record_index").collect()
    assert [r["s"] for r in summed] == np.cumsum([r["tie"] for r in summed]).tolist()
    lagged = ordered.with_frame(ordered.indexed(rows, "ts", "tie"), "record_index", 3, {"b": F.lag("tie", 3).over(ordered.over("record_index"))}, block=7).orderBy("record_index").collect()
    assert [r["b"] for r in lagged] == [None] * 3 + [r["tie"] for r in lagged[:-3]]


def test_frame_text(spark, tmp_path):
    lines = ["04030000,0,0,3,1,10.0", "", "bad,line", "0410,1,2,3,1,9.5", "zz,0,0,3,1,1", "0403,x,0,3,1,1", " 0403 ,6,0,1,3,12.25 ", "a,b,c,d,e,f,g"]
    (tmp_path / "log.txt").write_text("\n".join(lines))
    rows = frames.read_frames_txt(spark, f"file://{tmp_path}/log.txt").orderBy("record_index").collect()
    assert [(r["record_index"], r["hex"], r["interarrival_seconds"]) for r in rows] == [(1, "04030000", 0.0), (2, "0410", 0.0), (3, "0403", 2.75)]


def test_attribute_files(spark, tmp_path):
    (tmp_path / "a.arff").write_text("% note\n@relation 'gas line'\n@attribute 'system mode' real\n@attribute result {'0','1'}\n@data\n% more\n1.5,0\n?,'1'\n\ninf,0\n")
    relation, attributes, _ = frames.arff_header((tmp_path / "a.arff").read_text().split("\n"))
    assert relation == "gas line" and attributes == [("system mode", None), ("result", ["0", "1"])]
    assert sorted((str(r[0]), r[1]) for r in frames.read_arff(spark, f"file://{tmp_path}/a.arff").collect()) == [("1.5", "0"), ("None", "0"), ("None", "1")]
    with pytest.raises(ValueError):
        frames.arff_header(["@relation x"])


def test_manifest(spark, tmp_path):
    good = {"split_id": "s1", "train_bucket_ids": [1, 2], "validation_bucket_ids": [5, 6], "guards": {"between_train_validation_bucket_ids": [3, 4]}, "membership_sha256": frames.membership_digest([1, 2], [5, 6])}
    path = tmp_path / "split.json"
    path.write_text(json.dumps(good))
    assert frames.read_split(spark, f"file://{path}", "s1").count() == 6
    for bad in ({"split_id": "other"}, {"train_bucket_ids": [1, 9]}, {"guards": {"between_train_validation_bucket_ids": [2]}}):
        path.write_text(json.dumps(good | bad))
        with pytest.raises(ValueError):
            frames.read_split(spark, f"file://{path}", "s1")


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/r.json"
    sinks.write_report(spark, {"a": float("nan")}, path)
    sinks.write_report(spark, {"a": {3, 1}}, path)
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": [1, 3]}
    once = f"file://{tmp_path}/once.json"
    digest = sinks.write_once(spark, {"b": 1}, once)
    assert len(digest) == 64 and sinks.read_envelope(spark, once) == {"b": 1}
    with pytest.raises(Exception):
        sinks.write_once(spark, {"b": 1}, once)
    (tmp_path / "bad.json").write_text((tmp_path / "once.json").read_text().replace('"b":1', '"b":2'))
    with pytest.raises(ValueError):
        sinks.read_envelope(spark, f"file://{tmp_path}/bad.json")
    sinks.write_features(spark.createDataFrame([(1, 0.5)], "a int, b double"), f"file://{tmp_path}/csv")
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).first()["b"] == "0.500000"
    assert sinks.markdown(spark.createDataFrame([(1, 0.5)], "a int, b double"), "t").count("|") > 5


def test_alignment(spark):
    left = spark.createDataFrame([(1, 1), (2, 1)], "record_index long, destination int")
    assert joins.aligned(left, left, ["destination"]).count() == 2
    with pytest.raises(Exception, match="rows differ"):
        joins.aligned(left, left.where("record_index = 1"), ["destination"]).collect()


def test_forest_ranks_outliers():
    x = np.random.default_rng(3).normal(size=(500, 3))
    forest = models.IsolationForest(100, 256, 1).fit(x)
    scores = forest.score(np.concatenate((x, [[9.0, 9.0, 9.0]])))
    assert scores[-1] == scores.max() and 0 < scores.min() and scores.max() <= 1 and forest.fingerprint() == models.IsolationForest(100, 256, 1).fit(x).fingerprint()
    assert models.average_path(256) == pytest.approx(2 * (math.log(255) + np.euler_gamma) - 2 * 255 / 256)


@pytest.mark.parametrize("method", ["smote", "borderline", "adasyn"])
def test_oversampling_evens_the_classes(spark, method):
    pick = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, int(i < 12), *map(float, pick.normal(size=2) + (i < 12))) for i in range(80)], "k long, y int, a double, b double")
    out = models.oversample(rows, ["a", "b"], "y", "k", method=method).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in out} == {0: 68, 1: 68}


def test_effect_sizes_differ_by_convention(spark):
    rows = spark.createDataFrame([("f", True, 1.0), ("f", True, 3.0), ("f", False, 0.0), ("f", False, 1.0), ("f", False, 5.0)], "feature string, g boolean, value double")
    a, b = stats.cohens_d(rows, "g").first()["d"], stats.cohens_d(rows, "g", sample=True).first()["d"]
    assert a == pytest.approx(0.0) and b == pytest.approx(0.0)
    shifted = rows.withColumn("value", F.when(F.col("g"), F.col("value") + 3).otherwise(F.col("value")))
    assert stats.cohens_d(shifted, "g").first()["d"] == pytest.approx(3 / math.sqrt((1 + 14 / 3) / 2))
    assert stats.cohens_d(shifted, "g", sample=True).first()["d"] == pytest.approx(3 / math.sqrt((2 + 14) / 3))


def test_resampling(spark):
    events = spark.createDataFrame([(i, i % 2) for i in range(9)], "event long, label int")
    draws = evaluate.bootstrap(events, 5, 1)
    assert draws.count() == 45 and draws.groupBy("replicate").count().where("count <> 9").count() == 0
    mixed = evaluate.permute(events, 5, 1)
    assert mixed.count() == 45 and {r["s"] for r in mixed.groupBy("replicate").agg(F.sum("label").alias("s")).collect()} == {4}


def test_late_events_are_left_out(spark, tmp_path):
    kind = live.EVENTS
    from datetime import datetime, timedelta

    base = datetime(2024, 1, 1)
    for i, minutes in enumerate(([0, 10, 300], [310], [5, 400], [800])):
        spark.createDataFrame([(i * 10 + k, base + timedelta(minutes=m), 1, "view", 1.0, "{}") for k, m in enumerate(minutes)], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    stream = live.tumbling(live.event_stream(spark, str(tmp_path)), "1 hour", "10 minutes")
    got = {r["start_us"]: r["n"] for r in live.drained(stream, "late_events", "append", f"file://{tmp_path}/check").collect()}
    assert got[1704067200 * S] == 2  # the event of minute 5 came after the watermark had passed its window


def test_consecutive_alerts(spark):
    rows = spark.createDataFrame([(i, i in (2, 3, 4, 9)) for i in range(12)], "position long, fired boolean")
    assert sorted((r["position"], r["length"], r["severity"]) for r in live.consecutive(rows).collect()) == [(2, 3, 2), (9, 1, 1)]
