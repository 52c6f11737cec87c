"""Readers, manifests, reports and replays."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from tidewatch.sources import frames, sinks
from tidewatch.streaming import live
from tidewatch.operators import windows

ARFF = "% a comment\n" * 1500 + "@relation r\n@attribute a numeric\n@attribute 'b c' {x,y}\n% more\n@data\n1,x\n?,y\n2\n\n3,x,9\n% end\n4,'y'\n"


def test_arff_modes(spark, tmp_path):
    (tmp_path / "f.arff").write_text(ARFF)
    path = f"file://{tmp_path}/f.arff"
    assert sorted((r["a"], r["b c"]) for r in frames.read_arff(spark, path).na.fill(-1.0).collect()) == [(-1.0, "y"), (1.0, "x"), (4.0, "y")]
    loose = sorted((r["cells"], r["a"] if r["a"] is not None else -1, str(r["b c"])) for r in frames.read_arff(spark, path, "lenient").collect())
    assert loose == [(1, 2.0, "None"), (2, -1, "y"), (2, 1.0, "x"), (2, 4.0, "y"), (3, 3.0, "x")]
    with pytest.raises(Exception, match="wrong number of cells"):
        frames.read_arff(spark, path, "strict").collect()
    assert {r["cells"]: r["n"] for r in frames.widths(spark, path).collect()} == {1: 1, 2: 3, 3: 1}


def manifest(**change) -> dict:
    train, validation = change.pop("train", [1, 2, 5]), change.pop("validation", [8, 9])
    out = {"split_id": "s", "train_bucket_ids": train, "validation_bucket_ids": validation, "guards": {"between_train_validation_bucket_ids": [6, 7]}, "membership_sha256": frames.membership_digest(train, validation)}
    return out | change


def test_split_manifest(spark, tmp_path):
    def read(value, pinned=None):
        (tmp_path / "m.json").write_text(json.dumps(value))
        return frames.read_split(spark, f"file://{tmp_path}/m.json", "s", pinned)

    got = {r["bucket"]: r["block"] for r in read(manifest(), manifest()["membership_sha256"]).collect()}
    assert got == {1: "train", 2: "train", 5: "train", 6: "guard", 7: "guard", 8: "validation", 9: "validation"}
    for wrong, why in [
        (manifest(split_id="t"), "not the expected"), (manifest(membership_sha256="0"), "digest"), (manifest(train=[]), "empty"), (manifest(validation=[]), "empty"), (manifest(train=[2, 1, 5]), "order"),
        (manifest(train=[1, 2, 8]), "overlap"), (manifest(guards={"between_train_validation_bucket_ids": [6]}), "gap"), (manifest(guards=None), "gap"),
    ]:
        with pytest.raises(ValueError, match=why):
            read(wrong)
    with pytest.raises(ValueError, match="digest"):
        read(manifest(), "other")


def test_reports_replace_the_old_file_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/r.json"
    for value in ({"a": 1}, {"a": 2, "b": [float("nan")]}):
        sinks.write_report(spark, value, path)
        assert json.loads((tmp_path / "r.json").read_text())["a"] == value["a"]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["r.json"]


def test_register_bytes_and_acknowledgements(spark, tmp_path):
    reading = "04031210000e000c7600000000000000003f308d3e3044"
    (tmp_path / "f.txt").write_text(f"{reading},0,0,3,1,1.0\n0410000a000121ef,2,9,3,1,2.5\n{reading},0,0,1,3,3.0\n")
    rows = frames.read_frames_txt(spark, f"file://{tmp_path}/f.txt")
    got = {(r["record_index"], r["at"]): r["value"] for r in frames.register_bytes(rows).collect()}
    assert len(got) == 14 and got[1, 0] == 0x10 and got[1, 2] == 0x0E
    acks = frames.acknowledgements(rows).collect()
    assert [(r["record_index"], r["category"], r["specific"]) for r in acks] == [(2, 2, 9)]


def test_frames_up_to_a_window(spark):
    rows = spark.createDataFrame([(i, i * 1_000_000) for i in range(20)], "i int, ts_us long")
    assert windows.until(rows, 2, 5_000_000).agg(F.max("i")).first()[0] == 14


def test_replay_gives_the_table_in_order(spark):
    rows = [(i, f"2024-01-0{1 + i // 8} 0{i % 8}:00:00", i % 3, "view", float(i), "{}") for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("t")).drop("t")
    stream = live.replayed(events, "ts", 86_400, 3600.0)
    got = live.drained(live.tumbling(stream, "1 day", "0 seconds"), "replay", "complete")
    assert sorted(r["n"] for r in got.collect()) == [8] * 5
    assert live.pace(86_400, 3600.0) == 24.0 and live.drained(stream.where("false"), "none").count() == 0
    with pytest.raises(ValueError):
        live.pace(1, 0)


def test_streamed_alerts_equal_the_batch_and_late_ones_are_left_out(spark):
    import random

    pick = random.Random(1)
    rows = [(k, i, pick.random() < 0.6) for k in "ab" for i in range(120)]
    table = spark.createDataFrame(rows, "key string, position long, fired boolean").withColumn("ts", F.timestamp_seconds(F.col("position") * 3600))
    stream = live.replayed(table, "ts", 86_400, 1.0, "alerts")
    got = live.drained(live.deduplicated(stream, "key"), "dedup", "update", keys=("key", "position"))
    want = set()
    for k in "ab":
        want |= {(k, r["position"], r["length"], r["severity"]) for r in live.consecutive(table.where(F.col("key") == k)).collect()}
    assert {(r["key"], r["position"], r["length"], r["severity"]) for r in got.collect()} == want
    again = table.where("position < 24").withColumn("ts", F.timestamp_seconds(F.col("position") * 3600 + 20 * 86_400))
    both = live.drained(live.deduplicated(live.replayed(table.unionByName(again), "ts", 86_400, 1.0, "alerts"), "key"), "dedup", "update", keys=("key", "position"))
    assert {(r["key"], r["position"], r["length"], r["severity"]) for r in both.collect()} == want


def test_state_of_silent_keys_expires(spark):
    """A key that is silent for longer than the expiry starts anew; without expiry its sum goes on."""
    rows = [("a", 0), ("a", 10), ("b", 5000), ("b", 9000), ("b", 20_000), ("a", 20_010), ("a", 20_020)]
    table = spark.createDataFrame(rows, "key string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    run = lambda **how: {r["key"]: (r["n"], r["state"]) for r in live.drained(live.cusum(live.replayed(table, "ts", 4000, 1.0, "silent"), "key", 5.0, 5.0, **how), "silent", "update", keys=("key",)).collect()}
    assert run()["a"] == (4, pytest.approx(0.5 + (20_000 - 5) / 5 - 0.5 + 0.5))
    assert run(late="0 seconds", expire_s=3000)["a"] == (2, pytest.approx(0.5))


def test_reports_say_no_to_long_tables(spark):
    from tidewatch.sources import sinks

    assert sinks.markdown(spark.range(3), "t").count("\n") == 7
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(4), "t", most=3)


def test_digests_of_streams_equal_those_of_values(spark, tmp_path):
    import hashlib

    for i in range(1, 4):
        (tmp_path / f"f{i}.bin").write_bytes(bytes([i]) * (1000 * i))
    for whole in (0, 1500, 1 << 28):
        got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in frames.files_digest(spark, f"file://{tmp_path}", whole).collect()}
        assert got == {f"f{i}.bin": (1000 * i, hashlib.sha256(bytes([i]) * (1000 * i)).hexdigest()) for i in range(1, 4)}


def test_dashboard(spark, small):
    from tidewatch.plans.audit_plans import dashboard

    tables = dashboard(spark, small)
    assert set(tables) == {"metrics", "timeline", "explanations", "categories"} and tables["metrics"].count() == 1
    assert tables["timeline"].where("flagged").count() == tables["explanations"].select("bucket").distinct().count()
