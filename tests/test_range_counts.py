"""Counts of samples in ranges: right on odd bounds, and no pairs of points and samples, however dense they are."""

from __future__ import annotations

import random

import duckdb
import pytest
from oracle import differences, duck
from pyspark.sql import functions as F

import tidewatch.plans.all  # noqa: F401
from tidewatch.operators import joins
from tidewatch.plans import registry


def most_rows(df) -> int:
    """The most rows that a step of a plan put out, after it ran."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        found = plan.metrics().get("numOutputRows")
        most = max(most, found.get().value() if found.isDefined() else 0)
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_counts_are_those_of_all_pairs(spark):
    pick = random.Random(3)
    samples = [pick.choice([5, 7, 7, 7, *range(0, 200, 3)]) for _ in range(300)]
    points = [(i, pick.randrange(200), pick.choice([None, -20, 0, 1, 30, 500])) for i in range(150)]
    df = spark.createDataFrame(points, "point_id long, ts_us long, width long")
    ranges = {"back": (F.col("ts_us") - 10, F.col("ts_us") - 1), "on": (F.col("ts_us") + 1, F.col("ts_us") + F.col("width"))}
    got = joins.range_counts(df, spark.createDataFrame([(s,) for s in [*samples, None]], "ts_us long"), ranges, 50).collect()
    assert got[0].asDict().keys() == {"point_id", "ts_us", "width", "back", "on"} and len(got) == len(points)
    for r in got:
        assert r["back"] == sum(r["ts_us"] - 10 <= s <= r["ts_us"] - 1 for s in samples)
        assert r["on"] == (0 if r["width"] is None else sum(r["ts_us"] + 1 <= s <= r["ts_us"] + r["width"] for s in samples))


@pytest.fixture(scope="module")
def dense(tmp_path_factory, small) -> str:
    """The small events, all within an hour."""
    home = tmp_path_factory.mktemp("dense")
    duckdb.connect().execute(f"COPY (SELECT * REPLACE (make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + epoch_us(ts) % 3600000000) AS ts) FROM read_parquet('{small}/events.parquet')) TO '{home}/events.parquet' (FORMAT parquet)")
    return str(home)


@pytest.mark.parametrize("name", [
    "range_counts",
    "ack_horizons",
    "ack_coverage",
])
def test_dense_times_make_no_pairs(spark, dense, name):
    df = registry.QUERIES[name](spark, dense)
    assert differences(df, duck(dense), registry.SQL[name]) == ""
    assert most_rows(df) <= 10 * spark.read.parquet(f"{dense}/events.parquet").count()
