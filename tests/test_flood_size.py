"""Floods: the right frames at any rate, with work that grows with the frames made."""

from __future__ import annotations

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import similarity

WIDTH = 3_600_000_000


@pytest.mark.parametrize("times", [0.5, 1.5, 2, 5])
@pytest.mark.parametrize("profile", "AB")
def test_frames_come_in_turn(spark, times, profile):
    sizes = {3: 1, 4: 7, 9: 12}
    base = spark.createDataFrame([(b, b * WIDTH + 5 * i, i, f"p{i}") for b, n in sizes.items() for i in range(n)], "bucket long, ts_us long, record_index long, payload string")
    made = Counter((r["bucket"], r["ts_us"], r["record_index"], r["payload"]) for r in similarity.flood(base, times, profile, WIDTH).collect())
    wanted = Counter()
    for b, n in sizes.items():
        target = round(n * times)
        wanted.update((b, b * WIDTH + int(i * WIDTH / target), i, f"p{i % n}" + (f"#{i}" if profile == "A" else "")) for i in range(target))
    assert made == wanted


def test_a_full_bucket_takes_no_pairs(spark):
    base = spark.range(20_000).select(F.lit(0).cast("long").alias("bucket"), F.col("id").alias("ts_us"), F.col("id").alias("record_index"), F.lit("p").alias("payload"))
    start = time.monotonic()
    got = similarity.flood(base, 5, "A", WIDTH).agg(F.count("*"), F.count_distinct("payload")).first()
    assert tuple(got) == (100_000, 100_000) and time.monotonic() - start < 60
