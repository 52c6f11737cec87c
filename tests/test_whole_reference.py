"""What windows are compared with is all that is normal: more of it than the samples that were taken before."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from oracle import differences, duck

import tidewatch.plans.all  # noqa: F401
from tidewatch.operators import series, similarity
from tidewatch.plans import registry, residual_plans, series_plans


@pytest.fixture(scope="module")
def calm(tmp_path_factory, medium) -> str:
    """Half of the medium events, attacks in the later half of the time alone."""
    home = tmp_path_factory.mktemp("calm")
    duckdb.connect().execute(f"COPY (SELECT * REPLACE (CASE WHEN ts < TIMESTAMP '2024-01-16' THEN least(value, 100 - event_id % 3) ELSE value END AS value) FROM read_parquet('{medium}/events.parquet') WHERE event_id % 2 = 0 AND (ts >= TIMESTAMP '2024-01-16' OR event_type <> 'error')) TO '{home}/events.parquet' (FORMAT parquet)")
    return str(home)


def test_discords_are_those_of_all_shapes(spark, calm):
    rows = series_plans.labelled(spark, calm).cache()
    known = similarity.distinct_shapes(similarity.subsequences(rows, 15, keep="normal")).withColumn("bucket", similarity.F.lit(0))
    shapes = similarity.normalised(np.array([r["values"] for r in known.collect()]))
    assert len(shapes) > 400
    wanted = {}
    subs = similarity.subsequences(rows, 15)
    for r in subs.collect():
        far = np.sqrt(((shapes - similarity.normalised(np.array(r["values"]))) ** 2).sum(1)).min()
        wanted[r["bucket"]] = max(far, wanted.get(r["bucket"], 0.0))
    for size in (50, similarity.SHAPES):
        assert {r["bucket"]: r["distance"] for r in similarity.discords(subs, known, size).collect()} == pytest.approx(wanted, abs=1e-6)
    df = registry.QUERIES["discords"](spark, calm)
    assert {r["bucket"]: r["distance"] for r in df.collect()} == pytest.approx(wanted, abs=1e-4)
    assert differences(df, duck(calm), registry.SQL["discords"]) == ""


def moved(own: list[float], other: list[float]) -> float:
    """The Wasserstein distance by distribution functions over all values."""
    own, other = np.sort(own), np.sort(other)
    grid = np.sort(np.concatenate((own, other)))
    shares = [np.searchsorted(x, grid[:-1], "right") / max(1, len(x)) for x in (own, other)]
    return float((np.abs(shares[0] - shares[1]) * np.diff(grid)).sum())


@pytest.mark.parametrize("n", [0, 1, 7, 2000])
def test_wasserstein_is_that_to_all(spark, n):
    pick = np.random.default_rng(n)
    buffers = {b: pick.choice([-3.0, 0.0, 1.5, 2.0, *pick.normal(2, 4, 9)], size).tolist() for b, size in enumerate([1, 2, 3, 7, 29, 30, 30, 30])}
    known = [*pick.normal(1, 3, n // 2).tolist(), *pick.choice([0.0, 1.5, 2.0, -9.0], n - n // 2).tolist()]
    got = series.wasserstein(spark.createDataFrame(list(buffers.items()), "bucket long, buffer array<double>"), spark.createDataFrame([(v,) for v in known], "pressure double")).collect()
    assert {r["bucket"]: r["wasserstein"] for r in got} == pytest.approx({b: moved(x, known) for b, x in buffers.items()}, abs=1e-9)


@pytest.fixture(scope="module")
def rows(spark, calm):
    return series_plans.labelled(spark, calm).cache()


@pytest.fixture(scope="module")
def distances(rows) -> dict[int, float]:
    """Each window's distance to all normal readings, of which there are more than 500."""
    known = [r[0] for r in rows.where("normal").select("pressure").collect()]
    assert len(known) > 500
    return {r["bucket"]: moved(r["buffer"], known) for r in series.trailing(rows).collect()}


def test_probed_rows_know_all_normal_readings(spark, calm, distances):
    """What family_probe learns from."""
    got = {r["bucket"]: r["wasserstein_to_train_normal"] for r in residual_plans.full_rows(spark, calm).collect()}
    assert got == pytest.approx(distances, abs=1e-9)


def test_verdict_knows_all_normal_readings(spark, calm, distances, monkeypatch):
    seen = []

    def probe(rows, families):
        seen.append({r["bucket"]: r["wasserstein_to_train_normal"] for r in rows.collect()})
        return spark.createDataFrame([("combined", False, "last_pressure")], "family string, clears_null boolean, top_feature string")

    monkeypatch.setattr(residual_plans.probes, "family_probe", probe)
    assert registry.QUERIES["family_verdict"](spark, calm).first()["verdict"] == "NO-GO-CEILING"
    assert seen[0] and seen[0] == pytest.approx({b: distances[b] for b in seen[0]}, abs=1e-9)


def test_wasserstein_to_normal_is_that_to_all(spark, calm, distances):
    df = registry.QUERIES["wasserstein_to_normal"](spark, calm)
    assert {r["bucket"]: r["wasserstein"] for r in df.collect()} == pytest.approx(distances, abs=1e-4)
    assert differences(df, duck(calm), registry.SQL["wasserstein_to_normal"]) == ""
