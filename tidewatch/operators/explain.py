"""Alert explanations: the features that stand out most against the normal baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words for features in sentences; other names are shown with blanks. Fixed values.
LABELS = {
    "packet_count": "packet count",
    "packets_per_sec": "packet rate",
    "bytes_per_sec": "byte rate",
    "mean_frame_len": "mean frame length",
    "iat_mean": "mean inter-arrival time",
    "iat_std": "inter-arrival-time variability",
    "iat_min": "minimum inter-arrival time",
    "iat_max": "maximum inter-arrival time",
    "frac_func_read": "read-function share",
    "frac_func_write": "write-function share",
    "distinct_frame_ratio": "distinct-frame ratio",
    "repeat_frame_rate": "repeated-frame rate",
    "payload_entropy_mean": "mean payload entropy",
    "payload_entropy_std": "payload-entropy variability",
}


def deviations(features: list[str], top_k: int = 3) -> Column:
    """array<struct<feature, z>> of the ``top_k`` (3 to 5) largest ``z_`` columns by size, ties (to nine digits) in the features' order."""
    if type(top_k) is not int or top_k not in range(3, 6):
        raise ValueError("top_k must be a whole number from 3 to 5")
    every = F.array(*[F.struct((-F.round(F.abs(F.col(f"z_{f}")), 9)).alias("key"), F.lit(i).alias("at"), F.lit(f).alias("feature"), F.col(f"z_{f}").alias("z")) for i, f in enumerate(features)])
    return F.transform(F.slice(F.array_sort(every), 1, top_k), lambda x: F.struct(x["feature"].alias("feature"), x["z"].alias("z"), F.when(x["z"] >= 0, "above").otherwise("below").alias("direction")))


def sentence(top: Column) -> Column:
    """One sentence about the first two deviations. Its words are fixed values."""
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    phrase = lambda d: F.concat(
        F.lit("unusually "), F.when(d["z"] >= 0, "high ").otherwise("low "), F.coalesce(F.try_element_at(names, d["feature"]), F.translate(d["feature"], "_", " ")),
        F.lit(" ("), F.format_string("%.1f", F.abs(d["z"])), F.lit(" standard deviations "), d["direction"], F.lit(" the TRAIN-normal mean)"),
    )
    return F.concat(F.lit("Flagged; the most statistically unusual features were "), F.array_join(F.transform(F.slice(top, 1, 2), phrase), " and "), F.lit("."))


def mechanism(rule: Column, forest: Column) -> Column:
    """What raised an alert; null where nothing did. The names are fixed values."""
    return F.when(rule & forest, "Rule + IF").when(rule, "Rule").when(forest, "IF")


def importances(named: list[tuple[str, float]], spark, causality: DataFrame | None = None, top_k: int = 10) -> DataFrame:
    """The ``top_k`` features of a model by importance, joined with a table (feature, note) of what is known of them: a report."""
    rows = spark.createDataFrame([(n, float(v)) for n, v in named], "feature string, importance double")
    top = rows.orderBy(F.desc("importance"), "feature").limit(top_k)
    return top if causality is None else top.join(causality, "feature", "left")
