"""Sinks: feature tables as text, reports and envelopes written at once or once only."""

from __future__ import annotations

import hashlib
import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table as comma-separated text with a header, doubles with six decimals."""
    cells = [F.format_string("%.6f", F.col(n)).alias(n) if t == "double" else F.col(n).cast("string").alias(n) for n, t in df.dtypes]
    df.select(*cells).write.mode(mode).csv(path, header=True)


def plain(value):
    """Strict JSON: sets in order, numbers that aren't finite as null, rows and arrays as their contents."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted(plain(v) for v in value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value


def encoded(value) -> str:
    """The one canonical text of a value: keys in order, no blanks."""
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), allow_nan=False)


def _put(spark: SparkSession, text: str, path: str, once: bool) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if once:
        out = fs.create(target, False)  # fails if the file is there
        out.write(bytearray(text.encode()))
        out.close()
        return
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(part, target, how)


def write_report(spark: SparkSession, value, path: str) -> None:
    """A small report as JSON: readers see the old file or the new one whole."""
    _put(spark, json.dumps(plain(value), indent=2, sort_keys=True, allow_nan=False), path, once=False)


def write_once(spark: SparkSession, value, path: str) -> str:
    """A result in an envelope with its checksum; an error if the file is there already.  Returns the checksum."""
    payload = encoded(value)
    digest = hashlib.sha256(payload.encode()).hexdigest()
    _put(spark, json.dumps({"sha256": digest, "payload": json.loads(payload)}, sort_keys=True, separators=(",", ":")), path, once=True)
    return digest


def begin_attempt(spark: SparkSession, path: str, token: str, expected: str) -> None:
    """Enters a single attempt in its ledger; an error on a wrong token or a second attempt."""
    if token != expected:
        raise ValueError("wrong confirmation")
    _put(spark, encoded({"attempt": 1}), path, once=True)


def read_envelope(spark: SparkSession, path: str):
    """A payload from :func:`write_once`; an error if it doesn't match its checksum."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    got = json.loads(text)
    if hashlib.sha256(encoded(got["payload"]).encode()).hexdigest() != got["sha256"]:
        raise ValueError("checksum differs")
    return got["payload"]


def save_reference(values: DataFrame, column: str, path: str, least: int = 500) -> int:
    """The distinct values of a column in order, as a table; an error for fewer than ``least`` rows."""
    n = values.where(F.col(column).isNotNull()).count()
    if n < least:
        raise ValueError("too few values for a reference")
    values.where(F.col(column).isNotNull()).select(column).distinct().sort(column).write.mode("errorifexists").parquet(path)
    return n


def save_model(spark: SparkSession, model, path: str, features: list[str], threshold: float, fingerprint: str) -> None:
    """A fitted model with its features, threshold and fingerprint beside it."""
    model.write().save(f"{path}/model")
    write_once(spark, {"features": features, "threshold": threshold, "fingerprint": fingerprint}, f"{path}/meta.json")


def load_model(spark: SparkSession, path: str, kind, fingerprint) -> tuple[object, dict]:
    """The model and what was saved with it; an error if its trees aren't those that were saved."""
    meta = read_envelope(spark, f"{path}/meta.json")
    model = kind.load(f"{path}/model")
    if fingerprint(model) != meta["fingerprint"]:
        raise ValueError("model differs from its fingerprint")
    return model, meta


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A small table as text; an error if it has more than ``most`` rows, for which files are the place."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    return "\n".join(lines) + "\n"
