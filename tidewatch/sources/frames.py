"""Frame logs: the six-field text, attribute-relation files, and the projection of an event table onto frames."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import frame_bytes as fb
from ..operators.ordered import indexed

#: Category numbers of the frame log. Fixed values.
CATEGORIES = {0: "Normal", 1: "NMRI", 2: "CMRI", 3: "MSCI", 4: "MPCI", 5: "MFCI", 6: "DoS", 7: "Recon"}
READ, WRITE, INVALID = 3, 16, 136


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(column: str) -> Column:
    """A time without zone as the same time in UTC, whatever the session's zone."""
    zone = SparkSession.active().conf.get("spark.sql.session.timeZone")
    if zone in ("UTC", "Etc/UTC", "Z", "GMT"):
        return F.col(column).cast("timestamp")
    return F.concat(F.col(column).cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp")


def micros(column: str) -> Column:
    return F.unix_micros(instant(column))


def event_frames(spark: SparkSession, sf_dir: str, *, numbered: bool = True) -> DataFrame:
    """The event table as protocol frames: views and purchases are reads, clicks and signups writes, some errors invalid.

    ``record_index`` counts frames from 1 in time order; unless ``numbered`` it is the event's id, which orders frames of equal
    time alike and needs no pass of its own.
    """
    e = table(spark, sf_dir, "events")
    odd = F.col("event_type") == "error"
    rows = e.select(
        "event_id", "user_id", micros("ts").alias("ts_us"),
        F.when(F.col("event_type").isin("view", "purchase"), READ).when(F.col("event_type").isin("click", "signup"), WRITE).otherwise(F.when(F.col("user_id") % 10 == 0, INVALID).otherwise(WRITE)).alias("function_code"),
        F.when(odd & (F.col("user_id") % 25 == 0), 7).otherwise(4).alias("address"),
        F.when(F.col("event_type") == "signup", 3).otherwise(1).alias("destination"),
        F.length("props").cast("int").alias("props_len"), F.col("props").alias("payload"),
        F.when(odd & (F.col("user_id") % 10 == 0), 5).when((F.col("event_type") == "view") & (F.col("value") > 100), 1).otherwise(0).alias("category"),
        F.when(F.col("event_type").isin("view", "purchase"), F.col("value")).alias("pressure"),
    )
    rows = rows.withColumn("frame_len", F.when(F.col("function_code") == READ, 23).otherwise(F.col("props_len"))).drop("props_len")
    return indexed(rows, "ts_us", "event_id") if numbered else rows.withColumn("record_index", F.col("event_id"))


def read_frames_txt(spark: SparkSession, path: str) -> DataFrame:
    """Frames of six comma-parted fields a line; blank lines and lines that don't parse are dropped.

    ``record_index`` counts kept lines from 1 in file order, ``interarrival_seconds`` is since the kept line before, at least 0.
    """
    raw = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("seq"))
    part = F.split("line", ",", -1)
    hexed = F.trim(part[0])
    rows = raw.where("line <> ''").where(F.size(part) == 6).select(
        "seq", hexed.alias("hex"), F.trim(part[1]).try_cast("int").alias("categorized_attack"),
        F.trim(part[2]).try_cast("int").alias("specific_attack"), F.trim(part[3]).try_cast("int").alias("source"), F.trim(part[4]).try_cast("int").alias("destination"), F.trim(part[5]).try_cast("double").alias("timestamp"),
    )
    rows = rows.where(F.col("hex").rlike("^([0-9A-Fa-f]{2})*$")).dropna(subset=["categorized_attack", "specific_attack", "source", "destination", "timestamp"])
    rows = rows.withColumn("ts_us", F.rint(F.col("timestamp") * 1e6).cast("long"))
    # file order is the order of seq; a file's lines are few against a task's reach or the file is split in order
    rows = indexed(rows.withColumn("zero", F.lit(0)), "seq", "zero")
    prev = rows.select((F.col("record_index") + 1).alias("record_index"), F.col("timestamp").alias("prev_ts"))
    rows = rows.join(prev, "record_index", "left").withColumn("interarrival_seconds", F.coalesce(F.greatest(F.lit(0.0), F.col("timestamp") - F.col("prev_ts")), F.lit(0.0)))
    return fb.decoded(rows.drop("seq", "zero", "prev_ts"), "hex")


def arff_header(lines: list[str]) -> tuple[str | None, list[tuple[str, list[str] | None]], int]:
    """(relation, [(attribute, its nominal values or None)], line number after @data) of an attribute-relation file."""
    relation, attributes = None, []
    for number, line in enumerate(lines):
        text = line.strip()
        word = text.split(None, 1)[0].lower() if text else ""
        if word == "@relation":
            relation = text.split(None, 1)[1].strip("'\"")
        elif word == "@attribute":
            m = re.match(r"""@attribute\s+('([^']*)'|"([^"]*)"|(\S+))\s+(.*)$""", text, re.I)
            if m:
                name = next(g for g in m.groups()[1:4] if g is not None)
                kind = m[5].strip()
                attributes.append((name, [v.strip().strip("'\"") for v in kind[1:-1].split(",")] if kind.startswith("{") else None))
        elif word == "@data":
            return relation, attributes, number + 1
    raise ValueError("no @data line")


def optional_double(text: Column) -> Column:
    """A number, or null for '?', what is no number, infinities and NaN."""
    value = F.trim(text).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


_DATA = "line <> '' and line not like '\\%%' and line not like '@%'"


def read_arff(spark: SparkSession, path: str, mode: str = "drop") -> DataFrame:
    """Rows of an attribute-relation file, numbers as doubles and nominal values as strings; its header gives the schema.

    Rows with another number of cells are left out (``drop``), are an error (``strict``), or are read as far as they go, cells
    that are missing null, with a column ``cells`` of their number (``lenient``).
    """
    if mode not in ("drop", "strict", "lenient"):
        raise ValueError("mode is drop, strict or lenient")
    text = spark.read.text(path)
    head = [r[0] for r in text.where("trim(value) rlike '^(?i)@(relation|attribute|data)'").collect()]  # a line for each attribute
    _, attributes, _ = arff_header(head)
    lines = text.select(F.trim("value").alias("line")).where(_DATA)
    part = F.transform(F.split("line", ",", -1), lambda x: F.regexp_replace(F.trim(x), "^'|'$", ""))
    cells = lines.withColumn("c", part)
    whole = F.size("c") == len(attributes)
    if mode == "strict":
        cells = cells.withColumn("ok", F.assert_true(whole, F.concat(F.lit("wrong number of cells: "), F.col("line")))).where(F.col("ok").isNull())
    elif mode == "drop":
        cells = cells.where(whole)
    at = lambda i: F.get("c", F.lit(i))
    out = [(F.when(at(i) != "?", at(i)) if nominal else optional_double(at(i))).alias(name) for i, (name, nominal) in enumerate(attributes)]
    return cells.select(*out, *([F.size("c").alias("cells")] if mode == "lenient" else []))


def widths(spark: SparkSession, path: str, arff: bool = True) -> DataFrame:
    """(cells, n): how many data lines of a comma-parted file have each number of cells."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where(_DATA if arff else "line <> ''")
    return lines.groupBy(F.size(F.split("line", ",", -1)).alias("cells")).agg(F.count("*").alias("n"))


def frame_bytes_of(frames: DataFrame, hex_col: str = "hex") -> DataFrame:
    """``frames`` with ``bytes``, array<int>: decoded fields leave the bytes out, audits of registers need them."""
    return frames.withColumn("bytes", fb.byte_values(F.col(hex_col)))


def register_bytes(frames: DataFrame, hex_col: str = "hex") -> DataFrame:
    """(record_index, at, value) of the undecoded bytes of egress reading answers, places from 0."""
    own = frame_bytes_of(frames, hex_col).where((F.col("destination") == 1) & fb.is_reading(F.col("function_code"), F.col("frame_len_bytes"), F.col("is_request")))
    return own.select("record_index", F.posexplode(fb.undecoded(F.col("bytes"))).alias("at", "value"))


def acknowledgements(frames: DataFrame) -> DataFrame:
    """(record_index, ts_us, category, specific) of egress write acknowledgements."""
    own = frames.where((F.col("destination") == 1) & fb.is_ack(F.col("function_code"), F.col("frame_len_bytes"), F.col("is_request")))
    return own.select("record_index", "ts_us", F.col("categorized_attack").alias("category"), F.col("specific_attack").alias("specific"))


#: Bytes of a file that a task digests as one value; larger files are read as streams.
WHOLE = 1 << 28


def files_digest(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """(path, bytes, sha256) of every file that is not empty (Spark does not list empty ones).

    Tasks digest files of up to ``whole`` bytes; a larger one goes through a digest of its stream, a buffer at a time, whatever
    its size: a digest has no parts that could be made side by side.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= whole).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    jvm, conf, large = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for r in files.where(F.col("length") > whole).select("path", "length").collect():  # names alone
        place = jvm.org.apache.hadoop.fs.Path(r["path"])
        stream = place.getFileSystem(conf).open(place)
        try:
            large.append((r["path"], r["length"], jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
        finally:
            stream.close()
    return small.unionByName(spark.createDataFrame(large, "path string, bytes long, sha256 string")) if large else small


def checked_files(spark: SparkSession, path: str, expected: dict[str, str]) -> DataFrame:
    """:func:`files_digest`, an error if a file's digest isn't the one pinned for its name."""
    pins = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    name = F.element_at(F.split("path", "/"), -1)
    return files_digest(spark, path).withColumn("ok", F.assert_true(F.coalesce(F.try_element_at(pins, name) == F.col("sha256"), F.lit(False)), F.concat(F.lit("digest differs: "), F.col("path")))).drop("ok")


def membership_digest(train: list[int], validation: list[int]) -> str:
    return hashlib.sha256(json.dumps({"train_bucket_ids": train, "validation_bucket_ids": validation}, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


_IDS = T.ArrayType(T.LongType())
SPLIT = T.StructType([T.StructField("split_id", T.StringType()), T.StructField("membership_sha256", T.StringType()), T.StructField("train_bucket_ids", _IDS), T.StructField("validation_bucket_ids", _IDS), T.StructField("guards", T.StructType([T.StructField("between_train_validation_bucket_ids", _IDS)]))])


def read_split(spark: SparkSession, path: str, split_id: str, pinned: str | None = None) -> DataFrame:
    """(bucket, block) of a split manifest, fail closed: an error if its id, digest (its own, and the ``pinned`` one), blocks, strict
    order, disjointness or chronology is wrong, or the guards aren't exactly the numbers between training and validation.

    A manifest is one document of window numbers, a few bytes for each window of a study.
    """
    rows = spark.read.schema(SPLIT).json(path, multiLine=True).limit(2).collect()
    if len(rows) != 1 or rows[0]["split_id"] != split_id:
        raise ValueError("not the expected split")
    m = rows[0]
    train, validation = m["train_bucket_ids"] or [], m["validation_bucket_ids"] or []
    guard = (m["guards"]["between_train_validation_bucket_ids"] if m["guards"] else None) or []
    if membership_digest(train, validation) != m["membership_sha256"] or pinned not in (None, m["membership_sha256"]):
        raise ValueError("membership digest differs")
    if not train or not validation:
        raise ValueError("a block is empty")
    for ids in (train, validation, guard):
        if any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
            raise ValueError("bucket ids are not in strict order")
    if {*train} & {*validation} or {*guard} & ({*train} | {*validation}) or train[-1] >= validation[0]:
        raise ValueError("blocks overlap")
    if guard != list(range(train[-1] + 1, validation[0])):
        raise ValueError("guards don't fill the gap between the blocks")
    return spark.createDataFrame([(b, name) for name, ids in (("train", train), ("validation", validation), ("guard", guard)) for b in ids], "bucket long, block string")


def csv_profile(spark: SparkSession, path: str, time: str) -> DataFrame:
    """One row for a text table with a header: rows, and the first and last time."""
    rows = spark.read.csv(path, header=True)
    t = F.col(time).try_cast("double")
    return rows.agg(F.count("*").alias("n_rows"), F.min(t).alias("first"), F.max(t).alias("last"))


#: The parts of a frame's shape that tell response types apart.
SHAPE = ["function_code", "is_request", "frame_len_bytes", "byte_count", "length_anomaly"]


def response_types(frames: DataFrame, type_map: DataFrame) -> DataFrame:
    """``frames`` with ``type``: that of its shape in ``type_map`` (the shape's columns and type), null for others and for frames that
    aren't egress from the slave (source 3).  The map has a row for each shape seen in training."""
    known = type_map.select(*SHAPE, F.col("type").alias("__type"))
    rows = frames.join(known, SHAPE, "left")
    return rows.withColumn("type", F.when((F.col("destination") == 1) & (F.col("source") == 3), F.col("__type"))).drop("__type")


def discovered_types(frames: DataFrame, normal: DataFrame) -> DataFrame:
    """Distinct shapes of egress frames from the slave in normal buckets, each with its function code as type."""
    rows = frames.where("destination = 1 and source = 3").join(normal.select("bucket"), "bucket", "left_semi")
    return rows.select(*SHAPE).distinct().withColumn("type", F.col("function_code"))


def iso_utc(ts_us: Column) -> Column:
    """Microseconds since the epoch as text in UTC."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_micros(ts_us), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
