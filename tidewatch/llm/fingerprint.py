"""Threshold-scaled sketches, in DataFrame functions alone.

A document's sketch holds every hash of its word shingles below a fixed fraction of the hash space; unions and
containments of documents of any sizes follow from their sketches alone.  A document with few shingles also keeps its
smallest hashes up to a floor, and the sketch's scale says below which value it is complete, so estimates compare two
sketches below the smaller of their scales.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 8
#: Hashes kept of any document that has so many.
FLOOR = 32
_TOP = (1 << 63) - 1
_SPACE = " \t\n\x0b\x0c\r"


def word_list(text: Column) -> Column:
    """Words between white space (0x20, 0x09-0x0D); none for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\x09-\\x0D]+"))


def sketch(df: DataFrame, text: Column, out: str, *, shingle: int = SHINGLE, scale: int = SCALE, floor: int = FLOOR) -> DataFrame:
    """``df`` with ``out``: struct<scale, hashes>; hashes ascending and distinct, complete below ``scale``.

    Texts with fewer words than a shingle are one shingle; texts without words have no hashes.
    """
    w, h, s = f"__{out}_w", f"__{out}_h", f"__{out}_s"
    df = df.withColumn(w, F.transform(word_list(text), lambda x: F.xxhash64(x)))
    n = F.size(w)
    many = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(F.col(w), i + j) for j in range(shingle)]), 1))
    one = F.array(F.shiftrightunsigned(F.xxhash64(w, F.lit(1)), 1))
    df = df.withColumn(h, F.when(n >= shingle, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(s, F.sort_array(F.array_distinct(F.col(h))))
    limit = _TOP // scale
    below = F.filter(F.col(s), lambda x: x < limit)
    end = F.when(F.size(below) >= floor, F.lit(limit)).when(F.size(s) <= floor, F.lit(_TOP)).otherwise(F.get(F.col(s), F.lit(floor)))
    df = df.withColumn(f"__{out}_e", end)
    kept = F.when(F.col(f"__{out}_e") == _TOP, F.col(s)).otherwise(F.filter(F.col(s), lambda x: x < F.col(f"__{out}_e")))
    return df.withColumn(out, F.struct(F.col(f"__{out}_e").alias("scale"), kept.alias("hashes"))).drop(w, h, s, f"__{out}_e")


def encoded(found: Column) -> Column:
    """A sketch as text: its scale, then its hashes, as 16 hex digits each."""
    return F.concat(F.lpad(F.lower(F.hex(found["scale"])), 16, "0"), F.lit(":"), F.array_join(F.transform(found["hashes"], lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""))


def _common(a: Column, b: Column) -> tuple[Column, Column]:
    end = F.least(a["scale"], b["scale"])
    return tuple(F.filter(x["hashes"], lambda v: (v < end) | (end == _TOP)) for x in (a, b))


def similarity(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches' shingle sets; 1 for two empty ones, 0 for an empty and another."""
    x, y = _common(a, b)
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    return F.when(union == 0, F.when((F.size(a["hashes"]) == 0) & (F.size(b["hashes"]) == 0), 1.0).otherwise(0.0)).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first sketch's shingles that the second has; 1 where the first is empty."""
    x, y = _common(a, b)
    return F.when(F.size(x) == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))


def merged(sketches: Column) -> Column:
    """The sketch of the union of an array of sketches."""
    end = F.array_min(F.transform(sketches, lambda s: s["scale"]))
    every = F.sort_array(F.array_distinct(F.flatten(F.transform(sketches, lambda s: s["hashes"]))))
    return F.struct(end.alias("scale"), F.filter(every, lambda v: (v < end) | (end == _TOP)).alias("hashes"))


def following(ids: DataFrame, *, runs: int | None = None) -> DataFrame:
    """(id, next_id) of distinct ids in ascending order, the first after the last.

    Ids are dealt into ranges and each range is ordered by itself; the ranges' first ids, one for each, close the gaps.
    """
    spark = ids.sparkSession
    runs = runs or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(ids.select("id").repartitionByRange(runs, "id").withColumn("run", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("next_id", F.lead("id").over(Window.partitionBy("run").orderBy("id")))
    firsts = ranged.groupBy("run").agg(F.min("id").alias("first")).orderBy("run").collect()  # one row for each range
    if not firsts:
        return inside.drop("run")
    links = [(r["run"], firsts[(i + 1) % len(firsts)]["first"]) for i, r in enumerate(firsts)]
    later = spark.createDataFrame(links, f"run int, later {ranged.schema['id'].dataType.simpleString()}")
    return inside.join(F.broadcast(later), "run").select("id", F.coalesce("next_id", "later").alias("next_id"))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, scale: int = SCALE, floor: int = FLOOR) -> DataFrame:
    """Sketches of every text and of its edited text, and their likeness; one row per row with an id.

    The edited text ends in the first floor(n/4) characters of the next document (or all of them) in place of its own
    last ones.  Null texts are empty.  Rows with a null id are left out, having no place in the order; of several texts
    with one id the smallest hash stands for the id as a neighbour, and each is compared on its own.  Other columns are
    not read.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = rows.select("id", F.xxhash64("text").alias("key"), F.floor(F.length("text") / 4).cast("int").alias("quarter"))
    ids = written(named.groupBy("id").agg(F.min("key").alias("key"), F.max("quarter").alias("most")), "ids")
    order = following(ids.select("id"))
    wanted = order.join(ids.select("id", "most"), "id").select(F.col("id").alias("prev_id"), F.col("next_id").alias("id"), "most").join(ids.select("id", "key"), "id")
    # the texts are sketched and exchanged once; a neighbour gives its sketch and the head of its text
    base = sketch(rows, F.col("text"), "own", scale=scale, floor=floor)
    heads = base.join(wanted, "id").where(F.xxhash64("text").bitwiseXOR(F.col("key")) == 0)  # no join key, so both uses share one exchange
    heads = heads.select(F.col("prev_id").alias("id"), F.struct(F.expr("substring(text, 1, most)").alias("head"), F.col("own").alias("next")).alias("after"))
    both = base.join(heads.groupBy("id").agg(F.first("after").alias("after")), "id").withColumn("n", F.length("text").cast("long"))
    quarter = F.floor(F.col("n") / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n - floor(n / 4) as int))"), F.col("after.head").substr(F.lit(1), quarter))
    both = both.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("next", F.col("after.next"))
    both = sketch(both, F.col("edited"), "changed", scale=scale, floor=floor)
    return both.select("id", F.col("n").alias("n_chars"), "edited_sha256", "own", "changed", similarity(F.col("own"), F.col("changed")).alias("near_edited"), similarity(F.col("own"), F.col("next")).alias("near_next"))
