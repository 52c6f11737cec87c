"""Byte-level functions on frames, as column expressions on hex text or arrays of byte values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def byte_values(hexed: Column) -> Column:
    """array<int> of the bytes of a hex string of even length."""
    n = F.length(hexed) / 2
    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def crc16(values: Column) -> Column:
    """The serial line's check sum: start 0xFFFF, reflected polynomial 0xA001, a byte at a time."""
    def bit(c: Column, _: Column) -> Column:
        return F.when(c.bitwiseAND(1) == 1, F.shiftright(c, 1).bitwiseXOR(0xA001)).otherwise(F.shiftright(c, 1))
    return F.aggregate(values, F.lit(0xFFFF), lambda c, b: F.aggregate(F.sequence(F.lit(1), F.lit(8)), c.bitwiseXOR(b), bit))


def entropy(values: Column) -> Column:
    """Shannon entropy of an array's values in bits; 0 for an empty one."""
    n = F.size(values).cast("double")
    terms = F.transform(F.array_distinct(values), lambda v: F.size(F.filter(values, lambda x: x == v)) / n)
    return F.when(n > 0, F.abs(F.aggregate(terms, F.lit(0.0), lambda a, p: a - p * F.log2(p)))).otherwise(0.0)


def u16(values: Column, at: int) -> Column:
    """Big-endian unsigned 16 bits from the byte at ``at`` (from 0); null beyond the end."""
    return F.get(values, F.lit(at)) * 256 + F.get(values, F.lit(at + 1))


def float32(values: Column, at: int) -> Column:
    """Big-endian IEEE single at ``at`` as a double: exact arithmetic on its parts; null beyond the end, NaN as NaN."""
    b = [F.get(values, F.lit(at + i)) for i in range(4)]
    sign = F.when(b[0] >= 128, -1.0).otherwise(1.0)
    exponent = (b[0] % 128) * 2 + F.floor(b[1] / 128).cast("int")
    mantissa = (b[1] % 128) * 65536 + b[2] * 256 + b[3]
    normal = (F.lit(1.0) + mantissa / 8388608.0) * F.pow(F.lit(2.0), exponent - 127)
    small = mantissa / 8388608.0 * F.pow(F.lit(2.0), F.lit(-126.0))
    special = F.when(mantissa == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(exponent == 255, special).when(exponent == 0, small).otherwise(normal)


def double_parts(x: Column) -> Column:
    """struct<exponent, mantissa> of a double: the biased exponent and the 52 bits after the point."""
    a = F.abs(x)
    guess = F.floor(F.log2(a)).cast("int")
    e = F.when(a < F.pow(F.lit(2.0), guess), guess - 1).when(a >= F.pow(F.lit(2.0), guess + 1), guess + 1).otherwise(guess)
    normal = F.struct((e + 1023).cast("int").alias("exponent"), ((a / F.pow(F.lit(2.0), e) - 1.0) * 4503599627370496.0).cast("long").alias("mantissa"))
    tiny = F.struct(F.lit(0).alias("exponent"), (a * F.pow(F.lit(2.0), F.lit(537.0)) * F.pow(F.lit(2.0), F.lit(537.0))).cast("long").alias("mantissa"))
    odd = F.struct(F.lit(2047).alias("exponent"), F.when(F.isnan(x), F.lit(1 << 51)).otherwise(F.lit(0)).cast("long").alias("mantissa"))
    return F.when(F.isnan(x) | (a == float("inf")), odd).when(a < 2.2250738585072014e-308, tiny).otherwise(normal)


def trailing_zeros(mantissa: Column) -> Column:
    """Zero bits at the end of a mantissa; 52 for 0."""
    return F.when(mantissa == 0, 52).otherwise(F.bit_count(mantissa.bitwiseAND(-mantissa) - 1))


def grid_distance(x: Column, steps: list[float]) -> Column:
    """Distance to the nearest multiple of any step, ties to even."""
    return F.array_min(F.array(*[F.abs(x / s - F.rint(x / s)) * s for s in steps]))


def fields(values: Column) -> Column:
    """struct of a frame's decoded fields; -1 stands for what the frame doesn't have."""
    n = F.size(values)
    byte = lambda i: F.coalesce(F.get(values, F.lit(i)), F.lit(-1))
    word = lambda i: F.coalesce(u16(values, i), F.lit(-1))
    whole, code, none = n >= 4, F.get(values, F.lit(1)), F.lit(-1)
    read, write = whole & (code == 3), whole & (code == 16)
    read_request, read_answer = read & (n == 8), read & (n != 8)
    write_answer, write_request = write & (n == 8), write & (n >= 9)
    addressed = read_request | write_answer | write_request
    count = F.when(read_answer, byte(2)).when(write_request, byte(6)).otherwise(none)
    crc = F.when(whole & (F.get(values, n - 2) + F.get(values, n - 1) * 256 == crc16(F.slice(values, F.lit(1), F.greatest(n - 2, F.lit(0))))), 1).when(whole, 0).otherwise(none)
    return F.struct(
        byte(0).alias("address"), byte(1).alias("function_code"), n.alias("frame_len_bytes"),
        F.when(read_request | write_request, 1).when(read_answer | write_answer, 0).otherwise(none).alias("is_request"),
        F.when(addressed, word(2)).otherwise(none).alias("start_register"), F.when(addressed, word(4)).otherwise(none).alias("quantity"), count.alias("byte_count"),
        F.when(read_answer, (n != byte(2) + 5).cast("int")).when(write_request, (n != byte(6) + 9).cast("int")).when(whole, 0).otherwise(none).alias("length_anomaly"),
        (~F.coalesce(read | write_answer | write_request, F.lit(False))).cast("int").alias("rare_function_code"), crc.alias("crc_ok"),
    )


def decoded(df: DataFrame, hex_col: str) -> DataFrame:
    """``df`` with a frame's identity, decoded fields and entropy from its hex text."""
    values = df.withColumn("__bytes", byte_values(F.col(hex_col))).withColumn("__fields", fields(F.col("__bytes")))
    return values.select("*", "__fields.*", F.crc32(F.col(hex_col).cast("binary")).alias("frame_id"), entropy(F.col("__bytes")).alias("message_entropy_bits_per_byte")).drop("__fields", "__bytes")


def is_ack(code: Column, length: Column, request: Column) -> Column:
    return (code == 16) & (length == 8) & (request == 0)


def is_reading(code: Column, length: Column, request: Column) -> Column:
    return (code == 3) & (length == 23) & (request == 0)


def undecoded(values: Column) -> Column:
    """The 14 bytes before the reading of a 23-byte answer."""
    return F.slice(values, 4, 14)


def reading(values: Column) -> Column:
    """The reading of a 23-byte answer."""
    return float32(values, 17)
