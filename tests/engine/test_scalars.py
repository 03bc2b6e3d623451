import datetime as dt

from pyspark.sql import functions as F

from larkspur.functions import scalars as S


def test_scalars(spark):
    df = spark.createDataFrame([(1_700_000_000_123, "0123456789abcdef01234567", "x1", [1, 2])], "ms long, oid string, s string, a array<int>")
    got = df.select(
        S.millis(S.datetime(F.col("ms"))).alias("ms"), S.hex_of(S.objectid(F.col("oid"))).alias("oid"), S.objectid(F.col("s")).alias("none"), S.length_of(S.binary(F.col("s"))).alias("n"),
        S.i32(F.col("ms")).alias("big"), S.i32(F.lit(7)).alias("small"), S.is_datetime(S.now()).alias("t"), S.is_datetime(F.col("s")).alias("u"), S.is_objectid(S.objectid(F.col("oid"))).alias("o"),
        S.is_objectid(F.col("s")).alias("p"), S.add(F.lit((1 << 63) - 1), F.lit(1)).alias("sum"), S.append(F.col("a"), F.lit(3)).alias("x"), S.prepend(F.col("a"), F.lit(0)).alias("y"), S.drop_last(F.col("a")).alias("z"),
    ).first()
    assert tuple(got) == (1_700_000_000_123, "0123456789abcdef01234567", None, 2, None, 7, True, False, True, False, 2.0**63, [1, 2, 3], [0, 1, 2], [1])
    assert S.instant(0) == dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
