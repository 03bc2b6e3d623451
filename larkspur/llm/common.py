"""What the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import cut, ensure_checkpoint_dir

__all__ = ["arrow_rows", "cut", "forget", "free_name", "hot_keys", "remainder", "sent", "stash", "table"]

#: Rows of an Arrow batch at most, so that a batch of long texts fits in a Python worker.
ARROW_ROWS = 1000
#: Bytes of a table of a few numbers up to which it is sent to the tasks instead of moving texts.
SENT_BYTES = 1 << 14
#: The share of rows in which hot keys are looked for, how often a key has to occur there, and hot keys at most.
HOT_SHARE, HOT_TIMES, HOT_KEYS = 1 / 64, 512, 20_000


def arrow_rows(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers; a smaller bound that is set already stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") or 0) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; null stays null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def stash(df: DataFrame) -> DataFrame:
    """df written as compressed Parquet in the shared checkpoint folder and read again: cut() for what is large."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.parquet(path)
    kept._stash = path
    return kept


def forget(df: DataFrame) -> None:
    """Delete what stash() wrote for df; nothing may read it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stash)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sent(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, a materialised table of a few numbers a row, with the hint to send it to the tasks if it is small."""
    return F.broadcast(df) if df.count() * 8 * (len(df.columns) + 1) <= (SENT_BYTES if most is None else most) else df


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores added as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_keys(some: DataFrame, key: str) -> DataFrame | None:
    """The keys that occur most in some, a sample of rows, with a column hot that is true; None if none is frequent.

    This only says which keys to split over tasks; every row is kept whether its key is among them or not. At most
    HOT_KEYS keys are returned, so the table can be sent to the tasks.
    """
    counts = cut(some.groupBy(key).count().where(F.col("count") >= HOT_TIMES))
    total = counts.agg(F.sum("count")).first()[0]
    if not total:
        return None
    return F.broadcast(counts.where(F.col("count") >= total / HOT_KEYS).select(key, F.lit(True).alias("hot")))
