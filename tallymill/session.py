"""Session settings the library is measured with, and durable cut points."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Applied by `session()`. Nothing in the library depends on them for right
# results; they only steer the physical plan.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # INT64 timestamps carry row-group statistics, INT96 ones do not: the
    # incremental read filters staging on a timestamp.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


# Codec of what loads write: their copies, and the stored tables.
PACKED = "zstd"


def session(app: str = "tallymill", master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS; `extra` holds further settings, dots written as `__`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`, which all executors share.

    Only a local master, where driver and executors share one disk, may fall back to a
    folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallymill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def durable(df: DataFrame, folder: str | None = None, compression: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and go on from there.

    Lost executors then cost no recompute, later reads take only the columns they need, and
    Spark knows the true size when it picks a join. The session's codec is used unless one is given.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark) + '/tallymill'}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, folder: str | None = None) -> DataFrame:
    """`durable` for the rows of loads, which are many and read few times."""
    return durable(df, folder, PACKED)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of copies that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def cut_points(spark: SparkSession, write: Callable[[DataFrame, str], DataFrame] | None = None,
               ) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """`durable` (or `write`) for steps whose copies are no longer read afterwards: they are deleted then."""
    folder = f"{shared_folder(spark)}/tallymill/{uuid.uuid4().hex}"
    try:
        yield lambda df: (write or durable)(df, folder)
    finally:
        drop_folder(spark, folder)
