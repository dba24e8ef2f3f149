"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(df: DataFrame, most: str = "4m") -> DataFrame:
    """The table, with the session's Arrow batches held to a size: texts of any length then pass through Python in little memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
    return df


@contextmanager
def conf(spark: SparkSession, values: dict[str, str]):
    """Within it, the session has these settings; what it had comes back after."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrow_batches(spark: SparkSession, most: str = "4m", records: int | None = None):
    """Within it, jobs pass rows to Python in batches of at most so many bytes and records; the session's settings come back after."""
    return conf(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": most} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(records)} if records else {}))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="quadrat-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there, and a lost executor loses nothing."""
    at = f"{shared_dir(df.sparkSession)}/quadrat/{what}-{uuid.uuid4().hex}"
    with conf(df.sparkSession, {"spark.sql.maxPlanStringLength": "4096"}):  # the driver keeps the descriptions of a thousand jobs' plans
        df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def forget(df: DataFrame) -> None:
    """Delete a table that ``cut`` wrote, once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay, unlike lower()."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches, rows: int = 256):
    """Arrow batches in slices of a few rows, where each row becomes large in Python."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def word_pieces(data: bytes, carry: int, size: int = 1 << 20):
    """Lists of the words of bytes between single-byte space, each of about ``size`` bytes, with how many words of the list before it begin it."""
    at, last = 0, []
    while at < len(data):
        to = data.find(b" ", at + size)
        to = len(data) if to < 0 else to
        words = data[at:to].split()
        yield last + words, len(last)
        last, at = (last + words)[-carry:], to
