"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule here, as a class body for Java, RE2 and Python patterns.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where that is unset a local session (tests) gets a
    temporary one; on a cluster no local folder can stand in for it, so there the setting must be given."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="touchline-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; it survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """From now on Arrow batches to Python hold about ``size`` bytes at most, so that long texts don't fill a worker's memory."""
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) or "-1"
    digits = "".join(c for c in now if c.isdigit() or c == "-")
    if not now.rstrip("bB").lstrip("-").isdigit() or int(digits) <= 0 or int(digits) > size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def word_count(text: Column) -> Column:
    """Words of a text as BIGINT; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_crc(col: str) -> Column:
    """CRC-32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def sample_edge(rows: int, total: int) -> int:
    """A signed 64-bit hash is at most this for about ``rows`` of ``total`` rows, however many there are."""
    return (rows << 64) // total - (1 << 63) - 1


def bounded_sample(df: DataFrame, rows: int, *, by: list[str]) -> DataFrame:
    """About ``rows`` rows, chosen by the hash of ``by`` alone, so that reruns agree; all rows if there are no more.

    ``by`` should tell rows apart (an id): rows that agree in it are taken or left together."""
    total = df.count()
    if total <= rows:
        return df
    return df.filter(F.xxhash64(*by) <= sample_edge(rows, total))
