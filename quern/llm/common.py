"""What the operators share: words, table access, tables written to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"

_scratch: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null, empty and blank texts."""
    spaced = F.coalesce(text, F.lit(""))
    for c in SPACE[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only in local mode."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="quern-")
    return f"file://{_scratch[app]}"


#: With this, Spark removes an execution's shuffle files at its end; a table that is written needs them no longer.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Cut lineage: df as a Parquet table in the shared folder, removed by forget() or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Remove tables of written() that nothing will read again."""
    for df in tables:
        own = (df.sparkSession, df._quern_path)
        _remove(*own)
        _written.remove(own)


@atexit.register
def drop_written() -> None:
    """Remove the tables that written() made in this process. Call it once their readers are done."""
    while _written:
        try:
            _remove(*_written.pop())
        except Exception:  # the session has ended; the folder's owner clears it
            pass
