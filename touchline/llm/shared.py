"""Session helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and the ASCII letters, as the query contracts name them.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="touchline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder, in folders by a column if asked, and reads it back, with true sizes for the optimizer."""
    path = new_path(df.sparkSession, name)
    out = df.write.option("compression", codec)
    (out.partitionBy(by) if by else out).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that no result still to come reads."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Bucketed:
    """A table in sorted buckets of a column, in the shared folder; the session's catalog only knows how it is laid out."""

    def __init__(self, rows: DataFrame, name: str, buckets: int, column: str):
        self.spark, self.name = rows.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
        self.path = new_path(self.spark, name)
        rows.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).format("parquet").option("path", self.path).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        _delete(self.spark, self.path)


#: Rows and bytes of an Arrow batch, at most. Rows are whole texts here, and a batch is held several times over: by the
#: executor's JVM, outside its heap, and by the Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def modest_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches to BATCH_ROWS and BATCH_BYTES; lower ones of the user stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        had = spark.conf.get(name)  # both have defaults in Spark
        if not 0 < _bytes(had) <= most:
            spark.conf.set(name, str(most))


def _bytes(value: str) -> int:
    """A size as Spark writes it: a number, or one with a unit."""
    digits = value.rstrip("bBkKmMgG")
    return int(digits) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(value[len(digits) :].lower().rstrip("b"), 1)


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z and leaves every other letter alone."""
    return F.translate(column, UPPER, LOWER)


def base_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of a caller's table cannot clash with ours."""
    return df.select(*[df[n] for n in names])


def sliced(batches, rows: int = 256):
    """Arrow batches cut into short ones, so that a task turns few texts into Python strings at a time."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()
