"""Session set-up shared by the operators: checkpoint folder, package shipping, blank columns."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most text in one Arrow batch: tasks hold a few batches outside the heap.
BATCH_BYTES = 4 << 20
_BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Makes this package importable in executors, bounds Arrow batches and sets a checkpoint folder where there is none.

    A cluster names its shared folder in spark.checkpoint.dir; only where that is unset (local runs, tests) a temporary folder is used.
    """
    context = spark.sparkContext
    if not getattr(context, "_incognita_shipped", False):
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp()) / f"incognita_{uuid.uuid4().hex[:8]}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted((root / "incognita").rglob("*.py")):
                out.write(path, path.relative_to(root))
        context.addPyFile(str(archive))
        context._incognita_shipped = True
    # Spark's default of 64 MB is lowered; a bound that the session has set itself stays.
    if spark.conf.get(_BATCH_BOUND) == "67108864b":
        spark.conf.set(_BATCH_BOUND, BATCH_BYTES)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, which is one machine, may do without a named one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not re.fullmatch("local(\\[.*\\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="incognita-")


class Tables:
    """Steps of one operator, each written as Parquet under the shared folder and read back, which cuts their lineage.

    Columns that a later step does not need are not read, and tables are deleted by drop as soon as nothing reads them.
    Those that a returned DataFrame reads stay, like its checkpoints would.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: others, whatever they are called, can't clash with columns made later."""
    return df.select(*[F.col(f"`{n}`") for n in names])
