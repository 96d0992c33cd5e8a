"""Written steps: tables in the folder that all executors share, which cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the session leaves it unset a temporary folder is set on a local master (tests, one machine); on a cluster that is
    an error, as no executor would see the others' files.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir")
    if found:
        return found
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="memlayer-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Spark then removes an execution's shuffle files when it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is planned and run in here leaves no shuffle files behind; the session's own setting holds again afterwards."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage (a lost executor costs nothing that was written) and keeps costly
    columns from being computed twice. The shuffle files of the writing are removed at once, as
    nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/memlayer/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.select("*").write.parquet(path)  # planned anew, as a frame keeps the setting it was made under
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize`."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    if "/memlayer/" in path.toString():
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
