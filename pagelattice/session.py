"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "pagelattice", master: str | None = None, partitions: int = 8) -> SparkSession:
    """A session with the settings the plans count on.

    Methods of over 8,000 bytes aren't compiled by the virtual machine: beyond
    that, stages run from their single expressions, which are split.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """The rows dealt over as many tasks as a shuffle has, by the columns; a small file is otherwise read by few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors reach: spark.checkpoint.dir.

    Where that is unset, local mode gets a temporary folder, which goes with the
    process; on a cluster no such folder would be shared, so that's an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="pagelattice-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and cuts the lineage there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def unused(name: str, columns: Iterable[str]) -> str:
    """The name, or the name with underscores behind it, that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_methods(spark: SparkSession, most: int = 8000) -> None:
    """Runs stages whose one generated method would be too large for the virtual machine to compile from their single expressions, which are split.

    Plans read the bound when they run, so it stays set for the session.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name, "65535")) > most:
        spark.conf.set(name, str(most))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds what one Arrow batch of whole texts can hold, by rows and by bytes.

    Plans read the bounds when they run, so they stay set for the session.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        if spark.conf.get(name) != str(most):
            spark.conf.set(name, str(most))
