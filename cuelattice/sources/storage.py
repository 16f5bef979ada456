"""What a job needs on all executors: shared folders, and the package itself."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder of the session; one of this machine where none is named and all runs here, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="shared-")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder there."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in any store that Spark reads; one that is not there is none to delete."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def allow_checkpoints(spark: SparkSession) -> None:
    """Set the folder of checkpoints where the session has none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root(spark))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Python code on executors imports it; a cluster need not have it installed, nor must
    the folder it lies in be on their path.
    """
    context, package = spark.sparkContext, Path(__file__).resolve().parent.parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="package-"), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent).as_posix())
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
