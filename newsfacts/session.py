"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "newsfacts", master: str | None = None, cores: int = 8) -> SparkSession:
    """Session for tests and benchmarks; on a cluster the submitter's settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.sql.shuffle.partitions", str(cores)).config(
                "spark.driver.memory", "12g"
            )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="newsfacts-")
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/newsfacts/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of a job that stores its rows are deleted when it ends, since what follows reads the stored rows."""
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later passes re-read stored rows instead of recomputing them."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    with tidy(df.sparkSession):
        return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Store a table as Parquet in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Scratch:
    """Tables that a job stores for itself, deleted at its end: what it returns must not read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_error) -> None:
        for folder in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """As :func:`written`."""
        self.paths.append(new_path(self.spark, name))
        with tidy(self.spark):
            df.write.parquet(self.paths[-1])
        return self.spark.read.parquet(self.paths[-1])


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that Python tasks can import it there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    staging = tempfile.mkdtemp(prefix="newsfacts-ship-")  # read by the driver only
    archive = shutil.make_archive(
        os.path.join(staging, "newsfacts-package"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
