"""Session helper shared by the tests, the bench and the command line."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tracefold", cores: str | int = "*", **conf: str) -> SparkSession:
    """A session with UTC time, AQE on and a shuffle width that suits a single machine.

    On a cluster, build the session from its own settings instead; no operator of this
    package depends on the values set here beyond the UTC time zone.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", os.environ.get("TRACEFOLD_SHUFFLE", "8"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local session may leave it unset and gets one of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tracefold.shared.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tracefold-')}"
        spark.conf.set("tracefold.shared.dir", found)
    return found.rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed inside go with the end of its execution.

    Else they stay until the driver happens to collect its garbage, beside those of all
    that follows, although a written table reads them no more.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it is computed once, here, and the shuffle files of that go with it."""
    path = f"{shared_dir(df.sparkSession)}/tracefold/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.options(compression="zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tracefold/" in file:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that Python workers find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_tracefold_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # the driver serves the archive from here
    for source in package.rglob("*.py"):
        target = Path(folder, "all", package.name, source.relative_to(package))
        target.parent.mkdir(parents=True, exist_ok=True)
        shutil.copyfile(source, target)
    sc.addPyFile(shutil.make_archive(f"{folder}/tracefold-{os.getpid()}", "zip", f"{folder}/all"))
    sc._tracefold_shipped = True
