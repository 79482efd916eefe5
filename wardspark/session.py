"""Session settings and the shared folder."""

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession, functions as F


def build_session(master: str | None = None, app: str = "wardspark", **conf) -> SparkSession:
    """A session with the settings results depend on (UTC) and adaptive plans."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see, for checkpoints and written stages.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session may
    fall back to a scratch folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="wardspark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Spark copies the archive to every executor; the driver's copy is only its source.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    base = f"{tempfile.mkdtemp(prefix='wardspark-')}/wardspark"
    archive = shutil.make_archive(base, "zip", package.parent, package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def broadcast_if_small(df, max_bytes: int = 16 << 20):
    """Broadcast hint for a side that the plan's statistics prove to be small.

    Sizes of tables are those of their files, so no job runs here.  Where the size is
    larger or not known the join is left to Spark, which decides once it has seen the
    data, shuffles, and splits hot keys.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= max_bytes else df


def stage_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path


def write_stage(df, name: str):
    """Write an intermediate table to the shared folder and read it back.

    Later steps then start from files that survive lost executors, and Spark knows
    the table's size when it chooses a join.  The files go when the application ends.
    """
    path = stage_folder(df.sparkSession, name)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_parts(df, name: str, part: str):
    """write_stage with one folder per value of `part`: a filter on it reads only that."""
    path = stage_folder(df.sparkSession, name)
    df.write.mode("append").partitionBy(part).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
