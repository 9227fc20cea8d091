"""Spark sessions and tables of the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "quirelake") -> SparkSession:
    """A session for tests and benchmarks on one machine. On a cluster the caller makes the session."""
    parts = str(cpus) if str(cpus).isdigit() else "8"
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where it is unset (tests on one machine) a temporary folder is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quirelake-")
        spark.conf.set("spark.checkpoint.dir", at)
        _made[at] = spark
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def spool_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def spool(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Write df as Parquet, with the writer's options, into the shared folder and read it back.

    It cuts the lineage with a table that outlives any executor, and keeps a costly stage from
    running once for each of its uses. Unlike a checkpoint the copy is columnar and compressed.
    """
    path = spool_path(df.sparkSession, name)
    w = df.write.mode("overwrite").options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_once: dict[tuple, str] = {}


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def once(spark: SparkSession, sf_dir: str, name: str, of: str, make) -> str:
    """The path of what make writes from a table of a data folder, made once in a session and anew when the table changes.

    make gets a new path in the shared folder. The table is told by its path and the time it was written. What was made is
    made again if someone has cleared the folder.
    """
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{of}.parquet")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = fs.getFileStatus(p)
    key = (spark.sparkContext.applicationId, shared_folder(spark), sf_dir, name, of, status.getModificationTime(), status.getLen())
    made = _once.get(key)
    if made is None or not _there(spark, made):
        path = spool_path(spark, name)
        make(path)
        _once[key] = path
    return _once[key]


def released(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder without repeated rows: written once, so that no query has to shuffle whole rows to find repeats."""
    path = once(spark, sf_dir, f"released-{name}", name, lambda at: table(spark, sf_dir, name).distinct().write.parquet(at))
    return spark.read.parquet(path)
