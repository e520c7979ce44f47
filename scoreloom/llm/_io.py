"""Tables in, intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths that this driver made and nobody has deleted yet, with the session's JVM and Hadoop configuration.
_made: dict[str, tuple] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table, through Spark's own readers (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only in local mode, where driver and executors are one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/scoreloom"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when this driver ends if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = (spark._jvm, spark._jsc.hadoopConfiguration())
    return path


def saved(df: DataFrame, name: str, slim: str = "", **options) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends there and a lost executor costs no rerun.

    slim: rows of a few numbers, of which a few files a core are written at most: "light" if
    little work makes them, "heavy" if much does, which then keeps its own tasks.
    """
    if slim:
        files = max(16, 2 * df.sparkSession.sparkContext.defaultParallelism)
        df = df.coalesce(files) if slim == "light" else df.repartition(files)
    path = fresh(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scoreloom_path = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _deleted(path: str, jvm, conf) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)
    _made.pop(path, None)


def drop(df_or_path, spark: SparkSession | None = None) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    path = df_or_path if isinstance(df_or_path, str) else df_or_path._scoreloom_path
    spark = spark or df_or_path.sparkSession
    _deleted(path, spark._jvm, spark._jsc.hadoopConfiguration())


@atexit.register
def _tidy() -> None:
    """Results are read lazily, so what they read goes only with the driver. A JVM that is gone already leaves its folder."""
    for path, (jvm, conf) in list(_made.items()):
        with contextlib.suppress(Exception):
            _deleted(path, jvm, conf)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Files of a finished query's shuffles go at once instead of when the driver collects garbage."""
    old = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if old is None else spark.conf.set(_CLEAN, old)
