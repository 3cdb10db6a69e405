"""Session helpers: building a local session, shared-folder materialisation and parallelism."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex
_dirs: set[str] = set()


def local_session(app: str = "lawloom", cpus: str = "*", shuffle: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder; a cluster session gets an error, because a machine-local
    folder would not survive the loss of an executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lawloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage.

    The table survives the loss of executors; it is removed by :func:`discard` or when the driver ends. With
    ``partitions`` it has a folder for each of their values.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/lawloom-{_RUN}"
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(path)
    if root not in _dirs:
        _dirs.add(root)
        atexit.register(_remove, spark, root)
    table = spark.read.schema(df.schema).parquet(path)
    table._lawloom_folder = path  # for discard()
    return table


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass  # the session is gone; the folder belongs to it


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`materialize` that nothing will read any more."""
    for t in tables:
        _remove(t.sparkSession, t._lawloom_folder)


def parallelism(spark: SparkSession) -> int:
    """Tasks for a stage that runs Python code: never fewer than the cores."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Repartition by ``cols`` into a number of partitions that adaptive execution leaves alone."""
    return df.repartition(parallelism(df.sparkSession), *cols)


#: Bytes a core that a scan must hold to be left as it is; below, its row groups may be too few for all cores.
SPREAD_BELOW = 8 << 20


def balanced(df: DataFrame) -> DataFrame:
    """``df`` for a stage of Python code: repartitioned only if the scan is so small that it would leave cores idle.

    A scan of more than ``SPREAD_BELOW`` bytes a core comes in enough pieces by itself; nothing is shuffled then.
    """
    size = int(df._jdf.queryExecution().analyzed().collectLeaves().head().stats().sizeInBytes())
    return spread(df) if size < SPREAD_BELOW * df.sparkSession.sparkContext.defaultParallelism else df
