"""Session helpers: a local session for tests, and lineage cuts that survive executor loss."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "streetloom", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STREETLOOM_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Only where driver and executors are one process may it be
    unset; a fresh local folder is taken then. On a cluster each executor would write to its own disk, so that is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return named or sc.getCheckpointDir()


#: Deletes the shuffle files of a statement when it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Statements made within delete their shuffle files when they have ended."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the plan above it restarts from replicated files, not from executor blocks. What was shuffled to make it is not
    read again, so those files go as soon as it is written; else all steps of a job would lie on disk until its end."""
    checkpoint_dir(df.sparkSession)
    with freed_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a statement of its own: other uses of ``df`` keep their shuffles


def drop_cut(*cuts: DataFrame) -> None:
    """Deletes the files of cuts that no frame in use reads any more, such as the rounds of a loop before the last."""
    for df in cuts:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            drop_table(df.sparkSession, file.get())


def write_table(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to a new shared folder and read back, with that folder. A checkpoint keeps the size that was guessed for its plan, and
    guesses multiply in joins, which many rounds cannot bear; the size of files is known."""
    path = shared_path(df.sparkSession, "table")
    with freed_shuffles(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for tables that one job hands to the next."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application; Arrow UDFs and the PBF source import it there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "streetloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("streetloom", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
