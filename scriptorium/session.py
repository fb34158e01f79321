"""Session helpers shared by the queries, the tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def reach(spark: SparkSession) -> SparkSession:
    """``spark``, whose Python workers will find this package wherever they are started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, path]))
    return spark


def local_session(cores: int = 8, name: str = "scriptorium") -> SparkSession:
    """A session for one machine; on a cluster use the session that is given."""
    return reach(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: the one that ``spark.checkpoint.dir`` names.

    Where that is unset, a session on one machine gets a temporary folder of its own; on a cluster, whose
    machines couldn't read one another's, it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    made = tempfile.mkdtemp(prefix="checkpoint-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Has Spark remove the shuffle files of a plan as soon as it has run.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, tidy: bool = False, placed: bool = False) -> DataFrame:
    """``df``, written to the shared folder, without its lineage.

    Files go when the frame is no longer used, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    With ``tidy`` the shuffle files that it was made from go at once, and not when the driver collects its garbage.
    With ``placed`` as well, joins on the column that ``df`` is repartitioned by don't move it again; an adaptive plan forgets that.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    if not tidy:
        return df.checkpoint()
    wanted = {TIDY: "true"} | ({"spark.sql.adaptive.enabled": "false"} if placed else {})
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        return df.select("*").checkpoint()  # a plan of its own, which is made under these settings
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def drop(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut`` gave; nothing may read it, or what rests on it, any more."""
    context = df.sparkSession.sparkContext
    name = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work in Python that dwarfs the scan.

    A table of few files would otherwise be worked on by few tasks; one that has enough partitions isn't moved.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
