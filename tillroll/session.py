"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are written for. Skew-join splitting and partition
# coalescing are what keep a hot join key or a thin result from hurting.
SESSION_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

# For a cluster: start from many shuffle partitions and let AQE merge them up
# to the advisory size, so the same setting serves small and large inputs.
CLUSTER_OPTIONS = {
    **SESSION_OPTIONS,
    "spark.sql.shuffle.partitions": "40000",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "512m",
}


def local_session(app: str, cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SESSION_OPTIONS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_session(app: str) -> SparkSession:
    """A session on the cluster that ``spark-submit`` names, with ``CLUSTER_OPTIONS``."""
    return SparkSession.builder.appName(app).config(map=CLUSTER_OPTIONS).getOrCreate()


_local_folders: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Where the setting is absent, a session in local mode gets a temporary
    folder of its own; a cluster session is refused, since a folder on one
    machine would not be visible to the others. So is one that names a local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    folder = folder or context.getCheckpointDir()
    local = context.master.startswith("local")
    if folder:
        if folder.startswith("file:") and not local:
            raise RuntimeError(f"{folder} is on one machine; name a folder all executors share")
        return folder.rstrip("/")
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    application = context.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.TemporaryDirectory(
            prefix="tillroll-", ignore_cleanup_errors=True
        )
    return _local_folders[application].name


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call has been given.

    It lies below the application's id, so what a killed driver left can be found.
    """
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/tillroll/{application}/{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The file system that holds ``path``, and the path as it takes it."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(context._jsc.hadoopConfiguration()), folder


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have written scratch files removed when the application ends.

    A DataFrame that reads them may be run at any time before. A long session can
    ``release`` what it has done with.
    """
    files, folder = file_system(spark, path)
    files.deleteOnExit(folder)


def release(df: DataFrame) -> list[str]:
    """Delete the scratch folders ``df`` reads, now; it cannot be run afterwards.

    Files that are not this application's scratch are left alone. Returns the folders.
    """
    spark = df.sparkSession
    root = f"/tillroll/{spark.sparkContext.applicationId}/"
    folders = set()
    for file in df.inputFiles():
        where, found, rest = file.partition(root)
        if found:
            folders.add(f"{where}{found}{rest.split('/')[0]}")
    for folder in folders:
        files, path = file_system(spark, folder)
        files.delete(path, True)
    return sorted(folders)


def freeze(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The rows are then fixed: a lost executor re-reads files instead of
    re-running, and perhaps re-cutting, the steps before. This runs a job when called.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
