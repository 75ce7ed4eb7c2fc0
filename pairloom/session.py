"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_BASE: list[str] = []


def build_session(cpus: int = 8, app: str = "pairloom", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    # one thread of linear algebra for each task: the tasks fill the cores already
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_base(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (tests, a single machine) a folder of our own is
    made and set as the checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_BASE:
        made = tempfile.mkdtemp(prefix="pairloom-")
        atexit.register(shutil.rmtree, made, True)
        _LOCAL_BASE.append("file://" + made)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_LOCAL_BASE[0])
    return _LOCAL_BASE[0]


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{scratch_base(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str, *partition_by: str, options: dict[str, int] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it back:
    the lineage is cut and an executor that is lost takes nothing with it."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    writer = df.write.options(**options or {})
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no later step reads."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver forget shuffles that no plan refers to any more, so that their files go."""
    spark.sparkContext._jvm.System.gc()


def arrow_fs(uri: str):
    """pyarrow's file system and path for a URI of the shared folder; for use in Python workers."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def default_parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def cpu_count() -> int:
    return int(os.environ.get("BENCH_CPUS", "8"))
