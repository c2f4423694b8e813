"""Sessions, the shared folder for cut lineage, and reading of the supplied tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings a local session starts with. On a cluster the submitter's own settings win.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("diffloom")
    conf = LOCAL_CONF | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory}
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; a cluster without that path needs ``--py-files``."""
    env = spark.sparkContext.environment
    home = str(Path(__file__).resolve().parents[1])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables: a parquet file or folder."""
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it gets a temporary folder. A cluster without it is
    refused, as a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local_folder()
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


_LOCAL: list[str] = []


def _local_folder() -> str:
    if not _LOCAL:
        holder = tempfile.TemporaryDirectory(prefix="diffloom-", ignore_cleanup_errors=True)
        atexit.register(holder.cleanup)
        _LOCAL.append("file://" + holder.name)
    return _LOCAL[0]


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_sorted(df: DataFrame, *keys: str) -> DataFrame:
    """:func:`cut` with the rows hash-partitioned by the first of ``keys`` and sorted by all, which later plans know of and needn't do again.

    An adaptive plan tells nobody how its result is partitioned, so this one step isn't planned adaptively.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), keys[0]).sortWithinPartitions(*keys))
    finally:
        conf.set(name, before)


def release(df: DataFrame) -> None:
    """Delete what :func:`cut` stored for ``df``, when neither it nor a frame made of it that isn't stored itself will be read again."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRDD":
        stored = plan.rdd().getCheckpointFile()
        if stored.isDefined():
            remove(df.sparkSession, stored.get())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system Spark knows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spool(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as a parquet table in the shared folder and read back.

    Unlike :func:`cut` the result keeps column pruning, filter pushdown and size statistics.
    The folder lives until the process or the cluster's shared folder is cleaned up.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    _SPOOLED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_SPOOLED: list[tuple[SparkSession, str]] = []


@atexit.register
def clear_spooled() -> None:
    """Delete what :func:`spool` wrote; call it when no frame read from there is in use any more."""
    while _SPOOLED:
        spark, path = _SPOOLED.pop()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before
            return


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder below the shared one that is gone afterwards."""
    path = new_path(spark, name)
    try:
        yield path
    finally:
        remove(spark, path)


def env_sf_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
