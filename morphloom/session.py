"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_WRITTEN: list[str] = []


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("morphloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir`` of the session, or what ``setCheckpointDir`` set.

    Only a local session without either gets a folder of its own; on a cluster
    their absence is an error, since a folder of one machine is of no use there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_dir = spark._jsc.sc().getCheckpointDir()
        named = set_dir.get() if set_dir.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="morphloom-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return "file://" + _OWN[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove, spark)
    _WRITTEN.append(path)
    return path


def _remove(spark: SparkSession) -> None:
    """Remove what ``scratch`` handed out, as far as the JVM still answers."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _WRITTEN:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder's owner cleans up then
        pass


def materialise(df: DataFrame, name: str = "stage", by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: whatever reads the result survives the loss of any
    executor. ``by`` range-sorts nothing; it only names partition columns.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
