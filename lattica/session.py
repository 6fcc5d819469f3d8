"""Session helpers: tables, lineage cuts, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only while it has at most this many rows and estimated bytes.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 48 << 20


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lattica")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or a private one only where none is named (local masters)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "lattica-scratch")
    return f"{named.rstrip('/')}/lattica-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and the loss of executors loses nothing.

    The rows keep the partitions of their plan, so an input is read and worked on in as many tasks as it has splits; reading packs
    small files together. What was written is dropped by `drop_cut` where a loop has no more use for it, by `clear_cuts` after a
    query's result has been taken, and else at the end of the session.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    # the default committer renames task files one by one; nothing reads the table before it is whole
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._cut_path = path
    if not _at_exit.get(spark.sparkContext.applicationId):
        _at_exit[spark.sparkContext.applicationId] = True
        atexit.register(_quiet_clear, spark, shared_folder(spark))
    return kept


_at_exit: dict[str, bool] = {}


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_cut(*frames: DataFrame | None) -> None:
    """Delete the tables behind frames returned by `cut`; nothing that is still to be computed may read them."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path:
            _delete(df.sparkSession, path)


def clear_cuts(spark: SparkSession) -> None:
    """Delete all intermediate tables of this session, once the results that read them have been taken."""
    _delete(spark, shared_folder(spark))


def _quiet_clear(spark: SparkSession, folder: str) -> None:
    try:
        _delete(spark, folder)
    except Exception:  # noqa: BLE001 - the session is stopped by now; a folder that the driver sees can still be removed
        shutil.rmtree(folder.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that costs far more than moving the rows.

    A scan of many splits stays as it is; only an input of few splits, such as one small file, is moved.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def row_bytes(df: DataFrame) -> int:
    """Bound on a row's bytes by its fixed-width columns; strings count as 64, arrays as 256."""
    width = {"bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8, "int": 4, "date": 4, "boolean": 1}
    return 16 + sum(width.get(kind, 256 if kind.startswith(("array", "map", "struct")) else 64) for _, kind in df.dtypes)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Count up to the bound (never beyond it) and say whether df may be broadcast."""
    limit = max(1, min(max_rows, max_bytes // row_bytes(df)))
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, **bounds: int) -> DataFrame:
    """A broadcast hint where the measured size allows it, else df itself (Spark then shuffles, AQE splits skew)."""
    return F.broadcast(df) if fits_broadcast(df, **bounds) else df
