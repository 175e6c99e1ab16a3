"""Where lineage cuts and written tables go: the shared folder the cluster names."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and all runs in one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sojourn-ckpt-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_folder(spark)}/sojourn-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors and ends the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str = "rounds") -> DataFrame:
    """The rows as a table in the shared folder, read back: ends the lineage, and unlike a checkpoint
    carries no constraints on, which would grow from round to round of a loop."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kernel_shuffle(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning for a kernel.

    Where shuffles have few partitions for the cores at hand their number is kept, because small
    but costly rows should not be coalesced into one or two tasks by size; else it is left to
    adaptive execution.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n <= 4 * df.sparkSession.sparkContext.defaultParallelism:
        return df.repartition(n, *keys)
    return df.repartition(*keys)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once.

    Not needed where the package is installed on the cluster.
    """
    context = spark.sparkContext
    if getattr(context, "_sojourn_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="sojourn-pkg-")) / "sojourn.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._sojourn_shipped = True
