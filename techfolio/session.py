"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"


def build_session(app: str = "techfolio", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench. On a cluster the caller's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """Scan of a table whose rows are costly to process, on at least as many partitions as there are cores.

    A table in few small files gives few scan tasks, however long each row's text takes. Large tables have more
    splits than cores and pass unchanged, without a shuffle. Meant for plain scans: planning them runs nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application, as ``--py-files`` would: the few functions
    that run there reach them by the name of their module."""
    context = spark.sparkContext
    if getattr(context, "_techfolio_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="py-files-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._techfolio_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    On a local master without the setting a temporary folder is chosen and set, since driver and executors are one
    process there. On a cluster the setting is required: a machine-local folder would lose rows.
    """
    root = spark.conf.get(_CHECKPOINT, None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set; it has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_CHECKPOINT, root)
    return root.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let ``DataFrame.checkpoint`` write below the shared folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
