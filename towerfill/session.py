"""Session helpers: sane defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "towerfill", shuffle_partitions: int | None = None,
              **conf: str) -> SparkSession:
    """Build (or reuse) a session with the defaults this library assumes.

    The master, the memory and the number of shuffle partitions are the
    deployment's, unless the caller names them.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**DEFAULT_CONF, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A deployment has to set it (a shared file system). Only a session inside one
    machine (a ``local`` master, as in tests) gets a folder of its own if it is unset.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="towerfill-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir()
    return d


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (never a machine-local temp dir)."""
    return os.path.join(checkpoint_dir(spark), *parts)


def cut_lineage(df: DataFrame, name: str = "stage", rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    This ends the lineage (later jobs and retries after a lost executor start from
    the files, not from the upstream shuffles) and, unlike ``Dataset.checkpoint``,
    computes the frame once and stores it columnar. The folders of a session lie
    together (``stages_path``); ``drop_stages`` removes them once their readers are done.
    ``rows_per_file`` (0: no bound) lets later jobs read in more tasks than wrote.
    """
    spark = df.sparkSession
    path = f"{stages_path(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.parquet(path)


def stages_path(spark: SparkSession) -> str:
    """The folder of this application's stages."""
    return scratch_path(spark, "stages", spark.sparkContext.applicationId)


def drop_stages(spark: SparkSession) -> None:
    """Delete this application's stage folders; frames that still read them can't be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stages_path(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def make_folder(spark: SparkSession, folder: str) -> str:
    """Create ``folder`` through Spark's file systems; returns its full URI (``scheme://...``)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    uri = files.makeQualified(path).toString()
    return uri if "://" in uri else uri.replace(":/", ":///", 1)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for sessions whose workers can't import it (else: ``--py-files``)."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    zipped = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="towerfill-py-"), "towerfill"), "zip", root, "towerfill")
    spark.sparkContext.addPyFile(zipped)
