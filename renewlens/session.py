"""Session defaults. The library itself never keeps a global session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # runtime Bloom filters of at most 16 MB before the shuffle of tables over 1 GB
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1g",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "8g",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "16000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "134217728",
    # no call-site capture per column: plans here have hundreds of expressions
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "renewlens", **conf: str) -> SparkSession:
    """A session with the defaults above; the cluster's own settings win for everything else."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, which a cluster has to name.

    A session whose only executor is this process, as in tests, gets a temporary folder where the
    setting is missing.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="renewlens-"))
    return context.getCheckpointDir()


def ensure_checkpointing(spark: SparkSession) -> None:
    """Let iterative fits cut their lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back.

    Used where a derived table feeds several branches. The files outlive lost executors, cut the
    lineage, and carry sizes that let the planner choose joins for the rest of the plan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`stage`, with the number of rows as the writing job has counted them on the way."""
    seen = Observation()
    staged = stage(df.observe(seen, F.count(F.lit(1)).alias("n_rows")))
    return staged, seen.get["n_rows"]


def release(spark: SparkSession) -> None:
    """Delete all that this application has staged; tables read from it are gone afterwards."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/stage-{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
