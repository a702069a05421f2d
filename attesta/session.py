"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where a later step would like to reuse its partitioning
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_stages: list[str] = []
_made: list[str] = []  # the folder of this process where none is configured


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build(master: str | None = None, shuffle_partitions: int | None = None, app: str = "attesta") -> SparkSession:
    """A session with the options above; master and sizes come from spark-submit on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (local tests) a temporary folder is made, one for the process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="spark-"))
    return _made[0]


def stage_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, which ``clear_stages`` deletes."""
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    _stages.append(path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back.

    Used where several results start from the same rows and in loops. The written
    table cuts the lineage, survives lost executors, and its real size lets Spark
    choose joins by fact; unlike a checkpoint it does not carry the constraints of
    the plan it came from, which grow with every turn of a loop.
    """
    path = stage_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> int:
    """Delete the tables that ``staged`` has written in this process; returns how many.

    To be called when the results that were built on them have been written or read.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    count = 0
    while _stages:
        path = hadoop(_stages.pop())
        count += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return count


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many tasks as there are cores, for steps that cost much CPU per row.

    A scan that already has enough tasks, as any large table has, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
