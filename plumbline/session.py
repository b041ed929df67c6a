"""The session that tests and benches share, and the folder that a cluster shares."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """UTC, ANSI and AQE on; shuffle partitions as many as cores unless said otherwise."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    builder = SparkSession.builder.master(master).appName("plumbline")
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local session
    (one machine) takes a temporary folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return f"file://{tempfile.gettempdir()}/plumbline-shared"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def spread(spark: SparkSession, waves: int = 4) -> int:
    """How many partitions a small table is dealt into before work that is heavy for each row: some for each core, so that all of them work,
    however few files the rows come from."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), waves * spark.sparkContext.defaultParallelism)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage, and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
