"""The session every local run uses; on a cluster, submit with the same settings."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[*]", name: str = "millrace", **extra: str) -> SparkSession:
    """A session with SETTINGS; ``extra`` maps setting names (dots as ``__``) to values."""
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One Parquet table of a data folder, read through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows, per: int = 5000):
    """The rows of a small file dealt to a task for every ``per`` of them: a file of few bytes is one scan task, however much work its rows are."""
    n = -(-rows.count() // per)
    return rows.repartition(n) if n > 1 else rows


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; in local mode a temporary folder where that is unset."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"
