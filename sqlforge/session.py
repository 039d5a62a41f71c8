"""Session helpers: building a session, loading driver tables, checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

SPREAD_ROWS = 10_000      # rows of a task that makes texts of them


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "sqlforge") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the given session.

    AQE stays on so that shuffle partitions are coalesced at run time and
    skewed join partitions are split.
    """
    master = master or os.environ.get("SQLFORGE_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("SQLFORGE_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SQLFORGE_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting comes from the session and is used as is. Only
    when it is unset and the master is local (tests) a folder of our own is made and set; a
    cluster without it is refused, since executors would write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="sqlforge-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder (for written intermediate tables)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, *parts])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """``df`` dealt to tasks of about ``rows`` rows, if it has more.

    Short rows of which long texts are made lie in one or two splits, however many they are: the work that follows would be
    one or two tasks. The rows are counted (of a Parquet table from its footers) and dealt before the texts are made.
    """
    n = -(-df.count() // rows)
    return df.repartition(n) if n > 1 else df


def register_tables(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES, dealt=()) -> None:
    """Register driver tables as temporary views (lazy: only footers are read); the ``dealt`` ones through :func:`spread`."""
    for name in names:
        df = read_table(spark, sf_dir, name)
        (spread(df) if name in dealt else df).createOrReplaceTempView(name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` (the data survives executor loss),
    but the read-back table makes no claim about its partitioning, so later
    joins plan their own exchanges.
    """
    import uuid
    path = shared_path(df.sparkSession, "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
