"""Session helpers: recommended settings, reliable checkpoints, size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows up to which a narrow per-capture table (ids and a few numbers) may be broadcast.
SMALL_TABLE_ROWS = 200_000


def build_session(app: str = "capturemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; cluster settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of this cluster.

    ``spark.checkpoint.dir`` is honoured.  Where it is unset, a local session keeps its files beside its
    warehouse; on a cluster that is an error, because a machine-local folder would not survive the loss of
    an executor.  Written tables stay until the folder is cleaned.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def counted_side(df: DataFrame, max_rows: int = SMALL_TABLE_ROWS) -> tuple[DataFrame, int]:
    """Materialise a per-group table, broadcast it only when it is proven small, and tell its rows.

    Beyond ``max_rows`` the table is returned without a hint: the join is then a
    shuffle join, whose hot keys adaptive execution splits.
    """
    kept = checkpointed(df)
    rows = kept.count()
    return (F.broadcast(kept) if rows <= max_rows else kept), rows


def small_side(df: DataFrame, max_rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """The table of :func:`counted_side` alone."""
    return counted_side(df, max_rows)[0]
