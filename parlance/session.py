"""Session builder and table loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "parlance") -> SparkSession:
    """A session for tests and benches. On a cluster use the session that spark-submit configures."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of an Arrow batch sent to Python, where the session does not set it: texts are long, and a worker holds a batch several times over.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, for the operators that run Python there; bound Arrow batches."""
    import tempfile
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_parlance_shipped", False):
        return
    if not context.getConf().contains(ARROW_BYTES[0]):
        spark.conf.set(*ARROW_BYTES)
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="parlance-")) / "parlance.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    context.addPyFile(str(path))
    context._parlance_shipped = True
