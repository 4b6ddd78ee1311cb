"""Session settings and shared storage used across the package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch: the setting, Spark's own value, and the one used instead. Texts are long, and a batch is held
#: several times over between a JVM and its worker.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000")


def get_session(app: str = "lacuna", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package's settings; a cluster's own settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        BATCH_ROWS[0]: BATCH_ROWS[2],
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a session on one machine gets a temporary
    folder of its own; on a cluster, whose executors would each write to their own disk, the setting is required."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(context, "_lacuna_shared", None)
        if not found:
            folder = tempfile.mkdtemp(prefix="lacuna-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            found = context._lacuna_shared = f"file://{folder}"
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet into the shared folder and read them back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete materialized tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so that they need no installation."""
    if spark.conf.get(BATCH_ROWS[0]) == BATCH_ROWS[1]:
        spark.conf.set(BATCH_ROWS[0], BATCH_ROWS[2])
    context = spark.sparkContext
    if getattr(context, "_lacuna_shipped", False):
        return
    here = Path(__file__).parent
    folder = Path(tempfile.mkdtemp(prefix="lacuna-"))  # on the driver, which serves the file from here for as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(here, folder / "tree" / here.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(folder / here.name), "zip", folder / "tree"))
    context._lacuna_shipped = True
