"""Session helpers shared by tests, the bench and the queries."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings every query is written for (AQE, UTC)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path goes to Spark's reader untouched, whatever the file system."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch, where the session has Spark's own default: texts are long, and a batch is held several
#: times over by the JVM and by Python.
BATCH_KEY, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def shipped(df: DataFrame) -> DataFrame:
    """`df`, after sending this package to the executors (once for each context): Python tasks need no installation."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)
    if not getattr(context, "_sparkloom_shipped", False):
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="sparkloom-code-")  # on the driver, whose file server hands it out
        atexit.register(shutil.rmtree, folder, True)
        with zipfile.ZipFile(f"{folder}/sparkloom.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(f"{folder}/sparkloom.zip")
        context._sparkloom_shipped = True
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, which driver and executors share.

    Only a local session that names none, as in tests, gets a temporary one of its own; a cluster without one is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder:
        if made.isEmpty():
            spark.sparkContext.setCheckpointDir(folder)
        return folder.rstrip("/")
    if made.isDefined():
        return made.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="sparkloom-checkpoint-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: cuts lineage, compressed and by column.

    The folder goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    df.write.parquet(path)
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's setting by which a query's shuffle files go when it has ended, not when the driver's garbage is collected.
FREE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored_alone(df: DataFrame) -> DataFrame:
    """`stored`, and the shuffle files that `df` was made from go at once: they don't lie beside those of the next step."""
    conf = df.sparkSession.conf
    before = conf.get(FREE_KEY, None)
    conf.set(FREE_KEY, "true")
    try:
        return stored(df)
    finally:
        conf.unset(FREE_KEY) if before is None else conf.set(FREE_KEY, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
