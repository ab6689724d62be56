"""Session construction and the shared folder used for cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "latchline", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings every plan here assumes (UTC, AQE, Arrow)."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LATCHLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once per context, wherever they run and whatever their path holds."""
    sc = spark.sparkContext
    if getattr(sc, "_latchline_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="latchline-code-")) / "latchline.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f"latchline/{f.relative_to(package)}")
    sc.addPyFile(str(archive))
    sc._latchline_shipped = True


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Stored timestamps carry no zone and mean UTC, so every plan reads them in UTC."""
    ship(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local master may do without and gets a temporary one.

    A cluster without ``spark.checkpoint.dir`` is refused: each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="latchline-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir() or own


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder, in one folder per application (see ``drop_stored``)."""
    return f"{shared_dir(spark).rstrip('/')}/latchline-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def drop_stored(spark: SparkSession) -> None:
    """Deletes every table this application has stored; frames that still read them must be done."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/latchline-{spark.sparkContext.applicationId}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (column-pruned, splittable).

    With ``by`` the files are laid out by those columns, so that filters on them skip the others.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    out = df.write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan for Python work: cut into as many parts as there are cores where files give fewer."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan._jdf.rdd().getNumPartitions() >= cores else scan.repartition(cores)
