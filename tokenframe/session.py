"""Session helpers: shipping the package, reading tables, and tables between steps in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes a core up to which a table of few files is spread.
SMALL = 32 << 20
#: Bytes of an Arrow batch that goes to the engine's Python workers.
BATCH = 4 << 20
_PACKAGE = Path(__file__).resolve().parent
_shipped: dict[str, str] = {}
_own_dir: list[str] = []


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers as a zip file, once a session; nodes needn't have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.clear()
        path = Path(tempfile.mkdtemp(prefix="tokenframe-")) / "tokenframe.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(_PACKAGE.rglob("*.py")):
                z.write(f, f.relative_to(_PACKAGE.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped[app] = str(path)
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """Let Arrow batches end at BATCH bytes: by rows alone they grow with the tables, and every worker holds several copies."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH:
        spark.conf.set(name, str(BATCH))
    return spark


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, spread over all cores where it is small and has fewer files than they: one row group is one task."""
    df = ship(spark).read.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if held.getFileCount() < cores and held.getLength() < cores * SMALL else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master may leave it unset, and gets a temporary one."""
    conf = spark.sparkContext.getConf()
    at = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not at:
        master = conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="tokenframe-"))
        at = f"file://{_own_dir[0]}"
    return at.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` cut from its lineage: a Parquet table in the shared folder, read again.

    The application owns it: it goes with `drop_written`, or when the application ends.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/tokenframe/{spark.sparkContext.applicationId}"
    path = f"{root}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    fs, at = _hadoop(spark, root)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.tokenframe_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete tables made by `written` that nothing reads any more."""
    for df in tables:
        fs, at = _hadoop(df.sparkSession, df.tokenframe_path)
        fs.delete(at, True)
