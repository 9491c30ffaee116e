"""Session helpers: reading tables, shipping code to executors, cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def build_session(cores: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context; they need no copy of the repository."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="foliolens-")) / "foliolens.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, f"foliolens/{p.relative_to(_PACKAGE)}")
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written as Parquet to the shared checkpoint folder and read back.

    Unlike a checkpoint it is compressed and read by column. The folders are deleted
    when the session's program ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = sc._jsc.sc().getCheckpointDir()
    base = folder.get() if not folder.isEmpty() else spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="foliolens-tables-")
    path = f"{base}/table-{uuid.uuid4().hex}"
    # shuffle files of earlier steps are let go when the driver collects its garbage
    sc._jvm.System.gc()
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    sc._jvm.System.gc()
    return spark.read.parquet(path)


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already
            return
