"""Session settings and durable intermediate tables.

Intermediate results are parquet tables in the shared folder named by
``spark.checkpoint.dir``: unlike cached blocks they survive lost executors,
and unlike ``checkpoint()`` they are columnar and compressed.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def local_session(cores: int = 8, shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillspark")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where the master is one machine."""
    conf = spark.sparkContext.getConf()
    where = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="quillspark-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        where = _OWN[0]
    return where


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it from there: cuts the lineage for good.

    The table is deleted when the session's JVM ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "quillspark", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    written = spark._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(written)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, megabytes: int = 16) -> None:
    """Bound the bytes of an Arrow batch, so that very long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session; where they have it already nothing changes."""
    context = spark.sparkContext
    if getattr(context, "_quillspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quillspark-")) / "quillspark.zip"
    atexit.register(shutil.rmtree, archive.parent, True)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path("quillspark") / path.relative_to(root))
    context.addPyFile(str(archive))
    context._quillspark_shipped = True
