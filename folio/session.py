"""Session helpers: defaults for local runs, the folder all executors share, written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "folio", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = spark.conf.get("folio.local.shared", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="folio-")
            spark.conf.set("folio.local.shared", found)
    return found


def fresh_path(spark: SparkSession, tag: str) -> str:
    return os.path.join(shared_dir(spark), f"folio-{tag}-{uuid.uuid4().hex}")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and the table outlives any executor.

    It is deleted when the session's JVM ends, or before by `discard`."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    passing(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def passing(spark: SparkSession, path: str) -> None:
    """Marks a written folder as one that goes with the session."""
    fs, p = _folder(spark, path)
    fs.deleteOnExit(p)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing unfinished reads any more."""
    for df in tables:
        path = getattr(df, "_folio_path", None)
        if path:
            fs, p = _folder(df.sparkSession, path)
            fs.delete(p, True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the session's Python workers, once per session."""
    import pathlib
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_folio_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="folio-code-"), "folio.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._folio_shipped = True
