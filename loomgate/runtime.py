"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors through Spark's file server, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_loomgate_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="loomgate-"), "loomgate_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(path)
    sc._loomgate_shipped = True
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for what a job writes: in spark.checkpoint.dir, or, where that is unset, in a temporary folder in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomgate-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Workspace:
    """Tables that one operation writes for itself: its lineage ends there, so a lost executor repeats tasks and no more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.written = spark, None, {}

    def write(self, df: DataFrame) -> DataFrame:
        self.folder = self.folder or scratch(self.spark, "work")
        path = f"{self.folder}/{len(self.written)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.written[path] = out
        return out

    def remove(self, keep: tuple[DataFrame, ...] = ()) -> None:
        """Delete all tables but those that are a result."""
        for path, df in list(self.written.items()):
            if not any(df is k for k in keep):
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
                del self.written[path]
