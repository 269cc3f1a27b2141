"""Stage tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Frees a write's shuffle files as soon as its table stands; nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_fallback: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only in local mode, where all tasks share the machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _fallback:
        _fallback[key] = tempfile.mkdtemp(prefix="lectern-")
    return _fallback[key]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Stages:
    """Parquet tables that cut lineage; a lost executor costs only the running stage.

    Tables that a returned result still reads stay until the application ends, the
    others until drop(); the shuffle files behind a table go when it is written.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        jvm, conf, root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), self.root

        def clear() -> None:
            with contextlib.suppress(Exception):  # the gateway may be gone with the application
                target = jvm.org.apache.hadoop.fs.Path(root)
                target.getFileSystem(conf).delete(target, True)

        atexit.register(clear)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a table and return the table."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for table in tables:
            _delete(self.spark, table._stage_path)  # type: ignore[attr-defined]
