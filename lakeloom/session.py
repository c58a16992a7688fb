"""Code shipping and tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
BATCH_ROWS, MOST_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_lakeloom_shipped", False):
        return
    folder = tempfile.mkdtemp()
    path = os.path.join(folder, f"{PACKAGE.name}_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(PACKAGE.rglob("*.py")):
            out.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(path)
    sc._lakeloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset, a temporary one in local mode only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        jdir = sc._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lakeloom_shared_")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/lakeloom/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors.

    Rows go to Python workers a thousand at a time meanwhile, unless the session asks for fewer: whole texts and sets are large.
    """
    path, conf = scratch(df.sparkSession, what), df.sparkSession.conf
    given = conf.get(BATCH_ROWS)
    few = 0 < int(given) < MOST_BATCH_ROWS
    conf.set(BATCH_ROWS, given if few else str(MOST_BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        conf.set(BATCH_ROWS, given)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lakeloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, through the Hadoop file system they are on."""
    for df in tables:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df._lakeloom_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
