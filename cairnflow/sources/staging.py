"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[weakref.ref, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a folder of this machine only where none is named, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cairnflow-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as parquet to the shared folder and read from there.

    Cuts the lineage: what follows can be computed again from the table after the loss of an executor, and several
    readers don't compute ``df`` more than once. Tables are removed when the driver ends, or by ``clear``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((weakref.ref(spark), path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def clear() -> None:
    """Removes all tables staged so far. For long sessions, between jobs: results that read them must be written by then."""
    while _written:
        ref, path = _written.pop()
        try:
            spark = ref()
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; the cluster's own cleaning is left
            pass
