"""Tables written between the steps of an operator.

They go to the folder that the session names in ``spark.checkpoint.dir``, which driver
and executors share, so a lost executor costs a re-read and not a recomputation.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a table is written: shuffle files go with the job, and Arrow batches stay small, as rows can be large.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_paths: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one only for a local master, where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="priceguard-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, with its scheme, so that Spark and Arrow mean the same store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/priceguard/{name}-{uuid.uuid4().hex}")
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage.

    The shuffle files of the writing job go at its end, so an operator of many steps holds
    its written tables and one step's shuffles.  ``by`` names a column to partition the table by.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])
    _paths[id(out)] = (out, path)
    return out


def discard(table: DataFrame, part: str | None = None) -> None:
    """Delete a table that ``materialize`` returned, or one partition of it, once nothing reads it any more."""
    _, path = _paths.get(id(table), (None, None)) if part else _paths.pop(id(table), (None, None))
    if path:
        jvm = table.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
        target.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def renamed(table: DataFrame, **names: str) -> DataFrame:
    """A written table with other column names, which ``discard`` knows too."""
    out = table.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in table.columns])
    _, path = _paths.pop(id(table))
    _paths[id(out)] = (out, path)
    return out


def sliced(batches, rows: int = 256):
    """Arrow batches cut into pieces of a few rows, so that only those are copied into Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
