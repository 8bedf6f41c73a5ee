"""Files made from the benchmark tables, in the formats of the library's sources, in the folder that all nodes share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.sources.staging import new_path


def lines(spark: SparkSession, rows: DataFrame, name: str, *columns) -> str:
    """Write ``columns``, joined by tabs, as text without a header."""
    path = new_path(spark, name)
    rows.select(F.concat_ws("\t", *(c.cast("string") for c in columns)).alias("value")).write.text(path)
    return path


def structures(spark: SparkSession, rows: DataFrame) -> str:
    """Write ``pdb, n, value`` as files ``pdb<pdb>.ent`` with the lines in order."""
    path = new_path(spark, "structures")
    rows.repartition("pdb").sortWithinPartitions("pdb", "n").select("pdb", "value").write.partitionBy("pdb").text(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in system.listStatus(where):
        name = folder.getPath().getName()
        if name.startswith("pdb="):
            for part in system.listStatus(folder.getPath()):
                if part.getPath().getName().startswith("part-"):
                    system.rename(part.getPath(), spark._jvm.org.apache.hadoop.fs.Path(where, f"pdb{name[4:]}.ent"))
            system.delete(folder.getPath(), True)
    return path
