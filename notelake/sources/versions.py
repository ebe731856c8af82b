"""A folder of versions: which tables are current is one small row, written after they are whole.

A version that was not committed is never seen, so a job that was lost half-way leaves the one before in place. Rows are written through
Spark's committer, which works on any storage that the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def versions(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    """All committed versions, or null where there is none."""
    try:
        rows = spark.read.schema(f"number long, {schema}").option("recursiveFileLookup", "true").json(f"{folder}/versions")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return rows


def current(spark: SparkSession, folder: str, schema: str) -> Row | None:
    """The version of the highest number."""
    rows = versions(spark, folder, schema)
    return None if rows is None else rows.orderBy(F.desc("number")).first()


def commit(spark: SparkSession, folder: str, schema: str, number: int, *values) -> None:
    """Makes a version current. Committing a number again replaces it."""
    spark.createDataFrame([(number, *values)], f"number long, {schema}").coalesce(1).write.mode("overwrite").json(f"{folder}/versions/{number}")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table's files, once no version names it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
