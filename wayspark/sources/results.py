"""Result records as JSON lines, one folder per model and task."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RESULTS


def write_results(records: DataFrame, path: str) -> None:
    """Replaces the folders of the (model, task) pairs present in ``records`` and no others; the
    committer swaps them in when the job succeeds."""
    keyed = records.withColumns({"p_model": F.col("model"), "p_task": F.regexp_replace("task", "[/:|]", "_")})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("p_model", "p_task").json(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType = RESULTS) -> tuple[DataFrame, DataFrame]:
    """(records, unreadable lines): a damaged line never hides the others."""
    full = T.StructType([*schema.fields, T.StructField("_damaged", T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_damaged").json(path)
    return rows.filter("_damaged is null").drop("_damaged", "p_model", "p_task"), rows.filter("_damaged is not null").select(F.col("_damaged").alias("line"))
