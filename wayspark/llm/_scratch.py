"""Tables written once into the shared folder, where several branches or an iteration need the same rows."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import work_dir


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet below ``spark.checkpoint.dir`` and reads it back: later jobs start from files
    that every executor can reach, whichever executors are lost meanwhile."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table of ``keep`` that nothing reads any more."""
    spark = df.sparkSession
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(hadoop).delete(folder, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
