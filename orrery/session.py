"""Tables that several steps read, kept once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def pinned(df: DataFrame, name: str = "pinned") -> DataFrame:
    """df, made once however often it is read: a table in spark.checkpoint.dir where that is set, else Spark's cache."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Gives back what pinned made of df; nothing that is still to be read may come from it."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        df.unpersist()
        return
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
