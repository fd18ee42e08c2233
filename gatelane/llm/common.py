"""Pieces shared by the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, cut_lineage

# Python workers receive batches bounded in rows and in bytes, so that very long texts stay within memory.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def blank(text: str | Column) -> Column:
    """The text, an empty one for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: survives lost executors, cuts the lineage."""
    return cut_lineage(df, f"llm-{name}")


def numbered(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """``df`` with columns named by position, and the new names of ``columns``: helper columns cannot clash with them."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), [names[df.columns.index(c)] for c in columns]


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def store_of(root: str):
    """File system and path of a folder named by uri or plain path."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]*:/", root):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root))
    return fs.LocalFileSystem(), root


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing unfinished reads any more."""
    for df in tables:
        files, spark = df.inputFiles(), df.sparkSession
        if files:
            folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(files[0].rsplit("/", 1)[0]))
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
