"""Readers for the driver's tables, by the path that Spark alone may open, and keys of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*values: Column) -> Column:
    """Hex SHA-1 of some values of a row, each with its length before it; null differs from every text."""
    texts = [v.cast("string") for v in values]
    return F.sha1(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def whole_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """``docs`` as one column ``row`` beside ``more``, so that no name of the caller's meets one of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, as the optimizer knows them; nothing runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions of about ``bytes_each`` for what ``df`` reads, ``spark.sql.shuffle.partitions`` at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-input_bytes(df) // bytes_each), 1 << 20))


def fewer_files(df: DataFrame, parts: int | None = None) -> DataFrame:
    """``df`` of ``parts`` shuffle partitions (``spark.sql.shuffle.partitions`` unless given) in a quarter as many tasks and files, but not under 48, for tables in which the order of partitions says nothing."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(min(parts, 48), parts // 4))
