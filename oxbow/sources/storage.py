"""Writing tables: small files compacted, old rows dropped, statistics of files for pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def written(df: DataFrame, path: str, time_col: str | None = None, mode: str = "append") -> None:
    """Parquet, in folders by day where there is a time; rows sorted by time inside files, so readers skip row groups."""
    if time_col is None:
        df.write.mode(mode).parquet(path)
        return
    by_day = df.withColumn("day", F.to_date(time_col))
    by_day.sortWithinPartitions("day", time_col).write.mode(mode).partitionBy("day").parquet(path)


def compacted(spark: SparkSession, path: str, target: str, rows_a_file: int = 4_000_000) -> None:
    """The rows of `path` rewritten to `target` in fewer files; AQE sizes the tasks, readers change over when it is done."""
    rows = spark.read.parquet(path)
    parts = {f.name for f in rows.schema} & {"day"}
    writer = (rows.hint("rebalance", *parts) if parts else rows.hint("rebalance")).write.mode("error").option("maxRecordsPerFile", rows_a_file)
    (writer.partitionBy(*parts) if parts else writer).parquet(target)


def retained(df: DataFrame, time_col: str, days: int, now=None) -> DataFrame:
    """Rows of the last `days` days; rows without a time stay."""
    return df.where(F.col(time_col).isNull() | (F.col(time_col) >= F.coalesce(now if now is not None else F.lit(None), F.current_timestamp()) - F.make_dt_interval(F.lit(days))))


def file_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(file, rows, and least, most and nulls of each column) from one pass over those columns only."""
    sums = [x for c in columns for x in (F.min(c).alias(f"{c}_least"), F.max(c).alias(f"{c}_most"), F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"))]
    return df.select(F.input_file_name().alias("file"), *columns).groupBy("file").agg(F.count("*").alias("rows"), *sums)


def files_with(statistics: DataFrame, column: str, low, high) -> DataFrame:
    """The files that may hold a value between low and high; none that does is left out."""
    return statistics.where((F.col(f"{column}_most") >= low) & (F.col(f"{column}_least") <= high)).select("file")


def promoted(df: DataFrame, target) -> DataFrame:
    """Rows in the columns of a target schema: new columns null, unknown ones dropped, another type is an error."""
    have = {f.name: f.dataType for f in df.schema}
    if clash := [f.name for f in target if f.name in have and have[f.name] != f.dataType]:
        raise ValueError(f"columns of another type: {', '.join(clash)}")
    return df.select([(F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in target])
