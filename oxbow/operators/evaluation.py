"""Quality of rankings: (query, id, rank from 1) against judgements (query, id, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gain(grade: Column, exponential: bool) -> Column:
    return F.pow(F.lit(2.0), grade) - 1 if exponential else grade.cast("double")


def ranking_quality(ranked: DataFrame, judged: DataFrame, k: int = 10, exponential: bool = False) -> DataFrame:
    """(query, recall, ndcg, mrr) at k for every judged query; what is not judged counts as grade 0.

    A query without relevant rows has recall, ndcg and mrr 0.
    """
    worth = lambda rank: 1 / F.log2(rank + 1.0)
    good = judged.where("grade > 0")
    best = good.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "id"))).where(F.col("place") <= k)  # the limit is applied before the shuffle
    ideal = best.groupBy("query").agg(F.sum(gain(F.col("grade"), exponential) * worth(F.col("place"))).alias("ideal"))
    ideal = good.groupBy("query").agg(F.count("*").alias("relevant")).join(ideal, "query")
    hits = ranked.where(F.col("rank") <= k).select("query", "id", "rank").join(good, ["query", "id"]).groupBy("query").agg(F.sum(gain(F.col("grade"), exponential) * worth(F.col("rank"))).alias("dcg"), F.count("*").alias("hits"), F.min("rank").alias("first"))
    rows = judged.select("query").distinct().join(ideal, "query", "left").join(hits, "query", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("query", zero(F.col("hits") / F.col("relevant")).alias("recall"), zero(F.col("dcg") / F.col("ideal")).alias("ndcg"), zero(1.0 / F.col("first")).alias("mrr"))


def percentiles(df: DataFrame, column: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """One row of nearest-rank percentiles p50, p95, ...: the smallest value with at least that share at or below it."""
    return df.agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`)").alias(f"p{round(100 * p)}") for p in at])
