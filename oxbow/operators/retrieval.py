"""Vector, lexical and hybrid search, and recall over versioned, bi-temporal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oxbow.functions.text import tokens
from oxbow.functions.vectors import cosine_distance
from oxbow.session import checkpointed

#: BM25's and fusion's usual constants.
K1, B, RRF = 1.2, 0.75, 60


def vector_topk(df: DataFrame, query: list[float], vector_col: str, k: int, id_col: str) -> DataFrame:
    """The k rows of least cosine distance, ties to the smaller id; a top-k per partition, then one merge."""
    far = cosine_distance(F.col(vector_col), F.array([F.lit(float(x)) for x in query]))
    return df.withColumn("distance", far).where("distance is not null").orderBy("distance", id_col).limit(k)


def bm25(df: DataFrame, query: str, text_col: str, id_col: str) -> DataFrame:
    """(id, score) of the rows with a query term, by BM25 with statistics of the whole table."""
    terms = sorted({t for t in "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in query).split() if len(t) >= 2})
    times = lambda words, term: F.size(F.filter(words, lambda w: w == term))
    # a text is split once: its words are a lambda's variable, not an expression repeated for every count
    told = F.transform(F.array(tokens(F.col(text_col))), lambda w: F.struct(F.size(w).alias("length"), *[times(w, t).alias(f"tf{k}") for k, t in enumerate(terms)]))[0]
    # numbers only; the statistics and the scores both read them
    counted = checkpointed(df.select(F.col(id_col).alias("id"), told.alias("told")).select("id", "told.*"))
    sums = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.sum((F.col(f"tf{k}") > 0).cast("int")).alias(f"df{k}") for k in range(len(terms))])
    score = F.lit(0.0)
    for k in range(len(terms)):
        tf, df_k = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log(1 + (F.col("n") - df_k + 0.5) / (df_k + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return counted.crossJoin(F.broadcast(sums)).select("id", score.alias("score")).where("score > 0")  # sums: one row


def ranked(df: DataFrame, order: list[Column], leg: str, k: int = 50) -> DataFrame:
    """(id, leg, rank) of the first k rows, rank from 0. Only k rows reach the window."""
    best = df.orderBy(*order).limit(k)
    return best.select("id", F.lit(leg).alias("leg"), (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))


def fuse(legs: list[DataFrame]) -> DataFrame:
    """(id, rrf): reciprocal rank fusion of ranked legs."""
    both = legs[0]
    for x in legs[1:]:
        both = both.unionByName(x)
    return both.groupBy("id").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("rrf"))


def latest(df: DataFrame, id_col: str, version: str) -> DataFrame:
    """The newest row of each id: a maximum with partial aggregation, not a window over all versions."""
    columns = [c for c in df.columns if c not in (id_col, version)]
    best = df.groupBy(id_col).agg(F.max(F.struct(version, *columns)).alias("row"))
    return best.select(id_col, *[F.col(f"row.{c}").alias(c) for c in (version, *columns)])


def valid_at(df: DataFrame, moment: Column | None, start: str = "valid_at", end: str = "invalid_at") -> DataFrame:
    """Rows that hold now (no end), or held at `moment`."""
    if moment is None:
        return df.where(F.col(end).isNull())
    return df.where((F.col(end).isNull() | (F.col(end) > moment)) & (F.col(start).isNull() | (F.col(start) <= moment)))


def recall_score(distance: Column, importance: Column) -> Column:
    return 0.7 * (1 - distance) + 0.3 * importance


def recency(age_days: Column, half_life: float = 30.0) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * age_days / half_life)
