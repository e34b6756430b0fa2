"""Vector distances as Spark SQL expressions: double precision, whole-stage friendly, no Python."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DOT = "aggregate(zip_with({a}, {b}, (x, y) -> cast(x AS double) * cast(y AS double)), 0D, (s, x) -> s + x)"
SQUARES = "aggregate({v}, 0D, (s, x) -> s + cast(x AS double) * cast(x AS double))"
SAME = "size({a}) = size({b})"
SQL = {
    "inner_product": f"(CASE WHEN {SAME} THEN {DOT} END)",
    "l2_distance": f"(CASE WHEN {SAME} THEN sqrt(aggregate(zip_with({{a}}, {{b}}, (x, y) -> pow(cast(x AS double) - cast(y AS double), 2)), 0D, (s, x) -> s + x)) END)",
    "cosine_distance": f"(CASE WHEN {SAME} AND size({{a}}) > 0 THEN 1 - {DOT} / nullif(sqrt({SQUARES.format(v='{a}')}) * sqrt({SQUARES.format(v='{b}')}), 0D) END)",
}


def register(spark: SparkSession) -> None:
    """Make the distances functions of spark.sql, for arrays of float or double; expressions, not Python."""
    for name, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body.format(a='a', b='b')}")


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null on unequal lengths, empty or zero vectors."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), 1 - product(a, b) / norm)


def l2_distance(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: F.pow(p.cast("double") - q.cast("double"), F.lit(2))), F.lit(0.0), lambda s, p: s + p)))
