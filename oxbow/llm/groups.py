"""Groups that may be large: whole groups from sorted streams, and splitting into sub-blocks and pairs of them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxbow.session import checkpointed

PAIR = ("one", "two")
#: Rows of sub-blocks, or of pairs of them, that a broadcast may hold, some 60 MB.
MOST_BROADCAST = 1_000_000


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by `keys` (integers), each with its rows' group number.

    A group that a batch cuts is carried over to the next one.
    """
    carried: pa.Table | None = None

    def numbered(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
        columns = [rows[c].to_numpy() for c in keys]
        fresh = np.zeros(len(rows), bool)
        for c in columns:
            fresh[1:] |= c[1:] != c[:-1]
        return rows, np.cumsum(fresh)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if carried is not None:
            rows = pa.concat_tables([carried, rows])
        _, group = numbered(rows)
        cut = int(np.searchsorted(group, group[-1]))
        carried = rows.slice(cut)
        if cut:
            yield numbered(rows.slice(0, cut).combine_chunks())
    if carried is not None:
        yield numbered(carried.combine_chunks())


def counted(df: DataFrame) -> DataFrame:
    """`df` checkpointed, to be broadcast if its rows are few enough."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def split_alone(members: DataFrame, key: str, member: str, most: int, turn: int) -> DataFrame:
    """`members` with columns one, two, side: groups of more than `most` rows as sub-blocks of about `most`, each for itself.

    So a group costs its size; which rows meet depends on `turn`. Groups of one row are left out.
    """
    sizes = members.groupBy(key).agg(F.count("*").alias("members")).where("members > 1")
    sub = F.pmod(F.xxhash64(member, F.lit(turn)), F.ceil(F.col("members") / most)).cast("long")
    return members.join(sizes, key).withColumn("one", sub).select(*members.columns, "one", F.lit(0).cast("long").alias("two"), F.lit(0).alias("side"))


def split_across(members: DataFrame, key: str, member: str, within: str, size: str, ratio: float, most: int) -> DataFrame:
    """`members` with columns one, two, side, so that all pairs meet that differ in `within` and whose sizes differ by `ratio` at most.

    Rows with the same (key, one, two) belong together. Side 0: all pairs count; sides 1 and 2: only pairs
    across count. Each such pair of a group's members meets in exactly one place; other pairs may meet too.
    In groups of more than `most` rows, a `within` of more than `most` rows has sub-blocks of its own, the others
    share some; all are of one band of sizes each. Sub-blocks of the same large `within`, or of bands too far
    apart, are not paired, so a group in which one class prevails costs about its size.
    """
    sizes = members.groupBy(key).agg(F.count("*").alias("members")).where("members > 1")
    dealt = members.join(sizes, key)
    zero = F.lit(0).cast("long")
    whole = dealt.where(F.col("members") <= most).select(*members.columns, zero.alias("one"), zero.alias("two"), F.lit(0).alias("side"))

    crowded = dealt.where(F.col("members") > most).select(*members.columns, F.floor(F.log(size) / F.lit(math.log(ratio) * (1 + 1e-9))).alias("band"))
    large = counted(crowded.groupBy(key, within).agg(F.count("*").alias("rows")).where(F.col("rows") > most).select(key, within, F.lit(True).alias("large")))
    told = crowded.join(large, [key, within], "left").withColumn("large", F.coalesce("large", F.lit(False))).withColumn("own", F.when(F.col("large"), F.col(within)).otherwise(zero))
    unit = [key, "large", "own", "band"]
    parts = F.ceil(F.col("rows") / most).cast("int")
    units = counted(told.groupBy(*unit).agg(F.count("*").alias("rows")).select(*unit, parts.alias("parts"), F.monotonically_increasing_id().alias("unit")))
    named = lambda side: units.select(key, *[F.col(c).alias(f"{c}_{side}") for c in ("large", "own", "band", "parts", "unit")])
    same_class = F.col("large_a") & F.col("large_b") & (F.col("own_a") == F.col("own_b"))
    near = named("a").join(named("b"), key).where((F.col("unit_a") <= F.col("unit_b")) & (F.abs(F.col("band_a") - F.col("band_b")) <= 1) & ~same_class)
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    both = near.select("unit_a", "unit_b", "parts_b", upto("parts_a").alias("sub_a")).select("unit_a", "unit_b", "sub_a", upto("parts_b").alias("sub_b"))
    both = both.where("unit_a < unit_b or sub_a <= sub_b").withColumn("alone", F.expr("unit_a = unit_b and sub_a = sub_b"))
    pairs = checkpointed(both.withColumn("one", F.monotonically_increasing_id()))
    sides = pairs.select(F.col("unit_a").alias("unit"), F.col("sub_a").alias("sub"), "one", F.when(F.col("alone"), 0).otherwise(1).alias("side"))
    sides = sides.unionAll(pairs.where("not alone").select("unit_b", "sub_b", "one", F.lit(2)))
    placed = told.join(units, unit).withColumn("sub", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))
    return whole.unionAll(placed.join(sides, ["unit", "sub"]).select(*members.columns, "one", zero.alias("two"), "side"))
