"""Approximate nearest vectors: inverted lists of k-means cells, one-bit codes, then an exact rerank.

The cells are fitted on a bounded sample (SAMPLE rows by hash of the id); every row is assigned and coded.
A query probes the nearest cells, estimates distances from the codes, keeps the best and
ranks those by the exact cosine. The index is an ordinary table partitioned by `cell`, so a probe reads its cells only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxbow.operators.retrieval import vector_topk

#: Rows of the sample that the cells are fitted on: a documented bound; nothing else is sampled.
SAMPLE = 65_536
#: Rounds of k-means, its batch in cells, the fewest and most cells, rows scanned exactly behind a filter.
ROUNDS, BATCH, LEAST_CELLS, MOST_CELLS, EXACT_ROWS = 10, 64, 16, 256, 50_000


def cells_for(n: int) -> int:
    return min(MOST_CELLS, max(LEAST_CELLS, round(math.sqrt(n))))


def probes_for(base: int, cells: int) -> int:
    return min(cells, max(base, math.ceil(cells / 4)))


def units(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1.0)


def k_means(rows: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Mini-batch k-means on unit vectors; the same rows give the same cells."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(cells, len(rows)), replace=False)].copy()
    seen = np.zeros(len(centres))
    for _ in range(ROUNDS):
        batch = rows[rng.choice(len(rows), min(len(rows), BATCH * cells), replace=False)]
        nearest = np.argmax(batch @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, batch)
        seen += counts
        hit = counts > 0
        centres[hit] += (sums[hit] - counts[hit, None] * centres[hit]) / seen[hit, None]
    return centres


@dataclass(frozen=True)
class Cells:
    """Centres and the rotation of the codes: at most MOST_CELLS x dim and dim x dim numbers."""

    centres: np.ndarray
    rotation: np.ndarray

    @staticmethod
    def fit(df: DataFrame, id_col: str, vector_col: str, seed: int = 11) -> Cells:
        size = df.where(F.col(vector_col).isNotNull()).count()
        chosen = df.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).select(vector_col).toPandas()[vector_col]
        rows = units(np.array(chosen.tolist(), dtype=np.float64))
        turned, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((rows.shape[1], rows.shape[1])))
        return Cells(k_means(rows, cells_for(size)), turned)

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        return np.argmax(vectors @ self.centres.T - 0.5 * (self.centres**2).sum(1), axis=1)


def build_index(df: DataFrame, cells: Cells, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, cell, code, scale) of every row; null, zero and non-finite vectors are left out."""
    dim = cells.rotation.shape[0]
    kept = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(
        (F.size("vector") == dim) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    )

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                rows = units(np.array(batch["vector"].tolist(), dtype=np.float64))
                turned = rows @ cells.rotation
                scale = np.sqrt(dim) / np.abs(turned).sum(1)  # 1 / <row, its code>
                yield batch.assign(cell=cells.nearest(rows).astype("int32"), code=[c.tobytes() for c in np.packbits(turned > 0, axis=1)], scale=scale)

    return kept.mapInPandas(coded, f"id {df.schema[id_col].dataType.simpleString()}, vector {df.schema[vector_col].dataType.simpleString()}, cell int, code binary, scale double")


def ann_topk(index: DataFrame, cells: Cells, query: list[float], k: int = 10, nprobe: int = 16, rerank: int = 48) -> DataFrame:
    """(id, distance): the k nearest found by cosine distance, ties to the smaller id."""
    one = units(np.array([query], dtype=np.float64))
    order = np.argsort(-(one @ cells.centres.T - 0.5 * (cells.centres**2).sum(1))[0], kind="stable")
    probed = [int(c) for c in order[: probes_for(nprobe, len(cells.centres))]]
    turned = (one @ cells.rotation)[0]
    dim = len(turned)

    @F.pandas_udf("double")
    def estimate(code: pd.Series, scale: pd.Series) -> pd.Series:
        bits = np.unpackbits(np.frombuffer(b"".join(code), dtype=np.uint8).reshape(len(code), -1), axis=1)[:, :dim]
        return pd.Series(1 - scale.to_numpy() * ((2.0 * bits - 1.0) @ turned) / np.sqrt(dim))

    coarse = index.where(F.col("cell").isin(probed)).withColumn("estimate", estimate("code", "scale")).orderBy("estimate", "id").limit(rerank * k)
    return vector_topk(coarse, query, "vector", k, "id").select("id", "distance")


def filtered_topk(index: DataFrame, cells: Cells, query: list[float], condition: str, k: int = 10, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """The nearest rows that meet a condition on the index's columns: an exact scan if few remain, else the probe."""
    kept = index.where(condition)
    if kept.limit(exact_rows + 1).count() <= exact_rows:
        return vector_topk(kept, query, "vector", k, "id").select("id", "distance")
    return ann_topk(kept, cells, query, k)


def part_bounds(index: DataFrame, part: str = "cell") -> DataFrame:
    """(part, centre, radius) of unit vectors, for leaving out whole parts without losing a row."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = index.withColumn("norm", norm).select(part, F.transform("vector", lambda x: x.cast("double") / F.col("norm")).alias("unit"))
    places = unit.select(part, F.posexplode("unit").alias("at", "x")).groupBy(part, "at").agg(F.avg("x").alias("x"))
    centres = places.groupBy(part).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("centre"))  # dim numbers a part
    far = F.sqrt(F.aggregate(F.zip_with("unit", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return unit.join(centres, part).groupBy(part).agg(F.first("centre").alias("centre"), F.max(far).alias("radius"))


def lower_bound(query: list[float], centre: str = "centre", radius: str = "radius"):
    """The least cosine distance that a part can hold: half of max(0, |q - c| - r) squared."""
    one = units(np.array([query], dtype=np.float64))[0]
    far = F.sqrt(F.aggregate(F.zip_with(F.array([F.lit(float(x)) for x in one]), centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return 0.5 * F.pow(F.greatest(F.lit(0.0), far - F.col(radius)), F.lit(2.0))


def truncated(vector, dim: int):
    """The first `dim` components, scaled to length 1 again."""
    short = F.slice(vector, 1, dim)
    norm = F.sqrt(F.aggregate(short, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(short, lambda x: x.cast("double") / norm))
