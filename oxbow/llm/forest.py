"""Approximate nearest neighbours by a hash-prefix forest.

Every vector has, for each of TREES trees, a hash string of BITS signs of random projections. A tree
is the sorted array of its strings. A query descends in each tree to its longest-prefix match, of
whatever length that is; then all trees ascend together, one bit at a time, and give the rows that share
the current prefix, until the rows met (once per tree and bit) are MET times the rows there are. A row is the
better a candidate the more often it was met: the KEPT share met most often is ranked by exact distance.

Rows are dealt by a hash of their id into blocks of about BLOCK_ROWS rows. Each block holds the forest of
its rows (the same projections everywhere), built once; the table is shuffled once. Queries visit every
block, as a stream behind the block's rows, and take k rows from each, so a task holds one block and one
batch of queries whatever their number, and no candidate is shuffled. (Trees dealt by ranges of strings
would let a query visit few ranges, but at a recall of 0.9 such vectors need thousands of candidates a query,
whose vectors would have to be shipped: more than the whole table for a hundred queries.)
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oxbow.llm.caches import tidy
from oxbow.llm.vectors import matrix, units, usable

TREES = 128
BITS = 64
#: How often rows are met before the trees stop, per row; the share that is ranked by exact distance, and the fewest.
MET = 16.0
KEPT = 0.1
LEAST = 512
BLOCK_ROWS = 16384
#: Queries that descend together.
QUERY_ROWS = 512


def projections(dim: int, tree: int, seed: int = 5) -> np.ndarray:
    """dim x BITS; the same for the same arguments, everywhere."""
    return np.random.default_rng([seed, dim, tree]).standard_normal((dim, BITS)).astype(np.float32)


def hash_strings(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Strings of one tree as unsigned integers, first bit highest."""
    return np.packbits(unit @ planes >= 0, axis=1).view(">u8").ravel().astype(np.uint64)


def common_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the common prefix."""
    return BITS - np.where(a == b, 0, np.frexp((a ^ b).astype(np.float64))[1]).clip(0, BITS)


class Forest:
    def __init__(self, vectors: np.ndarray) -> None:
        unit, self.planes, self.order, self.sorted = units(vectors), [], [], []
        for t in range(TREES):
            self.planes.append(projections(vectors.shape[1], t))
            strings = hash_strings(unit, self.planes[-1])
            order = np.argsort(strings, kind="stable").astype(np.int32)
            self.order.append(order)
            self.sorted.append(strings[order])

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of the rows that share the first `depth` bits, by depth, tree and query; empty below the longest match of the batch."""
        unit, rows = units(queries), len(self.order[0])
        strings = [hash_strings(unit, p) for p in self.planes]
        deepest = 0
        for kept, own in zip(self.sorted, strings, strict=True):
            place = np.searchsorted(kept, own)
            for at in (np.minimum(place, rows - 1), np.maximum(place - 1, 0)):
                deepest = max(deepest, int(common_bits(own, kept[at]).max()))
        low = np.zeros((deepest + 1, TREES, len(queries)), np.int64)
        high = np.full_like(low, rows)
        for t in range(TREES):
            for depth in range(1, deepest + 1):
                rest = np.uint64(BITS - depth)
                first = strings[t] >> rest << rest
                last = first | np.uint64((1 << (BITS - depth)) - 1)
                low[depth, t] = np.searchsorted(self.sorted[t], first, side="left")
                high[depth, t] = np.searchsorted(self.sorted[t], last, side="right")
        return low, high

    def candidates(self, queries: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """For each query, the rows that its trees met most often: the KEPT share of all, LEAST or k at least, ties whole."""
        rows = len(self.order[0])
        wanted = max(LEAST, k, math.ceil(KEPT * rows))
        if rows <= wanted:
            yield from (np.arange(rows) for _ in queries)
            return
        low, high = self.ranges(queries)
        met = (high - low).sum(axis=1)
        for q in range(len(queries)):
            depth, total = len(met) - 1, 0
            while True:
                total += met[depth, q]
                if not depth or total >= MET * rows:
                    break
                depth -= 1
            spans = [self.order[t][a:b] for t in range(TREES) for a, b in zip(low[depth:, t, q].tolist(), high[depth:, t, q].tolist(), strict=True) if a < b]
            times = np.bincount(np.concatenate(spans), minlength=rows)
            least = np.partition(times, rows - wanted)[rows - wanted]
            yield np.flatnonzero(times >= least)


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    gap = rows - query
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def distinct_rows(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (id, vector) once, by id."""
    order = np.lexsort([*vectors.T[::-1], ids])
    ids, vectors = ids[order], vectors[order]
    fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (vectors[1:] != vectors[:-1]).any(axis=1)])
    return ids[fresh], vectors[fresh]


def search_block(forest: Forest, ids: np.ndarray, vectors: np.ndarray, names: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score): the k nearest rows found in one block for each query, rows of the query's own id left out."""
    repeats = int(np.unique(ids, return_counts=True)[1].max())
    for begin in range(0, len(names), QUERY_ROWS):
        asked, targets = names[begin : begin + QUERY_ROWS], queries[begin : begin + QUERY_ROWS]
        out: list[list[np.ndarray]] = [[], [], []]
        # of the candidates, rows of the query's own id and further rows of one id don't count among the k
        for found, target, name in zip(forest.candidates(targets, (k + 1) * repeats), targets, asked, strict=True):
            found = found[ids[found] != name]
            score = distances(vectors[found], target)
            best = np.lexsort([ids[found], score])[: k * repeats]
            for column, values in zip(out, (np.full(len(best), name), ids[found][best], score[best]), strict=True):
                column.append(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])


def search_stream(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of batches (block, dim, asked, id, v) sorted by the first three: a block's rows come first and make its forest, its queries follow."""
    place, ids, vectors, forest = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            block, dim, asked = keys[a].tolist()
            if place != (block, dim):
                place, ids, vectors, forest = (block, dim), [], [], None
            names, values = batch.column(3).slice(a, b - a).to_numpy(), matrix(batch.column(4).slice(a, b - a)).astype(np.float64)
            if not asked:
                ids.append(names)
                vectors.append(values)
                continue
            if not ids:
                continue
            if forest is None:
                own_ids, own_vectors = distinct_rows(np.concatenate(ids), np.concatenate(vectors))
                vectors, forest = [], Forest(own_vectors)
            yield from search_block(forest, own_ids, own_vectors, names, values, k)


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row where `is_query`, by Euclidean distance in double precision.

    Ties go to the smaller id. Rows with a null id, or with a vector that is null, empty, zero or
    holds null or non-finite components, take no part; vectors are compared with vectors of their
    own length only. Repeated rows count once, and of rows that repeat an id the nearest; a query is never its
    own neighbour, by id. With fewer than k candidates all are returned; an empty table gives no rows. Other
    columns are not read.
    """
    picked = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    valid = picked.where(F.col("id").isNotNull() & usable(F.col("v")))
    blocks = max(1, math.ceil(valid.count() / block_rows))
    order = ["block", "dim", "asked"]
    rows = valid.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.size("v").alias("dim"), F.lit(0).alias("asked"), "id", "v")
    asked = valid.where("asked").dropDuplicates(["id", "v"]).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.size("v").alias("dim"), F.lit(1).alias("asked"), "id", "v")
    dealt = rows.unionAll(asked).repartition(blocks, "block").sortWithinPartitions(*order)
    found = dealt.mapInArrow(tidy(lambda b: search_stream(b, k)), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
