"""Embedding near-duplicates by spherical-cap filters.

Filters are the words of random product codes: a code turns the space by its own random rotation and
cuts it into two halves, each has its own set of random directions, and a filter is a pair of them. A vector belongs to every filter whose
cap of height `alpha` holds it. Thanks to the product these are listed without trying all filters:
both halves are scored, and only pairs whose sum reaches alpha are decoded. Vectors are joined on
filters and pairs verified by cosine in double precision. A pair met in several filters counts in
the smallest that both share.

alpha and the filters of a code follow the number of distinct vectors n: a filter holds a fixed number
of vectors (CROWD) at any n, and each vector is in about COVER filters of a code. Filters of one code
share half-directions, so whether a pair at the threshold shares one of them is measured on drawn
pairs; by the rotation it is the same for any pair of that cosine, however its squared norm is spread.
As codes are independent, so many are taken that all miss the pair with probability MISS at most; that
counts the vectors without a filter of a code too.

Equal vectors are first collapsed to one with a weight. Filters with more than SPLIT members are
split into pairs of sub-blocks, so no task holds more than 2 * SPLIT members of one filter; within a
task, members are compared in matrix blocks, and what leaves it is one count per vector and one
spanning edge per vector and task, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxbow.llm.caches import held, tidy
from oxbow.llm.groups import PAIR, whole_groups
from oxbow.llm.vectors import matrix, units, usable
from oxbow.operators.components import star_components
from oxbow.session import checkpointed

CROWD = 256.0
COVER = 0.5
MISS = 0.002
#: Filters are numbered by dimension, code (7 bits) and pair of directions (37 bits).
MOST_CODES = 128
SPLIT = 1024
#: From so many near pairs on, a group's shared filters are found by one matrix product.
CROWDED = 512
LEAST_ALPHA, MOST_ALPHA = 0.0, 0.8


def cap_share(alpha: float, dim: int) -> float:
    """Share of the sphere in a cap of height alpha."""
    angle = np.linspace(math.acos(min(0.9999, alpha)), 0, 4001)
    whole = np.linspace(math.pi, 0, 4001)
    area = lambda x: abs(np.trapezoid(np.sin(x) ** (dim - 2), x))
    return float(area(angle) / area(whole))


def parameters(n: int, dim: int, threshold: float) -> tuple[float, int, int]:
    """alpha, the directions in each half of a code, and the codes."""
    low, high = LEAST_ALPHA, MOST_ALPHA
    for _ in range(40):
        alpha = (low + high) / 2
        low, high = (alpha, high) if cap_share(alpha, dim) * n > CROWD else (low, alpha)
    while True:
        words = max(2, math.ceil(math.sqrt(COVER / cap_share(low, dim))))
        missed = 1 - share_rate(low, words, dim, threshold)
        codes = max(1, math.ceil(math.log(MISS) / math.log(missed))) if 0 < missed < 1 else 1 if missed == 0 else MOST_CODES + 1
        if codes <= MOST_CODES:
            return low, words, codes
        low -= 0.02


def share_rate(alpha: float, words: int, dim: int, threshold: float, pairs: int = 1000, trials: int = 4) -> float:
    """Share of random pairs of cosine `threshold` that have a filter of one code in common."""
    rng = np.random.default_rng([7, dim, words])
    found = 0
    for trial in range(trials):
        x, y = rng.standard_normal((2, pairs, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= np.einsum("ij,ij->i", x, y)[:, None] * x
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        y = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * y
        _, *code = directions(dim, words, trial, seed=5)
        sides = [row * words**2 + filters for row, filters in (decode(v.astype(np.float32), code, alpha) for v in (x, y))]
        found += len(np.unique(np.intersect1d(*sides) // words**2))
    return found / (pairs * trials)


def directions(dim: int, words: int, code: int, seed: int = 3) -> list[np.ndarray]:
    """The rotation of a code, and the directions of both halves, of length sqrt(1/2) each."""
    rng = np.random.default_rng([seed, dim, words, code])
    turn, signs = np.linalg.qr(rng.standard_normal((dim, dim)))
    halves = [rng.standard_normal((size, words)) for size in (dim // 2, dim - dim // 2)]
    return [(turn * np.sign(np.diag(signs))).astype(np.float32), *((x / np.linalg.norm(x, axis=0) / math.sqrt(2)).astype(np.float32) for x in halves)]


def decode(vectors: np.ndarray, code: list[np.ndarray], alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter that holds a row; filters are numbered by pairs of directions."""
    half, words = code[0].shape
    left, right = vectors[:, :half] @ code[0], vectors[:, half:] @ code[1]
    most = right.max(axis=1)
    rows, firsts = np.nonzero(left + most[:, None] >= alpha)
    out_rows, out_filters = [], []
    for k in range(0, len(rows), 4096):
        r, f = rows[k : k + 4096], firsts[k : k + 4096]
        at, second = np.nonzero(left[r, f][:, None] + right[r] >= alpha)
        out_rows.append(r[at])
        out_filters.append(f[at].astype(np.int64) * words + second)
    if not out_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_rows), np.concatenate(out_filters)


def smallest_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the pairs (a, b) and, for each, the smallest node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def first_shared(a: np.ndarray, b: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Whether no filter below `filters` is in both lists (rows of a and b, filled up with distinct negatives)."""
    out = np.empty(len(a), bool)
    for k in range(0, len(a), 8192):
        x, y, f = a[k : k + 8192], b[k : k + 8192], filters[k : k + 8192, None]
        hit = np.zeros(len(x), bool)
        x = np.where(x < f, x, -1)
        for j in range(x.shape[1]):
            hit |= ((x[:, j : j + 1] == y) & (x[:, j : j + 1] >= 0)).any(axis=1)
        out[k : k + 8192] = ~hit
    return out


def share_earlier(lists: np.ndarray, current: int) -> np.ndarray:
    """For all members of one filter at once: whether two of them share a filter below it."""
    member, place = np.nonzero((lists >= 0) & (lists < current))
    names, at, counts = np.unique(lists[member, place], return_inverse=True, return_counts=True)
    often = counts > 1
    column = np.cumsum(often) - 1
    kept = often[at]
    table = np.zeros((len(lists), int(often.sum())), np.float32)
    table[member[kept], column[at[kept]]] = 1
    return (table @ table.T) > 0


def near_pairs(group: np.ndarray, side: np.ndarray, unit: np.ndarray, raw: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group (rows sorted by group) whose cosine reaches `threshold`, in double precision on the original vectors.

    side: 0 for rows of a group that is not split (all pairs count), 1 and 2 for the two sub-blocks.
    """
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        for k in range(begin, end, 512):
            rows = slice(k, min(k + 512, end))
            i, j = np.nonzero(unit[rows] @ unit[k:end].T >= threshold - 1e-5)
            i, j = i[i < j] + k, j[i < j] + k
            ok = (side[i] != side[j]) | (side[i] == 0)
            lefts.append(i[ok])
            rights.append(j[ok])
    a, b = np.concatenate(lefts), np.concatenate(rights)
    norm, keep = np.sqrt(np.einsum("ij,ij->i", raw, raw)), np.empty(len(a), bool)
    for k in range(0, len(a), 65536):
        i, j = a[k : k + 65536], b[k : k + 65536]
        keep[k : k + 65536] = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= threshold
    return a[keep], b[keep]


def met_first(a: np.ndarray, b: np.ndarray, group: np.ndarray, current: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Whether the rows of each pair share no filter below the one that they meet in; lists: all filters of the rows that pairs name."""
    keep = np.ones(len(a), bool)
    cuts = np.flatnonzero(np.concatenate([[True], group[a][1:] != group[a][:-1], [True]]))
    few = []
    for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if end - begin < CROWDED:
            few.append(np.arange(begin, end))
            continue
        rows, at = np.unique(np.concatenate([a[begin:end], b[begin:end]]), return_inverse=True)
        shared = share_earlier(lists[rows], int(current[rows[0]]))
        keep[begin:end] = ~shared[at[: end - begin], at[end - begin :]]
    if few:
        at = np.concatenate(few)
        keep[at] = first_shared(lists[a[at]], lists[b[at]], current[a[at]])
    return keep


def filters_of(unit: np.ndarray, dim: int, plan: tuple[float, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters of all codes, sorted by row and filter."""
    alpha, words, count = plan
    codes = held(("caps", dim, words, count), lambda: [directions(dim, words, c) for c in range(count)])
    rows, filters = [], []
    for c, (turn, *code) in enumerate(codes):
        row, found = decode(unit @ turn, code, alpha)
        rows.append(row)
        filters.append(found + (c << 37) + (dim << 44))
    row, found = np.concatenate(rows), np.concatenate(filters)
    order = np.lexsort([found, row])
    return row[order], found[order]


@tidy
def links_of_partition(batches: Iterator[pa.RecordBatch], threshold: float, plans: dict[int, tuple[float, int, int]]) -> Iterator[pa.RecordBatch]:
    """(id, other, links) of rows (filter, one, two, side, id, weight, v) sorted by the first three.

    The filters of a row are computed again here for the rows of near pairs alone: shipping them with every row would double the shuffle.
    """
    for rows, group in whole_groups(batches, ("filter", *PAIR)):
        ids, weight, current, side = (rows[c].to_numpy() for c in ("id", "weight", "filter", "side"))
        for dim in np.unique(current >> 44).tolist():
            at = np.flatnonzero(current >> 44 == dim)
            raw = matrix(rows["v"].take(pa.array(at))).astype(np.float64)
            unit = units(raw)
            a, b = near_pairs(group[at], side[at], unit, raw, threshold)
            if not len(a):
                continue
            named = np.unique(np.concatenate([a, b]))
            names, place = np.unique(ids[at][named], return_index=True)
            row, found = filters_of(unit[named[place]], dim, plans[dim])
            counts = np.bincount(row, minlength=len(names))
            lists = np.tile(-2 - np.arange(int(counts.max()), dtype=np.int64), (len(at), 1))
            filled = np.tile(-2 - np.arange(int(counts.max()), dtype=np.int64), (len(names), 1))
            filled[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = found
            lists[named] = filled[np.searchsorted(names, ids[at][named])]
            keep = met_first(a, b, group[at], current[at], lists)
            a, b = at[a[keep]], at[b[keep]]
            if len(a):
                nodes, labels = smallest_labels(ids[a], ids[b])
                order = np.searchsorted(nodes, np.concatenate([ids[a], ids[b]]))
                sums = np.bincount(order, weights=np.concatenate([weight[b], weight[a]]), minlength=len(nodes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels), pa.array(sums)], ["id", "other", "links"])


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """id_col, n_links, component_id, kept: one row per row of `df`.

    n_links counts the other rows whose cosine is at least `threshold` (as found); component_id is
    the smallest id reachable by links. A vector that is null, empty, zero or holds null or
    non-finite components has no link and is its own component. Vectors are compared with vectors of
    their own length only. Rows that repeat an id are vectors of their own, linked if near; a null
    id has a null component and, like any, n_links. Ties don't arise; an empty table gives no rows. Other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("own_id"), F.col(vector_col).alias("v"), usable(F.col(vector_col)).alias("ok"))
    distinct = rows.where("ok").groupBy("v").agg(F.min("own_id").alias("least"), F.count("*").alias("weight"))
    # ids of the classes are their smallest row ids, made unique where a row id repeats or is null
    classes = checkpointed(distinct.select(F.monotonically_increasing_id().alias("id"), "least", "weight", "v", F.size("v").alias("dim")))
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}  # one row per vector length
    plans = {dim: parameters(n, dim, threshold) for dim, n in sizes.items()}

    @tidy
    def list_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                unit = units(matrix(part.column("v")).astype(np.float64))
                for k in range(0, len(unit), 2048):
                    row, found = filters_of(unit[k : k + 2048], dim, plans[dim])
                    chosen = part.slice(k, 2048)
                    yield pa.RecordBatch.from_arrays([chosen.column("id").take(pa.array(row)), pa.array(found)], ["id", "filter"])

    listed = checkpointed(classes.select("id", "v", "dim").mapInArrow(list_filters, "id long, filter long"))
    crowds = listed.groupBy("filter").agg(F.count("*").alias("members")).where("members > 1").select("filter", F.ceil(F.col("members") / SPLIT).cast("int").alias("parts"))
    entries = listed.join(crowds, "filter").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # a vector joins its filters by id, so only filters that others share are paid for with a vector
    members = entries.join(classes.select("id", "weight", "v"), "id")
    places = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least(o, "sub").alias("one"), F.greatest(o, "sub").alias("two"), F.when(o == F.col("sub"), 0).when(F.col("sub") < o, 1).otherwise(2).alias("side")),
    )
    dealt = members.withColumn("place", F.explode(places)).select("filter", "place.one", "place.two", "place.side", "id", "weight", "v")
    found = checkpointed(dealt.repartition("filter", *PAIR).sortWithinPartitions("filter", *PAIR).mapInArrow(lambda b: links_of_partition(b, threshold, plans), "id long, other long, links long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = star_components(found.select("id", "other"), "id", "other")
    named = classes.join(joined, classes["id"] == joined["node"], "left").select("id", "least", "weight", "v", F.coalesce("component", "id").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    told = named.join(smallest, "component").join(links, "id", "left").select("v", F.col("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    good = rows.where("ok").join(told, "v").select("own_id", "n_links", "component_id")
    bad = rows.where("not ok").select("own_id", F.lit(0).cast("long").alias("n_links"), F.col("own_id").alias("component_id"))
    return good.unionAll(bad).select(F.col("own_id").alias(id_col), "n_links", "component_id", (F.col("own_id") == F.col("component_id")).alias("kept"))
