"""N-gram Jaccard join with a count-vector R-tree.

A document's set holds the hashes of its distinct word n-grams. The n-grams are also hashed into
GROUPS groups; the numbers of n-grams per group are the document's point. Two documents share at
most sum(min(x_g, y_g)) n-grams, and a box of points at most sum(min(max_g, max'_g)); an R-tree over
the points passes over all pairs of boxes, then of points, whose bound stays below what the
threshold asks for. The surviving pairs are verified on the sets.

To join a large corpus the points are first dealt into blocks, without loss: two sets of Jaccard t or
more share an n-gram among the first |x| - ceil(t |x|) + 1 of each in any common order. The order
taken goes by frequency (in powers of two, as far as batches of documents can tell; it is only a
preference: whatever it says, no pair is lost), then by hash, so a passage that many documents share
makes no block unless it is most of a document. The documents of a hot n-gram are listed in pieces, dealt by
document, so no task has them all. Blocks with the same members are one block; documents with equal sets are one point.

As the result is a partition, not all links: first each point's most alike partner (by the bound) is
verified and components are formed; a block of more than SPLIT points is taken in sub-blocks of that
size, each for itself with an R-tree of its own; of a block that had to be split two points of each component are
dealt anew, until they fit in one sub-block or are no longer halved. Then, in blocks that still hold several
components, every surviving pair across components is verified; these must pass a second bound as well, over as many
groups as the document has n-grams, about, so that few pairs are verified in vain. There sub-blocks are
paired unless they are of one large component or their sizes rule all links out. Points of one component are not paired again, so a
group of near copies costs about its size, not its square, and no component is missed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxbow.llm.caches import release, tidy
from oxbow.llm.groups import PAIR, counted, split_across, split_alone, whole_groups
from oxbow.llm.hashing import mix, prefix_sums, range_hash
from oxbow.operators.components import star_components
from oxbow.session import checkpointed, collect_garbage

WORDS = 5
#: Jaccard similarity from which two documents link: numerator and denominator.
THRESHOLD = (75, 100)
GROUPS = 128
FANOUT = 16
SPLIT = 1024
#: Members that are verified against one document in one place.
MEMBERS = 512
#: N-grams in 2 ** HOT documents or more, as far as batches can tell, have their documents listed in many places.
HOT = 12
#: Frequent n-grams whose frequency the order knows, at most (9 bytes each are broadcast).
MOST_FREQUENT = 3_000_000
PORTION = 1 << 20
PART_BYTES = 8 << 20
RECORD = np.dtype([("gram", "<u8"), ("doc", "<i8")])
COUNT = np.dtype([("gram", "<u8"), ("count", "<i4")])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def gram_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct n-grams of each text, sorted.

    A text with fewer words has its whole sequence as its only n-gram; one without words has none.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    if not len(start):
        return none
    sums, down = prefix_sums(data)
    word = range_hash(sums, down, start, end)
    owner = np.searchsorted(ends, start, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    factor = np.uint64(0xD6E8FEB86659FD93)
    n = max(0, len(word) - words + 1)
    total = np.zeros(n, np.uint64)
    for j in range(words):
        total = total * factor + word[j : j + n]
    full = owner[:n] == owner[len(word) - n :]
    grams, of = mix(total[full]), owner[:n][full]
    few = np.flatnonzero((counts > 0) & (counts < words))
    if len(few):
        firsts = np.searchsorted(owner, few)
        value = np.zeros(len(few), np.uint64)
        for j in range(words - 1):
            has = counts[few] > j
            value[has] = value[has] * factor + word[firsts[has] + j]
        grams = np.concatenate([grams, mix(value + counts[few].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))])
        of = np.concatenate([of, few])
    order = np.lexsort([grams, of])
    grams, of = grams[order], of[order]
    fresh = np.concatenate([[True], (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])])
    return of[fresh], grams[fresh]


def portions(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts as UTF-8) in lists of about PORTION bytes or a single text."""
    begin = 0
    while begin < len(column):
        texts, size, end = [], 0, begin
        while end < len(column) and (size < PORTION or end == begin):
            texts.append((column[end].as_py() or "").encode("utf-8", "replace"))
            size += len(texts[-1])
            end += 1
        yield begin, texts
        begin = end


def fine_groups(n: int) -> int:
    """Groups of a document's fine point: the power of two from its size on, so that sets are thinly spread."""
    return max(GROUPS, min(1 << 16, 1 << max(0, n - 1).bit_length()))


def fine_point(grams: np.ndarray) -> bytes:
    """Counts per group, in bytes, or in four bytes each where one exceeds 255."""
    counts = np.bincount((grams & np.uint64(fine_groups(len(grams)) - 1)).astype(np.int64), minlength=fine_groups(len(grams)))
    return counts.astype(np.uint8 if counts.max() < 256 else "<u4").tobytes()


def packed_point(counts: np.ndarray) -> bytes:
    """Counts per group in two bytes each, or in four where one needs it."""
    return counts.astype("<u2" if counts.max(initial=0) < 65536 else "<u4").tobytes()


def unpacked_points(raw: list[bytes]) -> np.ndarray:
    if all(len(p) == 2 * GROUPS for p in raw):
        return np.frombuffer(b"".join(raw), "<u2").reshape(len(raw), GROUPS)
    return np.stack([np.frombuffer(p, "<u2" if len(p) == 2 * GROUPS else "<u4").astype("<u4") for p in raw])


def fine_bound(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """What the sets of rows x and y share at most, by their fine points, the larger folded to the smaller's groups."""
    out = np.zeros(len(x), np.int64)
    groups = {int(n): fine_groups(int(n)) for n in np.unique(sizes)}
    wide = np.array([groups[int(n)] for n in sizes], np.int64)
    used = np.unique(np.concatenate([x, y]))
    place = np.zeros(len(sizes), np.int64)
    tables: dict[int, np.ndarray] = {}
    for w in np.unique(wide[used]):
        own = used[wide[used] == w]
        place[own] = np.arange(len(own))
        rows = [np.frombuffer(raw[i], np.uint8 if len(raw[i]) == w else "<u4") for i in own]
        tables[int(w)] = np.stack(rows)  # of bytes, unless one row needs more
    for a, b in {*zip(wide[x].tolist(), wide[y].tolist(), strict=True)}:
        pairs = np.flatnonzero((wide[x] == a) & (wide[y] == b))
        small = min(a, b)
        step = max(1, (16 << 20) // max(a, b))
        for k in range(0, len(pairs), step):
            p = pairs[k : k + step]
            left, right = tables[a][place[x[p]]], tables[b][place[y[p]]]
            if a > small:
                left = left.reshape(len(p), -1, small).sum(axis=1, dtype=np.uint32)
            if b > small:
                right = right.reshape(len(p), -1, small).sum(axis=1, dtype=np.uint32)
            out[p] = np.minimum(left, right).sum(axis=1, dtype=np.int64)
    return out


@tidy
def describe(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(doc, n, print, point, fine, frequent) of the documents (doc, data): size, fingerprint and point of each set; on a batch's last row, the counts of grams in two of its documents or more."""
    release()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes, prints, points, all_grams, fine = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64), np.zeros((n, GROUPS), np.int64), [], []
        for begin, texts in portions(batch.column(1)):
            of, grams = gram_sets(texts, words)
            of = of + begin
            sizes += np.bincount(of, minlength=n)
            points[begin : begin + len(texts)] = np.bincount((of - begin) * GROUPS + (grams % np.uint64(GROUPS)).astype(np.int64), minlength=len(texts) * GROUPS).reshape(-1, GROUPS)
            for k, seed in enumerate((1, 2)):
                value = mix(grams * np.uint64(2 * seed + 1) + np.uint64(seed))
                cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
                if len(cuts):
                    prints[of[cuts], k] = np.add.reduceat(value, cuts)
            ends = np.searchsorted(of, np.arange(begin, begin + len(texts) + 1))
            fine += [fine_point(grams[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            all_grams.append(grams)
        names, counts = np.unique(np.concatenate(all_grams), return_counts=True)
        often = counts >= 2
        frequent = np.empty(int(often.sum()), COUNT)
        frequent["gram"], frequent["count"] = names[often], counts[often]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes),
                pa.array([p.tobytes() for p in prints], pa.binary()),
                pa.array([packed_point(p) for p in points], pa.binary()),
                pa.array(fine, pa.binary()),
                pa.array([None] * (n - 1) + [frequent.tobytes()], pa.binary()),
            ],
            ["doc", "n", "print", "point", "fine", "frequent"],
        )


@tidy
def list_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.frombuffer(b"".join(batch.column(0).to_pylist()), COUNT)
        yield pa.RecordBatch.from_arrays([pa.array(found["gram"].view(np.int64)), pa.array(found["count"])], ["gram", "count"])


def frequent_grams(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(grams, levels), sorted by gram: the most frequent ones of (gram, c), whole levels only, MOST_FREQUENT at most."""
    leveled = counts.withColumn("level", F.floor(F.log2("c")).cast("tinyint"))
    least, total = 127, 0
    for r in leveled.groupBy("level").count().orderBy(F.desc("level")).collect():  # a row for each power of two
        total += r["count"]
        if total > MOST_FREQUENT:
            break
        least = r["level"]
    found = leveled.where(F.col("level") >= least).select("gram", "level").toArrow()
    grams, levels = found["gram"].to_numpy().view(np.uint64), found["level"].to_numpy()
    order = np.argsort(grams)
    return grams[order], levels[order]


def level_of(grams: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    names, levels = frequent
    if not len(names):
        return np.zeros(len(grams), np.int8)
    at = np.minimum(np.searchsorted(names, grams), len(names) - 1)
    return np.where(names[at] == grams, levels[at], 0).astype(np.int8)


@tidy
def list_prefixes(batches: Iterator[pa.RecordBatch], words: int, threshold: tuple[int, int], parts: int, frequent: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(part, records) of the documents (doc, data): the grams by which each can meet others. Of equal sets in a batch only the first goes.

    Parts below `parts` go by the gram, the others have the hot grams of some documents.
    """
    over, under = threshold
    release()
    for batch in batches:
        docs, found = batch.column(0).to_numpy(), []
        seen: set[tuple[int, int]] = set()
        for begin, texts in portions(batch.column(1)):
            of, grams = gram_sets(texts, words)
            if not len(of):
                continue
            sizes = np.bincount(of, minlength=len(texts))
            whole = np.zeros(len(texts), np.uint64)
            np.add.at(whole, of, mix(grams + np.uint64(7)))
            repeat = np.zeros(len(texts), bool)
            for i, key in enumerate(zip(whole.tolist(), sizes.tolist(), strict=True)):
                repeat[i] = key in seen
                seen.add(key)
            late = level_of(grams, frequent)
            order = np.lexsort([grams, late, of])
            of, grams = of[order], grams[order]
            place = np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of]
            first = sizes - -(-sizes * over // under) + 1
            chosen = (place < first[of]) & ~repeat[of]
            out = np.empty(int(chosen.sum()), RECORD)
            out["gram"], out["doc"] = grams[chosen], docs[begin : begin + len(texts)][of[chosen]]
            hot = late[order][chosen] >= HOT
            found.append((out, np.where(hot, mix(out["doc"].view(np.uint64) + np.uint64(5)), mix(out["gram"].copy())) % np.uint64(parts) + hot * np.uint64(parts)))
        if not found:
            continue
        records, part = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        part = part.astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(2 * parts + 1))
        rows = [(k, records[order[cuts[k] : cuts[k + 1]]].tobytes()) for k in range(2 * parts) if cuts[k] < cuts[k + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "records"])


def form_blocks(rows: pa.Table, parts: int) -> pa.Table:
    """(block, docs, grams): for every gram of two documents or more its documents; block is a hash of them, once in a part.

    In a part of hot grams these are pieces of blocks, of one document too, and grams lists the grams that have them; else it is null.
    """
    hot = rows["part"][0].as_py() >= parts
    records = np.frombuffer(b"".join(rows["records"].to_pylist()), RECORD)
    records = records[np.lexsort([records["doc"], records["gram"]])]
    fresh = np.ones(len(records), bool)
    fresh[1:] = (records["gram"][1:] != records["gram"][:-1]) | (records["doc"][1:] != records["doc"][:-1])
    records = records[fresh]
    cuts = np.flatnonzero(np.concatenate([[True], records["gram"][1:] != records["gram"][:-1]]))
    sizes = np.diff(np.append(cuts, len(records)))
    names = mix(np.add.reduceat(mix(records["doc"].view(np.uint64).copy() + np.uint64(99)), cuts) + sizes.astype(np.uint64)) if len(cuts) else np.zeros(0, np.uint64)
    many = np.flatnonzero(sizes > (0 if hot else 1))
    _, once, of = np.unique(names[many], return_index=True, return_inverse=True)
    heads = records["gram"][cuts[many]].view(np.int64)[np.argsort(of, kind="stable")]
    grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(once)))]), pa.int32()), pa.array(heads, pa.int64()))
    many = many[once]
    offsets = np.concatenate([[0], np.cumsum(sizes[many])])
    at = np.repeat(cuts[many] - offsets[:-1], sizes[many]) + np.arange(offsets[-1])
    return pa.table({"block": names[many].view(np.int64), "docs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(records["doc"][at], pa.int64())), "grams": grams if hot else pa.nulls(len(many), grams.type)})


def whole_blocks(formed: DataFrame) -> DataFrame:
    """(block, doc) of the rows of form_blocks; hot grams with the same pieces are one block, named by the least of them."""
    cold = formed.where("grams is null").groupBy("block").agg(F.first("docs").alias("docs")).select("block", F.explode("docs").alias("doc"))
    hot = formed.where("grams is not null").select(F.col("block").alias("piece"), "docs", "grams")
    held = hot.select(F.explode("grams").alias("gram"), "piece")
    told = held.groupBy("gram").agg(F.expr("bit_xor(xxhash64(piece))").alias("name"), F.count("*").alias("pieces"))
    chosen = told.groupBy("name", "pieces").agg(F.min("gram").alias("gram")).select("gram")
    return cold.unionAll(held.join(chosen, "gram").join(hot.select("piece", "docs"), "piece").select("gram", F.explode("docs")))


def asked(left: np.ndarray, right: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """The fewest shared grams that link sets of these sizes: over / under of the union."""
    over, under = threshold
    return -(-(left + right) * over // (over + under))


class Tree:
    """An R-tree over points, bulk loaded: level 0 are the points, each box above holds FANOUT of the level below."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        # neighbours in size, then in the first coordinates, share boxes
        slab = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // (FANOUT * FANOUT)
        self.order = np.lexsort([*points[:, :4].T, slab])
        self.tops, self.least, self.most = [points[self.order].astype(np.int32)], [sizes[self.order]], [sizes[self.order]]
        while len(self.tops[-1]) > 1:
            cuts = np.arange(0, len(self.tops[-1]), FANOUT)
            self.tops.append(np.maximum.reduceat(self.tops[-1], cuts, axis=0))
            self.least.append(np.minimum.reduceat(self.least[-1], cuts))
            self.most.append(np.maximum.reduceat(self.most[-1], cuts))


def bounded(a: Tree, b: Tree, level: int, i: np.ndarray, j: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which box pairs may hold a link, and the bound of what they share."""
    over, under = threshold
    keep, bound = np.zeros(len(i), bool), np.zeros(len(i), np.int64)
    for k in range(0, len(i), 16384):
        x, y = i[k : k + 16384], j[k : k + 16384]
        bound[k : k + 16384] = np.minimum(a.tops[level][x], b.tops[level][y]).sum(axis=1)
    low, high = (a.least[level][i], b.least[level][j]), (a.most[level][i], b.most[level][j])
    keep = (bound >= asked(*low, threshold)) & (high[0] * under >= low[1] * over) & (high[1] * under >= low[0] * over)
    return keep, bound


def tree_pairs(a: Tree, b: Tree, same: bool, threshold: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, bound) of the point pairs that no bound rules out; each unordered pair once if the trees are the same."""
    stack = [(max(len(a.tops), len(b.tops)) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while len(a.tops) < len(b.tops) or len(b.tops) < len(a.tops):
        short = a if len(a.tops) < len(b.tops) else b
        short.tops.append(short.tops[-1])
        short.least.append(short.least[-1])
        short.most.append(short.most[-1])
    child = np.arange(FANOUT)
    while stack:
        level, i, j = stack.pop()
        if same:
            i, j = i[i <= j], j[i <= j]
        keep, bound = bounded(a, b, level, i, j, threshold)
        i, j, bound = i[keep], j[keep], bound[keep]
        if not len(i):
            continue
        if not level:
            if same:
                i, j, bound = i[i < j], j[i < j], bound[i < j]
            yield a.order[i], b.order[j], bound
            continue
        for k in range(0, len(i), 2048):
            x = np.repeat((i[k : k + 2048, None] * FANOUT + child), FANOUT, axis=1).ravel()
            y = np.tile(j[k : k + 2048, None] * FANOUT + child, (1, FANOUT)).ravel()
            there = (x < len(a.tops[level - 1])) & (y < len(b.tops[level - 1]))
            stack.append((level - 1, x[there], y[there]))


def small_pairs(at: np.ndarray, points: np.ndarray, sizes: np.ndarray, side: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As tree_pairs, for many groups (rows of `at`) that are no larger than a box."""
    over, under = threshold
    i, j = np.triu_indices(at.shape[1], 1)
    x, y = at[:, i].ravel(), at[:, j].ravel()
    fit = (sizes[x] * under >= sizes[y] * over) & (sizes[y] * under >= sizes[x] * over) & ((side[x] != side[y]) | (side[x] == 0))
    x, y = x[fit], y[fit]
    bound = np.zeros(len(x), np.int64)
    for k in range(0, len(x), 16384):
        bound[k : k + 16384] = np.minimum(points[x[k : k + 16384]], points[y[k : k + 16384]]).sum(axis=1, dtype=np.int64)
    keep = bound >= asked(sizes[x], sizes[y], threshold)
    return x[keep], y[keep], bound[keep]


@tidy
def candidates(batches: Iterator[pa.RecordBatch], threshold: tuple[int, int], best_only: bool) -> Iterator[pa.RecordBatch]:
    """(a, b), a < b, of rows (block, one, two, side, doc, n, point, fine, component) sorted by block, one and two.

    best_only: for each document of a block, its most alike earlier one; else all pairs across components.
    """
    for rows, group in whole_groups(batches, ("block", *PAIR)):
        docs, sizes, side, component = (rows[c].to_numpy().astype(np.int64) for c in ("doc", "n", "side", "component"))
        points = unpacked_points(rows["point"].to_pylist())
        raw = [] if best_only else rows["fine"].to_pylist()
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        wide = np.diff(cuts)
        best = np.full(len(rows), -1.0)
        mate = np.full(len(rows), -1, np.int64)
        out: list[np.ndarray] = []

        def take(x: np.ndarray, y: np.ndarray, bound: np.ndarray) -> None:
            apart = component[x] != component[y]
            x, y, bound = x[apart], y[apart], bound[apart]
            x, y = np.where(docs[x] < docs[y], x, y), np.where(docs[x] < docs[y], y, x)
            if not best_only:
                for k in range(0, len(x), 1 << 18):
                    i, j = x[k : k + (1 << 18)], y[k : k + (1 << 18)]
                    near = fine_bound(i, j, sizes, raw) >= asked(sizes[i], sizes[j], threshold)
                    out.append(np.unique(np.stack([docs[i[near]], docs[j[near]]], axis=1), axis=0))
                return
            alike = bound / np.maximum(sizes[x] + sizes[y] - bound, 1)
            order = np.lexsort([docs[x], -alike, y])
            x, y, alike = x[order], y[order], alike[order]
            first = np.concatenate([[True], y[1:] != y[:-1]]) if len(y) else np.zeros(0, bool)
            x, y, alike = x[first], y[first], alike[first]
            more = alike > best[y]
            best[y[more]], mate[y[more]] = alike[more], x[more]

        for size in np.unique(wide[(wide > 1) & (wide <= FANOUT)]):
            begin = cuts[:-1][wide == size]
            for k in range(0, len(begin), 4096):
                take(*small_pairs(begin[k : k + 4096, None] + np.arange(size), points, sizes, side, threshold))
        for begin, end in zip(cuts[:-1][wide > FANOUT], cuts[1:][wide > FANOUT], strict=True):
            sides = [begin + np.flatnonzero(side[begin:end] == s) for s in (0, 1, 2)]
            if len(sides[0]):
                tree = Tree(points[sides[0]], sizes[sides[0]])
                pairs = ((sides[0][x], sides[0][y], bound) for x, y, bound in tree_pairs(tree, tree, True, threshold))
            elif len(sides[1]) and len(sides[2]):
                pairs = ((sides[1][x], sides[2][y], bound) for x, y, bound in tree_pairs(Tree(points[sides[1]], sizes[sides[1]]), Tree(points[sides[2]], sizes[sides[2]]), False, threshold))
            else:
                continue
            for found in pairs:
                take(*found)
        if best_only:
            has = mate >= 0
            out.append(np.stack([docs[mate[has]], docs[has]], axis=1))
        found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


@tidy
def verify_stream(batches: Iterator[pa.RecordBatch], words: int, threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(a, b) that link, of rows (lead, salt, role, doc, data) sorted by these; role 0 is the lead itself."""
    over, under = threshold
    lead, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        leads, salts, roles, docs = (batch.column(k).to_numpy() for k in range(4))
        linked: list[tuple[int, int]] = []
        for begin, texts in portions(batch.column(4)):
            of, grams = gram_sets(texts, words)
            cuts = np.searchsorted(of, np.arange(len(texts) + 1))
            for i in range(len(texts)):
                row, grams_i = begin + i, grams[cuts[i] : cuts[i + 1]]
                if roles[row] == 0:
                    lead, own = (leads[row], salts[row]), grams_i
                elif lead == (leads[row], salts[row]) and len(own) and len(grams_i):
                    at = np.searchsorted(own, grams_i)
                    shared = int((own[np.minimum(at, len(own) - 1)] == grams_i).sum())
                    if under * shared >= over * (len(own) + len(grams_i) - shared):
                        linked.append((int(leads[row]), int(docs[row])))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in linked], pa.int64()), pa.array([x[1] for x in linked], pa.int64())], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, words: int, threshold: tuple[int, int], few: bool = False) -> DataFrame:
    """The pairs (a, b) that link. Each lead a is compared with MEMBERS others in one place at most.

    `few` pairs (counted all the same) are broadcast, so that not all texts are shuffled for them.
    """
    crowd = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    members = pairs.join(crowd, "a").select(F.col("a").alias("lead"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("doc"))
    leads = crowd.select(F.col("a").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("doc"))
    requests = members.unionAll(leads)
    rows = (counted(requests) if few else requests).join(texts, "doc").select("lead", "salt", "role", "doc", "data")
    dealt = rows.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "role")
    return dealt.mapInArrow(lambda b: verify_stream(b, words, threshold), "a long, b long")


def near_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """id_col, n_shingles, component_id: one row per row of `df`.

    n_shingles is the size of the document's set, component_id the smallest id reachable by links
    (itself included). Documents without words (null text too) have no n-gram and no link. Rows that
    repeat an id are one document; of different texts the greatest counts. Rows with a null id link
    with nothing and have a null component. Texts of any length count whole; an empty table gives no rows. Other columns are not read.
    """
    over, under = threshold
    # some hundred short stages follow
    tidy_up = functools.partial(collect_garbage, df.sparkSession)
    named = df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("data"))
    repeated = df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count()
    texts = named.where("doc is not null")
    if repeated:
        texts = texts.groupBy("doc").agg(F.max("data").alias("data"))
    size = df.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    about = checkpointed(texts.mapInArrow(lambda b: describe(b, words), "doc long, n long, print binary, point binary, fine binary, frequent binary"))
    counts = about.where("frequent is not null").select("frequent").mapInArrow(list_counts, "gram long, count int")
    frequent = df.sparkSession.sparkContext.broadcast(frequent_grams(counts.groupBy("gram").agg(F.sum("count").alias("c"))))

    parts = max(32, int(size * 0.8 / PART_BYTES))
    prefixes = texts.mapInArrow(lambda b: list_prefixes(b, words, threshold, parts, frequent.value), "part int, records binary")
    blocks = checkpointed(prefixes.groupBy("part").applyInArrow(lambda t: form_blocks(t, parts), "block long, docs array<long>, grams array<long>"))
    points = about.where("n > 0").select("doc", "n", "print", "point", "fine")
    classes = points.groupBy("print").agg(F.min("doc").alias("first"))
    # a block's members, each set once
    members = checkpointed(whole_blocks(blocks).join(points.select("doc", "print"), "doc").join(classes, "print").select("block", F.col("first").alias("doc")).distinct())
    tidy_up()
    copies = points.join(classes, "print").select(F.col("doc").alias("a"), F.col("first").alias("b")).where("a <> b")

    def pairs_of(dealt: DataFrame, best_only: bool, few: bool = False) -> DataFrame:
        fine = F.lit(None).cast("binary") if best_only else F.col("fine")
        dealt = dealt.select("block", *PAIR, "side", "doc", "component")
        told = (counted(dealt) if few else dealt).join(points.select("doc", "n", "point", fine.alias("fine")), "doc")
        ordered = told.select("block", *PAIR, "side", "doc", "n", "point", "fine", "component").repartition("block", *PAIR).sortWithinPartitions("block", *PAIR)
        return ordered.mapInArrow(lambda b: candidates(b, threshold, best_only), "a long, b long").distinct()

    # at first every point is a component; then two points of each component of the blocks that had to be split
    alone, links, tried, turn = members.withColumn("component", F.col("doc")), copies, None, 0
    while True:
        new = checkpointed(pairs_of(split_alone(alone, "block", "doc", SPLIT, turn), True, turn > 0))
        tidy_up()
        joined = checkpointed(star_components(links.unionAll(verified(new, texts, words, threshold, turn > 0)), "a", "b", after_round=tidy_up))
        # components so far, as links
        links = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
        tried = new if tried is None else tried.unionAll(new)
        held = members.join(joined.withColumnRenamed("node", "doc"), "doc", "left").select("block", "doc", F.coalesce("component", "doc").alias("component"))
        split = alone.groupBy("block").agg(F.count("*").alias("rows")).where(F.col("rows") > SPLIT)
        ends = held.join(split, "block").groupBy("block", "rows", "component").agg(F.array_distinct(F.array(F.min("doc"), F.max("doc"))).alias("docs"))
        heads = checkpointed(ends.select("block", "rows", "component", F.explode("docs").alias("doc")))
        again = heads.groupBy("block", "rows").agg(F.count("*").alias("heads"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
        if turn:
            again = again.where("2 * heads <= rows")
        alone = checkpointed(heads.join(again.select("block"), "block", "left_semi").select("block", "doc", "component"))
        tidy_up()
        if alone.isEmpty():
            break
        turn += 1
    mixed = held.groupBy("block").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members"))
    # the only pair of a block of two was tried or ruled out in the first round
    mixed = mixed.where("x <> y and members > 2").select("block")
    sized = checkpointed(held.join(mixed, "block", "left_semi").join(points.select("doc", "n"), "doc"))
    rest = pairs_of(split_across(sized, "block", "doc", "component", "n", under / over, SPLIT), False).join(tried, ["a", "b"], "left_anti")
    more = checkpointed(verified(checkpointed(rest), texts, words, threshold))
    tidy_up()
    # the second round joins components of the first
    final = star_components(links.unionAll(more), "a", "b", after_round=tidy_up)
    result = about.select("doc", "n").join(final.withColumnRenamed("node", "doc"), "doc", "left").select("doc", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
    if repeated:
        told = named.where("doc is not null").select("doc").join(result, "doc")
    else:
        told = result
    nameless = named.where("doc is null").mapInArrow(lambda b: describe(b, words), "doc long, n long, print binary, point binary, fine binary, frequent binary")
    return told.unionAll(nameless.select("doc", "n", F.lit(None).cast("long"))).select(F.col("doc").alias(id_col), "n_shingles", "component_id")
