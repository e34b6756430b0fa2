"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if a `span`-byte string that covers it also starts earlier (smaller document id, or same
document, earlier start). The steps:

1. Anchors. In every span-byte string the GRAM-byte gram of least hash, leftmost of equals, is its
   anchor, a choice that depends on the string alone; so equal strings have equal anchors. The
   strings with one anchor start in a run of places; the bytes they cover are the anchor's context.
   One linear pass over the documents lists the anchors, one in some 35 bytes.
2. Equal contexts. A context that its batch has already is marked at once; of the others, one record
   (hashes of gram and context, document, places) goes by the gram's hash to a part. There all but
   the earliest of equal contexts are marked. A passage that a third of all documents hold thus
   costs one record per batch. Grams with several different contexts remain. Contexts of one gram
   are equal if 64 bits of their hashes are: among a million, a false match has a chance of 3e-8.
3. Merge. The bytes of those contexts are fetched and dealt into shards. Where the contexts of a gram
   exceed MERGE bytes, each is first cut into pieces by the anchor's place in the strings, NEAR places
   to a piece, and pieces are dealt by the span - NEAR + 1 bytes about the anchor that all their strings
   share: equal strings have equal ones, so they still meet. Each shard's suffixes are
   sorted once and give a Burrows-Wheeler transform. All shards are merged by iterative interleave
   refinement: in each round the merged suffixes step to the byte before them (the transforms say
   which) and are dealt stably by it, which orders them by one byte more; neighbours that part in
   round h have a common prefix of h - 1 bytes. Suffixes alone in their interval are settled and
   leave. The intervals after `span` rounds are those with a common prefix of span bytes. No suffix is
   compared or sorted again.
4. In each interval all members but the earliest are marked; marks are joined to the documents and
   the marked bytes cut out.

Parts are sized by the bytes of the input (PART_BYTES), so a task's memory doesn't grow with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxbow.llm.caches import release, tidy
from oxbow.llm.hashing import both_powers, mix
from oxbow.session import checkpointed

SPAN = 100
GRAM = 32
#: Suffixes of one shard; suffixes merged at a time; bytes of records in a part, about.
SHARD = 1 << 16
MERGE = 1 << 21
PART_BYTES = 16 << 20
#: Anchor places of strings that stay together where a gram's contexts are split.
NEAR = 9
#: Bytes of texts that are read together.
PORTION = 1 << 20
#: doc and row (a hash of the text) name a text; equal rows are one text.
RECORD = np.dtype([("gram", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("first", "<i4"), ("last", "<i4"), ("place", "<u2")])
MARK = np.dtype([("doc", "<i8"), ("row", "<i8"), ("first", "<i4"), ("last", "<i4")])
#: The doc of a null id.
NAMELESS = (1 << 63) - 1


def anchors(data: np.ndarray, sizes: np.ndarray, span: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after the other in `data`: text, first and last start of the strings of each anchor, the anchor's place after the first, hashes of its gram and of its context."""
    none = np.zeros(0, np.int64)
    n, window = len(data), span - gram + 1
    if n < span:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = both_powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    ends = np.cumsum(sizes)
    places = []
    step = 1 << 20
    for begin in range(0, len(h) - window + 1, step):
        part = h[begin : begin + step + window - 1]
        # the hash's upper bits, then the place: the least of these is the leftmost of the least
        least = (part >> np.uint64(22) << np.uint64(22)) | np.arange(len(part), dtype=np.uint64)
        have = 1
        while have < window:
            shift = min(have, window - have)
            least = np.minimum(least[:-shift], least[shift:])
            have += shift
        places.append((least & np.uint64((1 << 22) - 1)).astype(np.int64) + begin)
    place = np.concatenate(places)
    start = np.concatenate([np.arange(e - z, max(e - z, e - span + 1)) for e, z in zip(ends, sizes, strict=True)]).astype(np.int64)
    place = place[start]
    text = np.searchsorted(ends, start, side="right")
    cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    last = start[np.concatenate([cut[1:] - 1, [len(start) - 1]])] if len(start) else none
    first, place, text = start[cut], place[cut], text[cut]
    context = mix((sums[last + span] - sums[first]) * down[first] + (last - first).astype(np.uint64) + ((place - first).astype(np.uint64) << np.uint64(20)))
    offset = (ends - sizes)[text]
    return text, first - offset, last - offset, place - first, h[place], context


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of a shard in the order of their first `depth` symbols, equal ones by place (prefix doubling from 8 symbols on)."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for j in range(min(8, depth)):
        key <<= np.uint64(8)
        key[: n - j] |= text[j:]
    have = min(8, depth)
    while True:
        order = np.argsort(key, kind="stable")
        if have >= depth:
            return order
        ranks = np.empty(n, np.uint64)
        rising = key[order]
        ranks[order] = np.cumsum(np.concatenate([[False], rising[1:] != rising[:-1]])).astype(np.uint64) + np.uint64(1)
        shift = min(have, depth - have)
        key = ranks << np.uint64(32)
        key[: max(0, n - shift)] |= ranks[shift:]
        have += shift


def repeated_intervals(contexts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, context, offset) of every span-byte string that occurs in two places or more of `contexts`."""
    sizes = np.array([len(c) + 1 for c in contexts], np.int64)
    bounds = np.cumsum(sizes)
    shards, begin = [], 0
    while begin < len(contexts):
        base = bounds[begin] - sizes[begin]
        end = max(begin + 1, int(np.searchsorted(bounds, base + SHARD, side="right")))
        shards.append((begin, end))
        begin = end
    symbols, steps, starts, base = [], [], [], 0
    for a, b in shards:
        text = np.frombuffer(b"\0".join(contexts[a:b]) + b"\0", np.uint8)
        ends = np.cumsum(sizes[a:b]) - 1
        # end marks are 0 and sort first; no UTF-8 byte is 255
        symbol = text + np.uint8(1)
        symbol[ends] = 0
        order = sorted_suffixes(symbol, span)
        transform = symbol[order - 1]
        # where entry i leads: the suffix that is one byte longer
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lead = rank[order - 1]
        symbols.append(transform)
        steps.append(lead + base)
        starts.append(order + (bounds[a] - sizes[a]))
        base += len(order)
    transform, lead, place = np.concatenate(symbols), np.concatenate(steps).astype(np.int32), np.concatenate(starts)
    # only strings that end where a context has `span` bytes before can be that long
    context = np.searchsorted(bounds, place, side="right")
    entry = np.flatnonzero(place - (bounds[context] - sizes[context]) >= span).astype(np.int32)
    block = np.zeros(len(entry), np.int32)
    for h in range(span):
        symbol = transform[entry]
        order = np.argsort(symbol, kind="stable")
        symbol, block, entry = symbol[order], block[order], lead[entry[order]]
        fresh = np.ones(len(entry), bool)
        np.not_equal(symbol[1:], symbol[:-1], out=fresh[1:])
        fresh[1:] |= block[1:] != block[:-1]
        block = np.cumsum(fresh, dtype=np.int32)
        # suffixes alone in their interval are settled
        if h % 4 == 3 or h == span - 1:
            alone = fresh.copy()
            alone[:-1] &= fresh[1:]
            if alone.any():
                entry, block = entry[~alone], block[~alone]
        if not len(entry):
            break
    place = place[entry]
    context = np.searchsorted(bounds, place, side="right")
    return block, context, place - (bounds[context] - sizes[context])


def turn_of(doc: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The order of texts of one doc: texts without an id are documents of their own, texts of one id are one document."""
    return np.where(doc == NAMELESS, row, 0)


def unequal_first(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest records of each gram and context, one for each text at the earliest place; the later ones)."""
    turn = turn_of(records["doc"], records["row"])
    order = np.lexsort([records["row"], records["first"], turn, records["doc"], records["context"], records["gram"]])
    records, turn = records[order], turn[order]
    if not len(records):
        return records, records
    fresh = np.ones(len(records), bool)
    fresh[1:] = (records["gram"][1:] != records["gram"][:-1]) | (records["context"][1:] != records["context"][:-1])
    again = np.zeros(len(records), bool)
    again[1:] = ~fresh[1:] & (records["doc"][1:] == records["doc"][:-1]) & (records["row"][1:] == records["row"][:-1]) & (records["first"][1:] == records["first"][:-1])
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    late = (records["doc"] != records["doc"][head]) | (turn != turn[head]) | (records["first"] != records["first"][head])
    return records[~late & ~again], records[late & ~again]


def marks_of(records: np.ndarray) -> np.ndarray:
    out = np.empty(len(records), MARK)
    for name in MARK.names:
        out[name] = records[name]
    return out


@tidy
def list_records(batches: Iterator[pa.RecordBatch], span: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, records, marks) of the documents (doc, row, data)."""
    release()
    for batch in batches:
        docs, rows_of, column = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        found, begin = [], 0
        while begin < len(column):
            texts, size, end = [], 0, begin
            while end < len(column) and (size < PORTION or end == begin):
                texts.append(column[end].as_py().encode("utf-8", "replace"))
                size += len(texts[-1])
                end += 1
            sizes = np.array([len(t) for t in texts], np.int64)
            text, first, last, place, gram, context = anchors(np.frombuffer(b"".join(texts), np.uint8), sizes, span)
            out = np.empty(len(text), RECORD)
            out["gram"], out["context"], out["first"], out["last"], out["place"] = gram, context, first, last, place
            out["doc"], out["row"] = docs[begin:end][text], rows_of[begin:end][text]
            found.append(out)
            begin = end
        if not found:
            continue
        records, others = unequal_first(np.concatenate(found))
        part = (records["gram"] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        marks = marks_of(others)
        share = np.linspace(0, len(marks), parts + 1).astype(int)
        rows = [(k, records[order[cuts[k] : cuts[k + 1]]].tobytes(), marks[share[k] : share[k + 1]].tobytes()) for k in range(parts)]
        rows = [r for r in rows if r[1] or r[2]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "records", "marks"])


def spans_table(marks: np.ndarray, wanted: np.ndarray, crowded: np.ndarray) -> pa.Table:
    """Rows (doc, row, gram, first, last, place): gram is null for a mark, else the context is wanted; place is -1 unless the gram is crowded."""
    gram = pa.array(np.concatenate([np.zeros(len(marks), np.int64), wanted["gram"].view(np.int64)]), pa.int64(), mask=np.concatenate([np.ones(len(marks), bool), np.zeros(len(wanted), bool)]))
    both = {c: np.concatenate([marks[c], wanted[c]]) for c in MARK.names}
    place = np.concatenate([np.full(len(marks), -1, np.int32), np.where(crowded, wanted["place"].astype(np.int32), -1).astype(np.int32)])
    return pa.table({"doc": both["doc"], "row": both["row"], "gram": gram, "first": both["first"], "last": both["last"], "place": place})


def pieces(gram: int, first: int, last: int, place: int, data: bytes, span: int) -> Iterator[tuple[int, int, bytes]]:
    """(key, first start, bytes) of the parts of a context by the anchor's place in its strings; place is the anchor's after `first`."""
    anchor = first + place
    for k in range((anchor - last) // NEAR, place // NEAR + 1):
        # the strings that have the anchor at places k * NEAR to (k + 1) * NEAR - 1; all hold data[low:high]
        low, high = anchor - k * NEAR, anchor - (k + 1) * NEAR + 1 + span
        begin, end = max(first, anchor - (k + 1) * NEAR + 1), min(last, low)
        name = hashlib.blake2b(data[low:high], digest_size=8, key=(gram & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little") + bytes([k])).digest()
        yield int.from_bytes(name, "little", signed=True), begin, data[begin : end + span]


def meet_records(rows: pa.Table, span: int) -> pa.Table:
    records = np.frombuffer(b"".join(rows["records"].to_pylist()), RECORD)
    marks = np.frombuffer(b"".join(rows["marks"].to_pylist()), MARK)
    firsts, others = unequal_first(records)
    several = np.zeros(len(firsts), bool)
    same = firsts["gram"][1:] == firsts["gram"][:-1]
    several[1:] |= same
    several[:-1] |= same
    wanted = firsts[several]
    _, group = np.unique(wanted["gram"], return_inverse=True)
    size = np.bincount(group, weights=wanted["last"] - wanted["first"] + span)
    return spans_table(np.concatenate([marks, marks_of(others)]), wanted, size[group] > MERGE)


@tidy
def cut_contexts(batches: Iterator[pa.RecordBatch], span: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, grams, docs, rows, firsts, contexts) of the documents (doc, row, data, wanted); of equal rows that follow each other, once."""
    before = None
    for batch in batches:
        by: dict[int, list[tuple]] = {}
        for doc, row, data, wanted in zip(*(batch.column(k) for k in range(4)), strict=True):
            doc, row = doc.as_py(), row.as_py()
            if (doc, row) == before:
                continue
            before = doc, row
            data = data.as_py().encode("utf-8", "replace")
            for w in wanted.as_py():
                found = [(w["gram"], w["first"], data[w["first"] : w["last"] + span])] if w["place"] < 0 else pieces(w["gram"], w["first"], w["last"], w["place"], data, span)
                for gram, first, text in found:
                    by.setdefault((gram & 0x7FFFFFFFFFFFFFFF) % parts, []).append((gram, doc, row, first, text))
        rows = [(k, *(list(c) for c in zip(*v, strict=True))) for k, v in by.items()]
        kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["part", "grams", "docs", "rows", "firsts", "contexts"])


def merge_contexts(rows: pa.Table, span: int) -> pa.Table:
    grams, docs, hashes, firsts = (rows[c].combine_chunks().flatten().to_numpy() for c in ("grams", "docs", "rows", "firsts"))
    texts = rows["contexts"].combine_chunks().flatten().to_pylist()
    order = np.argsort(grams, kind="stable")
    sizes = np.array([len(t) + 1 for t in texts], np.int64)[order]
    fresh = np.concatenate([[True], grams[order][1:] != grams[order][:-1]])
    out, begin = [np.zeros(0, MARK)], 0
    heads = np.append(np.flatnonzero(fresh), len(order))
    filled = np.concatenate([[0], np.cumsum(sizes)])
    k = 0
    while k < len(heads) - 1:
        # as many whole groups as fit
        end = max(k + 1, int(np.searchsorted(filled[heads], filled[heads[k]] + MERGE, side="right")) - 1)
        chosen = order[heads[k] : heads[end]]
        k = end
        block, context, offset = repeated_intervals([texts[i] for i in chosen], span)
        doc, row, start = docs[chosen][context], hashes[chosen][context], firsts[chosen][context] + offset
        turn = turn_of(doc, row)
        order2 = np.lexsort([start, turn, doc, block])
        doc, row, start, block, turn = doc[order2], row[order2], start[order2], block[order2], turn[order2]
        # the earliest of each interval stays, in all texts that hold it there
        fresh = np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.zeros(0, bool)
        head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        late = (doc != doc[head]) | (turn != turn[head]) | (start != start[head])
        doc, row, start = doc[late], row[late], start[late]
        by = np.lexsort([start, row, doc])
        doc, row, start = doc[by], row[by], start[by]
        run = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] > start[:-1] + span)])) if len(doc) else np.zeros(0, np.int64)
        marks = np.empty(len(run), MARK)
        if len(run):
            marks["doc"], marks["row"], marks["first"], marks["last"] = doc[run], row[run], start[run], start[np.append(run[1:] - 1, len(start) - 1)]
        out.append(marks)
    found = np.concatenate(out)
    return pa.table({c: found[c] for c in MARK.names})


@tidy
def cut_marks(batches: Iterator[pa.RecordBatch], span: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """What is left of the documents (row, data, marks)."""
    for batch in batches:
        columns: list[list] = [[], [], [], []]
        texts = []
        for data, marks in zip(batch.column("repeat_text"), batch.column("repeat_marks"), strict=True):
            data = (data.as_py() or "").encode("utf-8", "replace")
            found = marks.as_py() or []
            removed = spans = 0
            kept = data
            if found:
                edges = np.zeros(len(data) + 1, np.int32)
                np.add.at(edges, np.minimum([m["first"] for m in found], len(data)), 1)
                np.add.at(edges, np.minimum([m["last"] + span for m in found], len(data)), -1)
                gone = np.cumsum(edges[:-1]) > 0
                removed = int(gone.sum())
                spans = int((gone[1:] & ~gone[:-1]).sum()) + int(len(gone) > 0 and gone[0])
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            for c, x in zip(columns, (len(data), removed, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                c.append(x)
            if with_text:
                texts.append(kept.decode("utf-8", "ignore"))
        names = [*batch.schema.names[2:], "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        arrays = [*batch.columns[2:], *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
        if with_text:
            names.append("kept_text")
            arrays.append(pa.array(texts, pa.string()))
        yield pa.RecordBatch.from_arrays(arrays, names)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, with_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 (, kept_text, and the columns in `keep`), one row per row of `df`.

    Texts are UTF-8 bytes, null as empty; matches never cross documents, and strings are judged on
    the input. kept_text drops the bytes of a character that was cut in two. Rows that repeat an id are
    one document: equal strings at the same place of its texts are none earlier than the other, and
    a text only loses what it holds itself. Documents without an id count as later than all others,
    each different text as a document of its own (in the order of a hash of the text); equal rows are
    one. Texts shorter than `span` stay whole, of any length all is read; an empty table gives no rows. Other columns are not read.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NAMELESS)).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row")
    texts = df.select(*key, F.coalesce(F.col(text_col), F.lit("")).alias("data"))
    size = texts.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts = max(32, int(size * RECORD.itemsize / 35 / PART_BYTES))
    records = texts.mapInArrow(lambda b: list_records(b, span, parts), "part int, records binary, marks binary")
    spans = checkpointed(records.groupBy("part").applyInArrow(lambda t: meet_records(t, span), "doc long, row long, gram long, first int, last int, place int"))

    # One shuffle of the texts by document serves both joins below (the exchange is reused).
    names = list(dict.fromkeys([id_col, *(keep or [])]))
    whole = df.select(*key, F.col(text_col).alias("repeat_text"), *names)
    pair = F.struct("first", "last")
    wanted = spans.where("gram is not null").groupBy("doc", "row").agg(F.collect_list(F.struct("gram", "first", "last", "place")).alias("wanted"))
    # fetched has all columns of `whole`, or else its exchange would be another one
    fetched = whole.join(wanted, ["doc", "row"]).select("doc", "row", F.coalesce("repeat_text", F.lit("")).alias("data"), "wanted", *names)
    contexts = fetched.mapInArrow(lambda b: cut_contexts(b, span, parts), "part int, grams array<long>, docs array<long>, rows array<long>, firsts array<int>, contexts array<binary>")
    merged = contexts.groupBy("part").applyInArrow(lambda t: merge_contexts(t, span), "doc long, row long, first int, last int")
    marks = spans.where("gram is null").select("doc", "row", "first", "last").unionAll(merged).groupBy("doc", "row").agg(F.collect_set(pair).alias("repeat_marks"))
    told = whole.join(marks, ["doc", "row"], "left").select("repeat_text", "repeat_marks", *names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.schema.fields[2:])
    return told.mapInArrow(lambda b: cut_marks(b, span, with_text), f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)
