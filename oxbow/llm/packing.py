"""Packing by power-of-two decomposition: no sequence crosses documents.

A document of L ids is cut into as many pieces of the window's length as fit, and the rest by the
binary digits of its length, longest first. Every piece is a sequence of its own: its length is a
power of two, so it needs no padding, and sequences of equal length form a bucket from which
batches are drawn (`bucket` is the power; write with partitionBy("bucket")).
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oxbow.llm import vocabulary
from oxbow.llm.caches import held, tidy
from oxbow.llm.pretokens import splitter

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: Pre-tokens of one generation that a worker remembers; two generations are held, about 60 MB.
CACHE = 150_000
PORTION = 1_000_000


def byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in printable else next(others) for b in range(256)}


class Ids:
    """Ids by a tokenizers file. Byte-level files work pre-token by pre-token, so their ids are remembered."""

    def __init__(self, data: bytes) -> None:
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        about = json.loads(data)
        before = about.get("pre_tokenizer") or {}
        own = all(t.get("special") for t in about.get("added_tokens") or [])
        self.by_piece = own and about.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.split, self.letters = splitter(), byte_letters()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_piece:
            for text in texts:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            return
        each = [self.split(text) for text in texts]
        known, before, merge, letters = self.known, self.before, self.tokenizer.model.tokenize, self.letters
        for piece in set(chain.from_iterable(each)).difference(known):
            known[piece] = before.get(piece) or array("I", [t.id for t in merge(piece.encode().decode("latin-1").translate(letters))]).tobytes()
        for found in each:
            yield b"".join(map(known.__getitem__, found))
        if len(known) > CACHE:
            # what the next CACHE pre-tokens don't use is forgotten
            self.before, self.known = known, {}


def ids_of(data: bytes) -> Ids:
    return held(("packing", hash(data)), lambda: Ids(data))


def portions(texts: pa.Array) -> Iterator[list[str]]:
    """The texts, nulls as empty ones, in lists of about PORTION characters or a single text."""
    taken, size = [], 0
    for text in texts:
        taken.append(text.as_py() or "")
        size += len(taken[-1])
        if size >= PORTION:
            yield taken
            taken, size = [], 0
    if taken:
        yield taken


def pieces(length: int, window: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each piece, longest first."""
    at = 0
    for _ in range(length // window):
        yield at, window
        at += window
    rest = length % window
    for k in range(rest.bit_length() - 1, -1, -1):
        if rest >> k & 1:
            yield at, 1 << k
            at += 1 << k


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (, ids).

    `window` is a power of two. A null or empty text has the end id alone, so one piece of length 1;
    every row of `df` is packed, repeated rows, null ids and texts of any length as well; other columns are not read,
    and an empty table gives no rows.
    Nothing is shuffled. sequence_id is unique; it follows the order of the input's splits.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("window must be a power of two")
    shared = vocabulary.shared(df.sparkSession, path or vocabulary.default("byte_bpe_50k.json"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_by, last = ids_of(shared.value), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, start, length, crc, total, kept = [], [], [], [], [], []
            for i, found in enumerate(chain.from_iterable(map(ids_by.of, portions(batch.column(1))))):
                ids = np.frombuffer(found + last, "<u4")
                for at, n in pieces(len(ids), window):
                    part = ids[at : at + n]
                    rows.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
                    if with_ids:
                        kept.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    source = df.select(id_col, text_col)
    kind = source.schema[0].dataType.simpleString()
    out = source.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)
    return out.select(id_col, "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"), *["ids"] * with_ids)
