"""Byte-level BPE encoding and decoding by longest matches and backtracking.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over strings finds, in
one pass, the longest token that starts at every byte of a pre-token. The encoder takes longest
matches from the left; two neighbours may stand together only if merging their joint bytes would
keep them apart (`compatible`, memoised). Where none of the tokens at a place fits its
predecessor, it steps back and marks the place as dead, so every place is left at most once: time
is linear in the text, and the ids are exactly those of rank-ordered merging.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame

from oxbow.llm import vocabulary
from oxbow.llm.caches import held, tidy
from oxbow.llm.pretokens import splitter

#: Pre-tokens whose ids a worker remembers; beyond this it forgets all and starts anew.
CACHE = 400_000
NEVER = 1 << 60


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.shorter = {i: next((ranks[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in ranks), -1) for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.split = splitter(pattern)
        self._halves: dict[int, tuple[int, int]] = {}
        self._fits: dict[int, bool] = {}
        self._known: dict[str, bytes] = {}

    @classmethod
    def from_rank_file(cls, data: bytes) -> Encoder:
        """From lines of a base64 token and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a})

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made `token`; merging its bytes stops one step before it."""
        if (known := self._halves.get(token)) is None:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                _, i = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both ends with exactly these two tokens.

        It goes back in time from the finished tokens: the one formed last is undone first, and
        what faces the seam then must not be a pair that would have merged before that moment. Of
        equal ranks the leftmost merges first, hence the one more on the right side.
        """
        key = left << 32 | right
        if (known := self._fits.get(key)) is None:
            x, y, until, known = left, right, NEVER, True
            while True:
                if self.ranks.get(self.bytes_of[x] + self.bytes_of[y], NEVER) < until:
                    known = False
                    break
                one, other = self.size[x] == 1, self.size[y] == 1
                if one and other:
                    break
                if not one and (other or x > y):
                    until, x = x, self.halves(x)[1]
                else:
                    until, y = y + 1, self.halves(y)[0]
            if len(self._fits) >= 2 * CACHE:
                self._fits.clear()
            self._fits[key] = known
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n, size, shorter, fits = len(data), self.size, self.shorter, self.compatible
        longest = [-1] * n
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size[token]] = token
        dead, out, at = bytearray(n + 1), [], 0
        token = longest[0]
        while True:
            before = out[-1] if out else -1
            while token >= 0 and (dead[at + size[token]] or before >= 0 and not fits(before, token)):
                token = shorter[token]
            if token < 0:
                if not out:
                    raise ValueError("a byte is missing from the vocabulary")
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                token = shorter[token]
                continue
            out.append(token)
            at += size[token]
            if at == n:
                return out
            token = longest[at]

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known, out = self._known, []
        for piece in self.split(text):
            if (ids := known.get(piece)) is None:
                if len(known) >= CACHE:
                    known.clear()
                ids = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
                if len(piece) <= 64:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encoder_of(data: bytes) -> Encoder:
    """The worker's encoder of this rank file."""
    return held(("bpe", hash(data)), lambda: Encoder.from_rank_file(data))


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text; one row per row of `df`, no shuffle.

    Returns id_col, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and
    decoded_sha256 (of the bytes decoded from the ids), and the ids too if `with_ids`. A null text
    counts as empty; repeated rows, null ids, texts of any length and other columns of any name are fine; an empty
    table gives no rows.
    """
    shared = vocabulary.shared(df.sparkSession, path or vocabulary.default("byte_bpe_50k.tiktoken"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            n, first, second, kept = [], [], [], []
            for text in batch.column(1):
                packed = encoder.encode_packed(text.as_py() or "")
                ids = np.frombuffer(packed, "<u4").tolist()
                n.append(len(ids))
                first.append(hashlib.sha256(packed).hexdigest())
                second.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    source = df.select(id_col, text_col)
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
