"""Quality classifier: supervised subword embeddings.

Words (`[^\\x20\\x09-\\x0D]+`) and their character n-grams are hashed to rows of one embedding table. A
word is the mean of its rows, a document the mean of its words, and a softmax layer gives the
class probabilities. Table and layer are trained by numpy stochastic gradient descent.

As the output is linear before the softmax, a trained model is kept as one logit per table row; a
word's logit is computed once per worker and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxbow.llm.caches import give_back, held, tidy
from oxbow.llm.samples import labelled_texts, remainder

SPLIT = re.compile(r"[^\x20\x09-\x0D]+").findall
#: Stands for a word that repeats the one before it; no word holds a space.
AGAIN = " again"
ROWS = 1 << 16
DIM = 10
GRAMS = (3, 4)
EPOCHS = 6
RATE = 4.0
#: Rows per label that the classifier is fitted on at most, about.
PER_LABEL = 2000
#: Documents score 1 from here on.
THRESHOLD = 0.3
#: Words whose logits a worker remembers, about 30 MB; beyond this it forgets all and starts anew.
CACHE = 200_000


def words_of(text: str) -> list[str]:
    """The words, and AGAIN for each that follows its like."""
    words = SPLIT(text)
    return words + [AGAIN] * sum(map(eq, words, islice(words, 1, None)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, table row) of every feature of `words`, vectorised over all of them."""
    text = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    owners, rows = [], []
    rolling = np.zeros(len(text), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(text) < n:
            break
        rolling = rolling[: len(text) - n + 1] * np.uint64(1_000_003) + text[n - 1 :]
        if n in GRAMS:
            inside = owner[: len(rolling)] == owner[n - 1 :]
            owners.append(owner[: len(rolling)][inside])
            rows.append(mixed(rolling[inside] + np.uint64(n)))
    # the word itself
    weight = np.full(len(text), np.uint64(0x100000001B3)).cumprod(dtype=np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    place = np.arange(len(text)) - np.repeat(starts, sizes)
    owners.append(np.arange(len(words)))
    rows.append(mixed(np.add.reduceat(text * weight[place], starts) if len(words) else np.zeros(0, np.uint64)))
    return np.concatenate(owners), (np.concatenate(rows) % np.uint64(ROWS)).astype(np.int64)


def document_row(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of a document and their weights, which sum to 1 (none for a text without words)."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    distinct, times = np.unique(np.array(words, dtype=object), return_counts=True)
    owner, rows = features(distinct.tolist())
    weight = (times / len(words) / np.bincount(owner, minlength=len(distinct)))[owner]
    used, at = np.unique(rows, return_inverse=True)
    return used, np.bincount(at, weights=weight)


@dataclass(frozen=True)
class Model:
    """logit: of label 1 against label 0 for each table row; bias: of a text without words."""

    logit: np.ndarray
    bias: float

    def word_logits(self, words: list[str]) -> np.ndarray:
        owner, rows = features(words)
        return np.bincount(owner, weights=self.logit[rows], minlength=len(words)) / np.bincount(owner, minlength=len(words))


def train(examples: list[tuple[str, int]], seed: int = 7) -> Model:
    """Examples are (text, 0 or 1). With no example of a class, the other one is certain from the bias."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (ROWS, DIM))
    layer, bias = np.zeros((DIM, 2)), np.zeros(2)
    data = [(*document_row(text), int(label)) for text, label in examples]
    steps, done = max(1, EPOCHS * len(data)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            rows, weight, label = data[k]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = weight @ table[rows]
            out = hidden @ layer + bias
            p = np.exp(out - out.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= 0.1 * rate * np.outer(hidden, p)
            bias -= 0.02 * rate * p
            # rows of a document share its gradient by weight; scaled to the largest so rare words learn too
            if len(rows):
                table[rows] -= rate * np.outer(weight / weight.max() * 0.05, back)
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """A worker's copy of a model with the logits of words it has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def scores(self, texts: list[str]) -> list[float]:
        each = [words_of(t) for t in texts]
        known = self.known
        new = [*set().union(*each).difference(known)]
        if len(known) + len(new) > CACHE:
            known.clear()
            new = [*set().union(*each)]
        if new:
            known.update(zip(new, self.model.word_logits(new).tolist(), strict=True))
        get = known.__getitem__
        out = []
        for words in each:
            x = self.model.bias + (sum(map(get, words)) / len(words) if words else 0.0)
            out.append(float(1 / (1 + np.exp(-x))))
        return out


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """id_col, score, predicted for every row of `df` (and the columns in `keep`); no shuffle.

    Null and empty texts have the score of the bias alone. Whole texts are read, however long; repeated rows, null
    ids and other columns are fine; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # ROWS floats, 256 KB

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from oxbow.llm.packing import portions

        scorer = held(("quality", id(shared.value)), lambda: Scorer(shared.value))
        for batch in batches:
            scores = [s for part in portions(batch.column("scored_text")) for s in scorer.scores(part)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], [*batch.schema.names[1:], "score"])

    names = list(dict.fromkeys([id_col, *(keep or [])]))
    source = df.select(F.col(text_col).alias("scored_text"), *names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]) + ", score double"
    return source.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def train_on(documents: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL) -> Model:
    """Fit on about `per_label` rows of each label, none of them held out (crc32(id) mod 5 = 0)."""
    learn = labels.where(remainder(id_col, 5) != 0)
    model = train(labelled_texts(documents, learn, id_col, text_col, label_col, per_label, most_labels=2))
    give_back()  # the driver would keep what the examples took
    return model
