"""Language identification by a bidirectional gated recurrent network over bytes.

The UTF-8 bytes of a text are read in windows of WINDOW bytes, all of them, in both directions. Every
position gets a distribution over the languages from the two states there; a document's is the
mean over its positions. The network is trained in numpy by backpropagation through time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxbow.llm.caches import give_back, release, tidy
from oxbow.llm.samples import labelled_texts, remainder

HIDDEN = 8
WINDOW = 48
#: Steps of the training for up to MANY languages; more languages get more steps in proportion.
STEPS = 220
MANY = 16
BATCH = 192
RATE = 0.02
#: Documents per language that the network is fitted on at most, about.
PER_LABEL = 400
#: Windows that are read side by side.
SIDE = 4096
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]").search


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    """inputs: 2 x 3H x 256, states: 2 x 3H x H (gates: update, reset, candidate); layer: L x 2H; bias: L x 1."""

    labels: list[str]
    inputs: np.ndarray
    states: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.states, self.layer, self.bias]


def start(labels: list[str], seed: int) -> Model:
    rng, h = np.random.default_rng(seed), HIDDEN
    draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
    return Model(labels, draw(2, 3 * h, 256, by=0.3), draw(2, 3 * h, h, by=h**-0.5), draw(len(labels), 2 * h, by=0.3), np.zeros((len(labels), 1), np.float32))


def sweep(inputs: np.ndarray, states: np.ndarray, steps: np.ndarray, saved: list | None = None) -> np.ndarray:
    """States (T x H x B) of one direction over bytes `steps` (T x B)."""
    h, (length, wide) = HIDDEN, steps.shape
    out = np.empty((length, h, wide), np.float32)
    state = np.zeros((h, wide), np.float32)
    for t in range(length):
        given, own = inputs[:, steps[t]], states @ state
        gates = given[: 2 * h]
        gates += own[: 2 * h]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        update, reset = gates[:h], gates[h:]
        candidate = given[2 * h :]
        candidate += reset * own[2 * h :]
        np.tanh(candidate, out=candidate)
        if saved is not None:
            saved.append((state, update, reset, candidate, own[2 * h :]))
        state = candidate + update * (state - candidate)
        out[t] = state
    return out


def position_probabilities(model: Model, steps: np.ndarray) -> np.ndarray:
    """Probabilities (T x L x B) at every position of windows `steps` (T x B)."""
    forth = sweep(model.inputs[0], model.states[0], steps)
    back = sweep(model.inputs[1], model.states[1], steps[::-1])[::-1]
    h = HIDDEN
    logits = model.layer[:, :h] @ forth + model.layer[:, h:] @ back + model.bias
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def gradient(model: Model, steps: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions, and its gradient by backpropagation through time."""
    h, (length, wide) = HIDDEN, steps.shape
    kept: list[list] = [[], []]
    order = [steps, steps[::-1]]
    hidden = [sweep(model.inputs[d], model.states[d], order[d], kept[d]) for d in (0, 1)]
    both = np.concatenate([hidden[0], hidden[1][::-1]], axis=1)
    logits = model.layer @ both + model.bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(wide)
    loss = float(-np.log(p[:, labels, at] + 1e-9).mean())
    p[:, labels, at] -= 1
    p /= length * wide
    d_layer = np.einsum("tlb,thb->lh", p, both)
    d_bias = p.sum(axis=(0, 2))[:, None]
    d_both = model.layer.T @ p
    d_inputs, d_states = np.zeros_like(model.inputs), np.zeros_like(model.states)
    for d in (0, 1):
        out = d_both[:, :h] if d == 0 else d_both[::-1, h:]
        carry = np.zeros((h, wide), np.float32)
        for t in range(length - 1, -1, -1):
            before, update, reset, candidate, own = kept[d][t]
            carry = carry + out[t]
            d_candidate = carry * (1 - update) * (1 - candidate**2)
            d_update = carry * (before - candidate) * update * (1 - update)
            d_reset = d_candidate * own * reset * (1 - reset)
            gates = np.concatenate([d_update, d_reset, d_candidate])
            hot = np.zeros((wide, 256), np.float32)
            hot[at, order[d][t]] = 1
            d_inputs[d] += gates @ hot
            gates[2 * h :] *= reset
            d_states[d] += gates @ before.T
            carry = carry * update + model.states[d].T @ gates
    return loss, [d_inputs, d_states, d_layer, d_bias]


def train(examples: list[tuple[str, str]], seed: int = 11) -> Model:
    """Examples are (text, language). Each step draws languages evenly, then texts and places in them."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[np.ndarray]] = {}
    for text, label in examples:
        if LETTER(text):
            by.setdefault(label, []).append(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
    labels = sorted(by)
    model = start(labels, seed)
    if len(labels) < 2:
        return model
    first, second = [[np.zeros_like(x) for x in model.parts()] for _ in (0, 1)]
    most = -(-STEPS * max(len(labels), MANY) // MANY)
    for step in range(1, most + 1):
        which = rng.integers(len(labels), size=BATCH)
        steps = np.full((WINDOW, BATCH), 32, np.uint8)
        for b, k in enumerate(which):
            data = by[labels[k]][rng.integers(len(by[labels[k]]))]
            at = rng.integers(max(1, len(data) - WINDOW + 1))
            part = data[at : at + WINDOW]
            steps[: len(part), b] = part
        _, slopes = gradient(model, steps, which)
        rate = RATE * (1 - 0.9 * step / most)
        norm = np.sqrt(sum(float((g**2).sum()) for g in slopes))
        for x, g, m, v in zip(model.parts(), slopes, first, second, strict=True):
            g *= min(1, 1 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def document_probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities (documents x languages) over all bytes of each text; zeros for an empty one."""
    sizes = np.array([len(t) for t in texts], np.int64)
    totals = np.zeros((len(texts), len(model.labels)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    begin = np.repeat(np.cumsum(sizes) - sizes, counts) + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    end = np.minimum(begin + WINDOW, np.repeat(np.cumsum(sizes), counts))
    for k in range(0, len(owner), SIDE):
        a, b = begin[k : k + SIDE], end[k : k + SIDE]
        places = a + np.arange(WINDOW)[:, None]
        valid = places < b
        steps = np.where(valid, data[np.minimum(places, len(data) - 1)], np.uint8(32))
        p = position_probabilities(model, steps)
        p *= valid[:, None, :]
        sums = p.sum(axis=0)
        for j in range(len(model.labels)):
            totals[:, j] += np.bincount(owner[k : k + SIDE], weights=sums[j], minlength=len(texts))
    return totals / np.maximum(sizes, 1)[:, None]


def identify_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id_col, lang_pred, score for every row of `df` (and the columns in `keep`); no shuffle.

    A null text, or one without a letter, has `und` and score 0. If nothing could be learned, all
    have. Ties go to the language that sorts first. Whole texts are read, however long; repeated rows, null ids
    and other columns are fine; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # some 60 KB

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from oxbow.llm.packing import portions

        release()
        model = shared.value
        for batch in batches:
            found, scores = [], []
            for part in portions(batch.column("read_text")):
                with_letters = [bool(LETTER(t)) for t in part]
                if model.labels:
                    p = document_probabilities(model, [t.encode("utf-8", "replace") for t in part])
                    best = p.argmax(axis=1)
                for i, letters in enumerate(with_letters):
                    found.append(model.labels[best[i]] if letters and model.labels else UNDETERMINED)
                    scores.append(min(1.0, float(p[i, best[i]])) if letters and model.labels else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    names = list(dict.fromkeys([id_col, *(keep or [])]))
    source = df.select(F.col(text_col).alias("read_text"), *names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]) + ", lang_pred string, score double"
    return source.mapInArrow(run, schema)


def train_on(documents: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL) -> Model:
    """Fit on about `per_label` documents of each language, however many there are, none of them held out (crc32(id) mod 4 = 2)."""
    learn = documents.select(id_col, label_col).where(remainder(id_col, 4) != 2)
    model = train(labelled_texts(documents.where(remainder(id_col, 4) != 2), learn, id_col, text_col, label_col, per_label))
    give_back()  # the driver would keep what the examples took
    return model
