"""Quality classifier of supervised subword embeddings.

Every word, word pair and byte n-gram of a text is hashed to a bucket that has a learned vector; a document is the mean
of its features' vectors, and a softmax layer gives the label's probability. Vectors and layer are trained by plain
stochastic gradient descent in numpy on a bounded sample of labelled rows. As the layer is linear, scoring needs only
one number a bucket: the difference of the two labels' logits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back, rows_of, ship_code
from .hashing import Spans, mix, words
from .sampling import Found, found, labelled_texts

#: Labelled rows that training uses at most, about.
MOST_ROWS = 2500
BITS, DIM, EPOCHS, RATE, SEED = 18, 10, 4, 0.5, 7
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """The bucket of every feature of a whole text, repeats included: words, pairs of neighbouring words (a pair of equal words is one bucket for all words), words' shapes and n-grams of 3 to 5 bytes."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    spans, shift = Spans(data), np.uint64(64 - bits)
    start, end = words(~_SPACE[data])
    out = []
    if len(start):
        whole = spans.hash(start, end, 1)
        pair = np.where(whole[1:] == whole[:-1], np.uint64(1), mix(whole[1:] * np.uint64(3) + whole[:-1]))
        kind = np.searchsorted(np.array([33, 48, 58, 65, 91, 97, 123, 128]), data, "right").astype(np.uint8)  # symbol, digit, upper, lower, beyond ASCII
        first, last = kind[start].astype(np.uint64), kind[end - 1].astype(np.uint64)
        shape = mix(first * np.uint64(64) + last * np.uint64(8) + np.minimum(end - start, 7).astype(np.uint64) + np.uint64(1 << 20))
        out += [whole, pair, shape]
    for n in (3, 4, 5):
        at = np.arange(max(0, len(data) - n + 1))
        out.append(spans.hash(at, at + n, n))
    return (np.concatenate(out) >> shift).astype(np.int64)


class Classifier:
    """Learned logit difference of each bucket, and of no feature at all."""

    def __init__(self, weight: np.ndarray, bias: float, bits: int):
        self.weight, self.bias, self.bits = weight, bias, bits

    def score(self, text: str | None) -> float:
        all_ = features(text, self.bits)
        z = self.bias + (float(self.weight[all_].sum(dtype=np.float64)) / len(all_) if len(all_) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def train(rows: list[tuple[str | Found, int]], bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Classifier:
    """Stochastic gradient descent over (text or its features, 0 or 1) pairs, one document a step, with a linearly falling rate.

    Empty texts move the bias alone; repeated rows are repeated steps. Without rows the classifier scores 0.5; with one label only it leans to that label."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random((1 << bits, dim)) - 0.5) / dim
    layer, bias = np.zeros((dim, 2)), np.zeros(2)
    docs = []  # eight bytes a distinct feature of a row
    for text, label in rows:
        ids, n = found(text, lambda t: features(t, bits))
        docs.append((ids.astype(np.int32), n.astype(np.int32), label))
    step, steps = 0, max(1, epochs * len(docs))
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, n, label = docs[k]
            share = (n / max(1, n.sum()))[:, None]
            now = rate * (1 - step / steps)
            step += 1
            hidden = (vectors[ids] * share).sum(axis=0)
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= now * np.outer(hidden, p)
            bias -= now * p * 0.1
            vectors[ids] -= (now * len(ids) ** 0.5) * share * back
    both = vectors @ layer
    del docs, vectors
    give_back()
    return Classifier((both[:, 1] - both[:, 0]).astype(np.float32), float(bias[1] - bias[0]), bits)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Train on the whole texts of a hash sample of about most_rows labelled rows outside fold 0.

    Null texts are as empty; rows with a null id or label teach nothing; repeated rows are repeated; other columns, also
    of clashing names, are not read; without rows the model scores 0.5."""
    return train(labelled_texts(docs, labels, label, most_rows, features, 5, id_col, text_col))


def score_texts(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), score_col: str = "score") -> DataFrame:
    """(id, score), and the columns named in keep, of every row, by model.score of the whole text.

    A column named in keep may not have the name score_col, which can be chosen; others are not read. Null and empty texts have the score of no feature; null ids stay null; repeated rows stay and score alike; no rows
    give no rows. A map over rows without a shuffle; the model's few megabytes go with the tasks."""
    spark = docs.sparkSession
    ship_code(spark)
    sent, names = spark.sparkContext.broadcast(model), [id_col, *keep]
    if score_col in names:
        raise ValueError(f"{score_col} is a column of the documents: choose another score_col")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            scores = [own.score(t) for part in rows_of(batch.select([0])) for t in part[0]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i + 1) for i in range(len(names))), pa.array(scores, pa.float64())], [*names, score_col])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.selectExpr(f"`{text_col}` as `_text {score_col}`", *[f"`{c}`" for c in names]).mapInArrow(run, f"{schema}, `{score_col}` double")
