"""Quality of whole texts by a convolutional network over their bytes, in numpy.

Filters of a few bytes' width slide over the text; each is a table of one weight for each byte value and place, so a
convolution is a sum of look-ups. Their rectified outputs are max-pooled over chunks of two hops of bytes that
overlap by one hop and together cover the whole text. The mean and the greatest of the chunks' pooled values
go through a logistic unit to one probability. All weights are learned by gradient descent on labelled rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteferry.llm.labelled import class_counts, held_out, labelled_sample

MAX_ROWS = 1_500  # labelled rows of each class
THRESHOLD = 0.7

WIDTH, FILTERS, HOP = 6, 16, 256
EPOCHS, BATCH_ROWS, RATE = 12, 32, 0.02
# Bytes convolved at a time; a longer text is a batch of its own, worked through in slices.
_SLICE_BYTES = 1 << 18


@dataclass
class Network:
    tables: np.ndarray  # place, byte value, filter
    offsets: np.ndarray
    weights: np.ndarray  # of the mean and then of the greatest pooled values
    bias: float
    base_rate: float | None = None  # set where there is nothing to learn from


def _laid_out(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each with `width` zeros and filled to whole hops, and the first hop of each."""
    hops = np.array([-(-(len(t) + width) // HOP) for t in texts], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(hops)))
    data = np.zeros(int(first[-1]) * HOP + width, dtype=np.uint8)
    for t, at in zip(texts, first[:-1].tolist()):
        data[at * HOP : at * HOP + len(t)] = np.frombuffer(t, dtype=np.uint8)
    return data, first


def _hop_maxima(net: Network, data: np.ndarray, first: np.ndarray, places: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The greatest rectified output of each filter in each hop, and where it is."""
    width, filters = net.tables.shape[0], net.tables.shape[2]
    hops = int(first[-1])
    final = np.zeros(hops, dtype=bool)
    final[first[1:] - 1] = True
    best = np.empty((hops, filters), dtype=np.float32)
    at = np.empty((hops, filters), dtype=np.int64) if places else None
    step = max(1, _SLICE_BYTES // HOP)
    for h in range(0, hops, step):
        n = min(step, hops - h)
        low = h * HOP
        out = net.tables[0][data[low : low + n * HOP]]
        for k in range(1, width):
            out += net.tables[k][data[low + k : low + k + n * HOP]]
        shaped = out.reshape(n, HOP, filters)
        shaped[final[h : h + n], HOP - width + 1 :] = -np.inf  # these lie in the zeros and reach into the next text
        if places:
            where = shaped.argmax(axis=1)
            at[h : h + n] = where + (low + HOP * np.arange(n))[:, None]
            best[h : h + n] = np.take_along_axis(shaped, where[:, None, :], axis=1)[:, 0]
        else:
            best[h : h + n] = shaped.max(axis=1)
    return np.maximum(best + net.offsets, 0), at


def _chunked(maxima: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks are neighbouring hops of one text: for each hop the hop that its chunk ends with, and the pooled values."""
    nxt = np.minimum(np.arange(len(maxima)) + 1, np.repeat(first[1:] - 1, np.diff(first)))
    return nxt, np.maximum(maxima, maxima[nxt])


def _features(pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
    counts = np.diff(first)[:, None]
    mean = np.add.reduceat(pooled, first[:-1], axis=0) / counts
    return np.concatenate([mean, np.maximum.reduceat(pooled, first[:-1], axis=0)], axis=1)


def predict(net: Network, texts: list[bytes]) -> np.ndarray:
    """The probability of label 1 of each text."""
    if net.base_rate is not None:
        return np.full(len(texts), net.base_rate)
    if not texts:
        return np.zeros(0)
    data, first = _laid_out(texts, net.tables.shape[0])
    maxima, _ = _hop_maxima(net, data, first, places=False)
    features = _features(_chunked(maxima, first)[1], first)
    return 1 / (1 + np.exp(-np.clip(features.astype(np.float64) @ net.weights + net.bias, -30, 30)))


def train(rows: list[tuple[str, int]], counts: tuple[int, int] | None = None, seed: int = 7) -> Network:
    """A network from (text, label) rows, by Adam on the logistic loss; without both classes, the base rate for all.

    `counts` are the true numbers of rows of label 0 and 1: where a class was sampled, its rows weigh more.
    """
    labels = np.array([label for _, label in rows], dtype=np.float64)
    if not 0 < labels.sum() < len(labels):
        return Network(*[np.zeros(0)] * 3, 0.0, base_rate=float(labels.mean()) if len(labels) else 0.5)
    sampled = np.array([(labels == 0).sum(), (labels == 1).sum()])
    shares = np.array(counts or sampled, dtype=np.float64) / sampled
    weigh = (shares * len(labels) / (shares @ sampled))[labels.astype(int)]
    texts = [text.encode() for text, _ in rows]
    random = np.random.default_rng(seed)
    net = Network(
        random.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, dtype=np.float32),
        random.normal(0, 0.1, 2 * FILTERS),
        0.0,
    )
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    steps = 0

    def move(name: str, value: np.ndarray, slope: np.ndarray) -> np.ndarray:
        m, v = moments.get(name, (np.zeros_like(slope), np.zeros_like(slope)))
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        moments[name] = m, v
        change = RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)
        return (value - change).astype(value.dtype)

    for _ in range(max(EPOCHS, 400 * BATCH_ROWS // len(rows))):
        order = random.permutation(len(rows))
        for low in range(0, len(order), BATCH_ROWS):
            steps += 1
            batch = order[low : low + BATCH_ROWS]
            data, first = _laid_out([texts[i] for i in batch], WIDTH)
            maxima, at = _hop_maxima(net, data, first, places=True)
            nxt, pooled = _chunked(maxima, first)
            features = _features(pooled, first)
            score = 1 / (1 + np.exp(-np.clip(features @ net.weights + net.bias, -30, 30)))
            wrong = (score - labels[batch]) * weigh[batch] / len(batch)
            chunks = np.diff(first)
            of_text = np.repeat(np.arange(len(batch)), chunks)
            # Back to the pooled values: an equal share of the mean, and the whole at the greatest chunk.
            back = (wrong / chunks)[of_text][:, None] * net.weights[:FILTERS]
            greatest = pooled >= features[of_text, FILTERS:]
            ties = np.add.reduceat(greatest.astype(np.float64), first[:-1], axis=0)
            back = back + greatest * (wrong[of_text][:, None] * net.weights[FILTERS:]) / ties[of_text]
            # Each pooled value is that of one of its two hops, and of one place there.
            hop = np.where(maxima >= maxima[nxt], np.arange(len(maxima))[:, None], nxt[:, None])
            columns = np.broadcast_to(np.arange(FILTERS), hop.shape)
            live = back * (pooled > 0)
            place = at[hop, columns]
            slope = np.zeros(net.tables.shape)
            for k in range(WIDTH):
                np.add.at(slope[k], (data[place + k], columns), live)
            weights = move("w", net.weights, features.T @ wrong + 1e-4 * net.weights)
            bias = move("b", np.array([net.bias]), np.array([wrong.sum()]))
            net.tables = move("t", net.tables, slope)
            net.offsets = move("o", net.offsets, live.sum(axis=0))
            net.weights, net.bias = weights, float(bias[0])
    return net


def score_quality(
    documents: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 from `threshold` on).

    Every byte of every text is convolved. A null or empty text scores as padding alone. Repeated rows score alike; null
    identifiers are not held out. An empty table gives no rows. Other columns are not read.
    """
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(source.dtypes)["doc_id"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            scores, held, size = [], [], 0
            for i in range(len(column)):
                held.append((column[i].as_py() or "").encode())
                size += len(held[-1])
                if size >= 4 * _SLICE_BYTES or i + 1 == len(column):
                    scores.append(predict(net, held))
                    held, size = [], 0
            values = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values, type=pa.float64())], names=["doc_id", "score"]
            )

    scored = source.mapInArrow(score, f"doc_id {kind}, score double")
    predicted = (F.col("score") >= threshold).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def quality_network(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Network:
    """The network from at most `max_rows` labelled rows of each class that are not held out."""
    return train(labelled_sample(documents, labels, "quality", max_rows), class_counts(labels, "quality"))


register_pickle_by_value(sys.modules[__name__])
