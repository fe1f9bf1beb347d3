"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what recurs in toxic text and hardly ever in
ordinary text. Each window of a text, which is one word with its borders, is compressed with either. A window that the
toxic dictionary shortens to a reference and the ordinary one has to spell out speaks for toxicity; how strongly is
calibrated by counting, for each pair of lengths, the toxic and ordinary documents that have such a window. The
calibration uses other labelled rows than the dictionaries do, so a rare word that merely happened to be in a toxic
document earns nothing. The strongest windows of a text make its score.
"""

from __future__ import annotations

import heapq
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteferry.functions.batches import giving_back
from siteferry.llm.labelled import class_counts, held_out, labelled_sample

MAX_ROWS = 3_000  # labelled rows of each class
THRESHOLD = 0.3

ORDINARY_BYTES, TOXIC_BYTES = 65_536, 16_384
LEVEL = 12
SAMPLE_BYTES = 512
# A word of the toxic dictionary: in so many toxic documents, and so many times as often as in ordinary ones.
MIN_DOCUMENTS, MIN_RATIO = 3, 20
STRONGEST = 2
CACHE_WORDS = 150_000

_WORD = re.compile(r"[^\W\d_]+")
# The compressor looks for no match that starts in the last 8 bytes of its input, so a window is followed by bytes
# that either dictionary holds.
_TAIL = bytes(range(200, 232))
_LENGTHS, _WIDEST = 64, 24


def windows(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary for the samples; their plain end where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(samples)[-size:]


@dataclass
class Model:
    """Dictionaries, calibration and the final logistic curve."""

    ordinary: bytes = b""
    toxic: bytes = b""
    evidence: dict[int, float] = field(default_factory=dict)  # cell of two lengths to log-odds
    unseen: float = 0.0
    curve: tuple[float, float] = (1.0, 0.0)
    base_rate: float | None = None  # set where there is nothing to learn from

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        import zstandard

        self.model = model
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.compress = [
            zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(content + _TAIL, dict_type=raw),
                write_content_size=False,
                write_dict_id=False,
                write_checksum=False,
            ).compress
            for content in (model.ordinary, model.toxic)
        ]
        self.known: dict[str, float] = {}

    def cell(self, window: str) -> int:
        data = f" {window} ".encode()
        ordinary, toxic = (min(len(c(data + _TAIL)), _LENGTHS - 1) for c in self.compress)
        return (min(len(data) - 2, _WIDEST) * _LENGTHS + ordinary) * _LENGTHS + toxic

    def weight(self, window: str) -> float:
        found = self.known.get(window)
        if found is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            found = self.known[window] = self.model.evidence.get(self.cell(window), self.model.unseen)
        return found

    def strength(self, text: str) -> float:
        best = heapq.nlargest(STRONGEST, map(self.weight, windows(text)))
        return sum(best) + (STRONGEST - len(best)) * self.model.unseen

    def __call__(self, text: str) -> float:
        if self.model.base_rate is not None:
            return self.model.base_rate
        slope, shift = self.model.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, slope * self.strength(text) + shift))))


def train(rows: list[tuple[str, int]], counts: tuple[int, int] | None = None) -> Model:
    """A model from (text, label) rows; without rows of both classes, one that scores all texts by the base rate.

    `counts` are the true numbers of rows of label 0 and 1: where a class was sampled, its rows weigh more.
    """
    sides = [[text for text, label in rows if label == c] for c in (0, 1)]
    if min(map(len, sides)) < 4:
        return Model(base_rate=len(sides[1]) / len(rows) if rows else 0.0)
    fit, check = [[s[::2] for s in sides], [s[1::2] for s in sides]]
    held = [Counter(w for text in side for w in set(windows(text))) for side in fit]
    often = lambda w: held[1][w] / len(fit[1]) / ((held[0][w] + 0.5) / len(fit[0]))
    marked = {w for w, n in held[1].items() if n >= MIN_DOCUMENTS and often(w) >= MIN_RATIO}
    toxic = [" ".join(["", *(w for w in windows(text) if w in marked), ""]).encode() for text in fit[1]]
    plain = [" ".join(["", *windows(text), ""]).encode() for text in fit[0]]
    cut = [t[i : i + SAMPLE_BYTES] for t in plain for i in range(0, len(t), SAMPLE_BYTES)]
    stride = max(1, len(cut) * SAMPLE_BYTES // (200 * ORDINARY_BYTES))
    model = Model(_trained(cut[::stride], ORDINARY_BYTES), _trained([t for t in toxic if len(t) > 8], TOXIC_BYTES))
    scorer = Scorer(model)
    cells: dict[str, int] = {}
    seen = [Counter(), Counter()]
    for label, side in enumerate(check):
        for text in side:
            words = set(windows(text))
            for word in words - cells.keys():
                cells[word] = scorer.cell(word)
            seen[label].update({cells[w] for w in words})
    n = [len(side) for side in check]
    odds = lambda t, o: math.log((t + 0.05) / (n[1] + 0.1)) - math.log((o + 0.5) / (n[0] + 1))
    model.evidence = {c: odds(seen[1][c], seen[0][c]) for c in seen[0].keys() | seen[1].keys()}
    model.unseen = min(0.0, odds(0, 0))
    strengths = [(scorer.strength(text), label) for label, side in enumerate(check) for text in side]
    y = np.array([label for _, label in strengths])
    share = [count / len(side) for count, side in zip(counts or map(len, sides), sides)]
    model.curve = _curve(np.array([s for s, _ in strengths]), y, np.where(y == 1, share[1], share[0]))
    return model


def _curve(
    x: np.ndarray, y: np.ndarray, weigh: np.ndarray, ridge: float = 1.0, steps: int = 50
) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps on the weighted ridge likelihood of the scaled values."""
    weigh = weigh * len(weigh) / weigh.sum()
    middle, spread = x.mean(), x.std() or 1.0
    design = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    weights, penalty = np.zeros(2), np.diag([ridge, 1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (weigh * (y - p)) - penalty @ weights
        bend = (design * (weigh * p * (1 - p))[:, None]).T @ design + penalty
        weights = weights + np.linalg.solve(bend, slope)
    return float(weights[0] / spread), float(weights[1] - weights[0] * middle / spread)


def score_toxicity(
    documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 from `threshold` on).

    Every window of every text is looked at. A null or empty text has no windows and scores as the least toxic text can. Repeated
    rows score alike; null identifiers are not held out. An empty table gives no rows. Other columns are not read.
    """
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(source.dtypes)["doc_id"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            scores = [scorer(text.as_py() or "") for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, type=pa.float64())], names=["doc_id", "score"]
            )

    scored = source.mapInArrow(giving_back(score), f"doc_id {kind}, score double")
    predicted = (F.col("score") >= threshold).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def drop_toxic(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `documents` that score below the threshold, with all their columns, in one pass and no shuffle."""
    place = documents.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            kept = [scorer(text.as_py() or "") < threshold for text in batch.column(place)]
            yield batch.filter(pa.array(kept, type=pa.bool_()))

    return documents.mapInArrow(giving_back(keep), documents.schema)


def toxicity_model(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """The model from at most `max_rows` labelled rows of each class that are not held out."""
    return train(labelled_sample(documents, labels, "toxic", max_rows), class_counts(labels, "toxic"))


register_pickle_by_value(sys.modules[__name__])
