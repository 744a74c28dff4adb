"""Toxicity: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Features of a text are the presence of its words, pairs of neighbours and pairs one word apart,
hashed to 2^18 slots.  FTRL-proximal keeps a rate per slot, and its L1 term leaves most weights at
zero, so what is broadcast for scoring is one short sparse vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import MULT, batch_rows, crc_fold, in_chunks, mix, own_columns, word_hashes

BITS = 18
SHIFT = np.uint64(64 - BITS)
#: ASCII letters in lower case, digits and all non-ASCII bytes make words; other bytes part them
WORD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def features(text: bytes | None) -> np.ndarray:
    """Sorted distinct slots of a text; empty for a null or wordless one."""
    h = word_hashes((text or b"").translate(WORD).split())
    pairs = mix(h[:-1] * MULT + h[1:]) if len(h) > 1 else h[:0]
    skips = mix((h[:-2] * MULT + np.uint64(1)) * MULT + h[2:]) if len(h) > 2 else h[:0]
    return np.unique((np.concatenate([h, pairs, skips]) >> SHIFT).astype(np.uint32))


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal state; the intercept is the last slot, free of L1."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1

    def __post_init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, label: int) -> None:
        at = np.append(slots.astype(np.int64), 1 << BITS)
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-min(max(x, -40.0), 40.0))))


def train(documents: DataFrame, labels: DataFrame, max_docs: int = 30_000, epochs: int = 2,
          l1: float = 4.0, alpha: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) of the fitted model, the intercept last, from labelled documents whose fold
    is not 0; about ``max_docs`` of them, those with the least hash of doc_id (a documented bound:
    one task learns from them in hash order, whole texts of each)."""
    marks = own_columns(labels, "doc_id", "toxic").where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(
        crc_fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = marks.count()
    if not total:
        return np.array([1 << BITS]), np.zeros(1)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    marks = marks.withColumn("draw", draw).where(F.col("draw") < int((1 << 30) * min(1.0, max_docs / total)))
    rows = own_columns(documents, "doc_id", "text").select(
        "doc_id", F.col("text").cast("binary").alias("text")).join(marks, "doc_id")

    def hashed(batches):
        def work(batch):
            own = list(batch_rows(batch, "draw", "toxic", "text"))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in own], pa.int64()), pa.array([int(r[1] > 0) for r in own], pa.int32()),
                 pa.array([features(r[2]).astype("<u4").tobytes() for r in own], pa.binary())], ["draw", "toxic", "slots"])
        return in_chunks(batches, work)

    def fit(batches):
        seen = [(d, t, np.frombuffer(s, "<u4")) for b in batches for d, t, s in batch_rows(b, "draw", "toxic", "slots")]
        seen.sort(key=lambda r: (r[0], r[1], len(r[2])))
        model = Ftrl(l1=l1, alpha=alpha)
        for _ in range(epochs):
            for _, toxic, slots in seen:
                model.learn(slots, toxic)
        w = model.weights(np.arange((1 << BITS) + 1))
        at = np.append(np.flatnonzero(w[:-1]), 1 << BITS)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["slot", "weight"])

    fitted = (rows.mapInArrow(hashed, "draw long, toxic int, slots binary").repartition(1)
              .mapInArrow(fit, "slot long, weight double").toPandas())
    if not len(fitted):  # labels of documents that are not there
        return np.array([1 << BITS]), np.zeros(1)
    return fitted["slot"].to_numpy(), fitted["weight"].to_numpy()


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row of (doc_id, text): doc_id, held_out, score, predicted.

    A null or wordless text gets the score of the intercept alone; a model without labels scores
    0.5 everywhere.  A null doc_id is not held out.  Repeated rows are each scored; other columns
    are ignored.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)  # at most 2^18 pairs

    def work(batch):
        if not dense:
            w = np.zeros((1 << BITS) + 1)
            w[held.value[0]] = held.value[1]
            dense.append(w)
        w = dense[0]
        out = [sigmoid(w[features(text)].sum() + w[-1]) for (text,) in batch_rows(batch, "text")]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32())],
            ["doc_id", "held_out", "score", "predicted"])

    dense: list[np.ndarray] = []
    docs = own_columns(documents, "doc_id", "text").select(
        "doc_id", F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        F.col("text").cast("binary").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(lambda batches: in_chunks(batches, work),
                           f"doc_id {kind}, held_out boolean, score double, predicted int")
