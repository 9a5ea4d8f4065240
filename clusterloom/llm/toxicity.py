"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of its hashed words, neighbouring pairs and pairs with one
word between them (skip-grams). Words are runs of letters, digits, apostrophes
and non-ASCII characters, A-Z folded. Words hash into one half of the index
space, pairs into the other, so that the many rare pairs don't collide with words.

Training reads a bounded sample of labelled rows (``max_rows``, chosen by a hash
of the id) in one task: FTRL-proximal (McMahan et al., "Ad click prediction: a
view from the trenches", KDD 2013) keeps a learning rate per coordinate and an L1
threshold that leaves most weights at zero. The non-zero weights, at most
``max_rows`` times a document's features and at most ``DIM``, are collected (a few
thousand numbers), and every task scores whole texts from its own copy.

Defined results: a null text is the empty text; an empty text has the score of
the bias alone; without training rows of both classes every score is 0; rows with
the same id are scored each on their own text; a doc_id labelled more than once
counts as toxic if any of its labels does; labels that are null are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.texts import PUNCTUATION, mix, slices, word_hashes, word_spans

BITS = 22
DIM = 1 << BITS

#: Expected rows of the training sample.
MAX_ROWS = 16_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 1.0


class Model(NamedTuple):
    """``index``, ``weight``: the non-zero weights. ``bias`` is None without training rows."""

    index: np.ndarray
    weight: np.ndarray
    bias: float | None


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each document with repeats, as (document, index) pairs."""
    starts, ends, before = word_spans(data, offsets, PUNCTUATION)
    h = word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(before))
    half, shift = np.uint32(DIM >> 1), np.uint64(64 - BITS + 1)
    docs, found = [doc], [(h >> shift).astype(np.uint32)]
    for gap, salt in ((1, 0x632BE59BD9B4E019), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            inside = doc[:-gap] == doc[gap:]
            pair = mix(h[:-gap] * np.uint64(salt) + h[gap:])[inside]
            docs.append(doc[:-gap][inside])
            found.append((pair >> shift).astype(np.uint32) + half)
    return np.concatenate(docs), np.concatenate(found)


def _sample(labels: DataFrame, label: str, id_col: str, max_rows: int) -> DataFrame:
    """Labelled rows to learn from: id, label, order; about ``max_rows`` at most."""
    rows = (labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
            .where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
            .groupBy("_id").agg(F.max("_y").alias("_y")))
    n = rows.count()
    share = min(1.0, max_rows / max(n, 1))
    order = F.xxhash64("_id", F.lit("sample"))
    if share < 1:
        rows = rows.where(F.pmod(order, F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    return rows.withColumn("_order", order)


def held_out(id_col):
    """Rows whose label is never learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("_text")):
            doc, index = features(data, offsets)
            key = np.unique(doc.astype(np.int64) << BITS | index)
            cuts = np.searchsorted(key, np.arange(b - a + 1, dtype=np.int64) << BITS)
            values = pa.array((key & (DIM - 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_y").slice(a, b - a), batch.column("_order").slice(a, b - a),
                 pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)], ["_y", "_order", "_features"])


def ftrl(rows: list[tuple[int, np.ndarray]], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA,
         l1: float = L1, l2: float = L2, dim: int = DIM) -> Model:
    """Train on (label, distinct feature indices) rows, in the order given, ``epochs`` times."""
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)  # the last coordinate is the bias, without L1

    def weights(zi, ni, at_bias):
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        w[np.abs(zi) <= l1] = 0.0
        if at_bias:
            w[-1] = -zi[-1] / ((beta + np.sqrt(ni[-1])) / alpha)
        return w

    for _ in range(epochs):
        for y, index in rows:
            at = np.append(index, dim)
            zi, ni = z[at], n[at]
            w = weights(zi, ni, True)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    used = np.flatnonzero(np.abs(z[:dim]) > l1)
    return Model(used, weights(z[used], n[used], False),
                 float(-z[dim] / ((beta + np.sqrt(n[dim])) / alpha)))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of one partition, ordered: one row (index, weight); index -1 is the bias."""
    rows = []
    for batch in batches:
        for y, index in zip(batch.column("_y").to_pylist(), batch.column("_features")):
            rows.append((y, np.asarray(index.values)))
    if len({y for y, _ in rows}) == 2:
        m = ftrl(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(m.index, -1).astype(np.int32)), pa.array(np.append(m.weight, m.bias))],
            ["index", "weight"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text", max_rows: int = MAX_ROWS) -> Model:
    """Learn from the labelled rows of ``docs`` outside the held-out fifth.

    The sampled ids, ``max_rows`` of them, are broadcast; texts become feature
    sets before the one shuffle.
    """
    sample = _sample(labels, label, id_col, max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = (texts.join(F.broadcast(sample), "_id")
            .select("_y", "_order", "_text")
            .mapInArrow(_feature_rows, "_y int, _order long, _features array<int>"))
    weights = (rows.repartition(1).sortWithinPartitions("_order", "_y")
               .mapInArrow(_train, "index int, weight double"))
    got = weights.toArrow().sort_by("index")
    if len(got) == 0:
        return Model(np.zeros(0, np.int64), np.zeros(0), None)
    index, weight = got["index"].to_numpy(), got["weight"].to_numpy()
    return Model(index[1:].astype(np.int64), weight[1:], float(weight[0]))


def score_texts(column: pa.Array, model: Model, table: np.ndarray) -> np.ndarray:
    """Scores of whole texts. ``table``: the dense weights of ``model``."""
    out = np.zeros(len(column))
    if model.bias is None:
        return out
    for a, b, data, offsets in slices(column):
        doc, index = features(data, offsets)
        hit = np.flatnonzero(table[index])  # few: most weights are zero
        key = np.unique(doc[hit].astype(np.int64) << BITS | index[hit])
        total = np.bincount(key >> BITS, weights=table[key & (DIM - 1)], minlength=b - a)
        out[a:b] = 1.0 / (1.0 + np.exp(-np.clip(total + model.bias, -35, 35)))
    return out


def dense(model: Model) -> np.ndarray:
    table = np.zeros(DIM, np.float32)
    table[model.index] = model.weight
    return table


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` per row of ``docs``; no shuffle."""
    def run(batches):
        table = dense(model)
        for batch in batches:
            s = score_texts(batch.column("_text"), model, table)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_held"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                ["_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("_held"),
                       F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, held_out boolean, score double, predicted int").withColumnRenamed(
        "_id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below 0.5; no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches):
        table = dense(model)
        for batch in batches:
            yield batch.filter(pa.array(score_texts(batch.column(at), model, table) < 0.5))

    return docs.mapInArrow(run, docs.schema)
