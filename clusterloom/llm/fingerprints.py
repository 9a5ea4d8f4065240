"""Document fingerprints: one-permutation MinHash with optimal densification.

The hashes of a document's five-word shingles fall into ``BINS`` bins by their high
bits; each bin keeps the smallest of the rest (Li, Owen and Zhang, 2012). An empty
bin takes the value of the first non-empty bin in a random order of its own, the
same for all documents (Shrivastava, "Optimal densification for fast and accurate
minwise hashing", 2017). Of each bin's value the low ``BITS`` bits are stored, packed
(b-bit minwise hashing, Li and Koenig, 2010); the share m of equal stored values
gives the likeness (m - c) / (1 - c), c = 2**-BITS being the share that unrelated bins
have in common, held within 0 and 1.

Words are runs between ASCII white space, A-Z folded. A document of fewer than five
words has one shingle, its whole word sequence; a text without words, or null, has
one shingle too, the empty sequence, so that empty texts are alike.

``with_next`` also needs the following document by id: rows are dealt to ranges of
ids (bounds are quantiles of the ids alone), the first of each range goes to the
range before as well, and each task walks its sorted rows. One shuffle of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.texts import mix, shingle_hashes, slices, word_hashes, word_spans

BINS, BITS = 512, 4
SHINGLE = 5
_LOG = BINS.bit_length() - 1
#: Order key of rows without id, before all ids.
_NO_ID = -(1 << 63)


@lru_cache(maxsize=1)
def _orders() -> np.ndarray:
    """For each bin, a fixed random order of all bins."""
    return np.argsort(mix(np.arange(1, BINS * BINS + 1, dtype=np.uint64)).reshape(BINS, BINS), axis=1
                      ).astype(np.int16)


def signatures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``BINS`` stored values (0 to 2**BITS - 1) for each document."""
    starts, ends, before = word_spans(data, offsets)
    h, cuts = shingle_hashes(word_hashes(data, starts, ends), before, SHINGLE)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(cuts))
    cell = doc * BINS + (h >> np.uint64(64 - _LOG)).astype(np.int64)
    empty = np.uint64((1 << 64) - 1)
    best = np.full(n * BINS, empty)
    np.minimum.at(best, cell, h << np.uint64(_LOG))  # the value without the bin's bits
    rows, bins = np.divmod(np.flatnonzero(best == empty), BINS)
    filled, orders, at = best.copy(), _orders(), 0
    while len(rows):
        value = best[rows * BINS + orders[bins, at]]
        found = value != empty
        filled[rows[found] * BINS + bins[found]] = value[found]
        rows, bins, at = rows[~found], bins[~found], at + 1
    return (mix(filled) & np.uint64((1 << BITS) - 1)).astype(np.uint8).reshape(n, BINS)


def packed(values: np.ndarray) -> list[str]:
    """Stored values as lower-case hex, ``BITS`` bits each."""
    bits = np.unpackbits(values[:, :, None], axis=2, bitorder="big")[:, :, 8 - BITS:]
    return [row.tobytes().hex() for row in np.packbits(bits.reshape(len(values), -1), axis=1)]


def unpacked(hexes: list[str]) -> np.ndarray:
    rows = np.frombuffer(bytes.fromhex("".join(hexes)), np.uint8).reshape(len(hexes), -1)
    bits = np.unpackbits(rows, axis=1).reshape(len(hexes), BINS, BITS)
    return (bits << np.arange(BITS - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of the shingle sets, row by row, corrected for chance agreement."""
    chance = 0.5 ** BITS
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)


def text_signatures(texts: list[bytes]) -> np.ndarray:
    out = [signatures(data, offsets) for _, _, data, offsets in slices(pa.array(texts, pa.large_binary()), rows=1000)]
    return np.concatenate(out) if out else np.zeros((0, BINS), np.uint8)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint`` (hex) per row; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(packed(signatures(data, offsets)), pa.string())],
                    ["_id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, fingerprint string").withColumnRenamed("_id", id_col)


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


# ------------------------------------------------------------------ the next document

def _heads(keys: DataFrame, count: int) -> np.ndarray:
    """The smallest key of each of about ``count`` ranges of like size; reads the keys alone."""
    shares = [i / count for i in range(1, count)] or [0.5]
    cuts = keys.agg(F.percentile_approx("_key", shares, min(10 * count, 1_000_000))).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64)) if count > 1 else np.zeros(0, np.int64)

    @F.pandas_udf("long")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), "right"))

    found = keys.groupBy(place("_key").alias("_range")).agg(F.min("_key")).collect()  # a row for each range
    return np.sort(np.array([k for _, k in found], np.int64))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, with each range's successor last: each row with the one after it."""
    names = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held: list[tuple[object, str, bool]] = []  # id, text, whether a result is due; the last waits for its next

    def done(final: bool):
        nonlocal held
        texts = [t for _, t, _ in held]
        due = [k for k in range(len(held) - 1) if held[k][2]]
        own = text_signatures([t.encode("utf-8", "replace") for t in texts])
        changed = [edited(texts[k], texts[k + 1]).encode("utf-8", "replace") for k in due]
        new = text_signatures(changed)
        if due:
            old = own[due]
            yield pa.RecordBatch.from_arrays(
                [pa.array([held[k][0] for k in due], pa.int64()), pa.array([len(texts[k]) for k in due], pa.int64()),
                 pa.array([hashlib.sha256(c).hexdigest() for c in changed]), pa.array(packed(old)),
                 pa.array(packed(new)), pa.array(likeness(old, new)),
                 pa.array(likeness(old, own[[k + 1 for k in due]]))], names)
        held = [] if final else held[-1:]

    size, last, complete = 0, None, False
    for batch in batches:
        places, ids, texts = batch.column("_place").to_pylist(), batch.column("_id").to_pylist(), batch.column("_text")
        for k, place in enumerate(places):
            own, after = place >> 1, place & 1
            if own != last:
                last, complete = own, False
            if after:
                if complete:  # a repeated successor
                    continue
                complete = True
            text = texts[k].as_py() or ""
            held.append((ids[k], text, not after))
            size += len(text)
            if size > 1 << 20 or len(held) > 1000:
                yield from done(False)
                size = len(text)
    yield from done(True)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and its edited text, and the likeness to the edited and the next text.

    The next document is the one after it by id (ties by text; rows without id come
    first); after the last comes the first, so a lone document follows itself.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_key"))
    count = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = _heads(rows.select("_key"), count)
    parts = max(1, len(heads))

    @F.pandas_udf("array<long>")
    def places(key: pd.Series) -> pd.Series:
        """Twice the range; and for the head of a range twice the range before, and one."""
        keys = key.to_numpy()
        own = np.searchsorted(heads, keys, "right") - 1
        return pd.Series([[2 * r, 2 * ((r - 1) % parts) + 1] if head else [2 * r]
                          for r, head in zip(own.tolist(), (heads[own] == keys).tolist())])

    placed = rows.select("_id", "_text", "_key", F.explode(places("_key")).alias("_place"))
    walked = (placed.withColumn("_range", F.shiftright("_place", 1)).repartition(parts, "_range")
              .sortWithinPartitions("_place", "_key", "_text").select("_id", "_text", "_place")
              .mapInArrow(_walk, "_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double"))
    return walked.withColumnRenamed("_id", id_col)
