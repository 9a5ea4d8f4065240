"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint: 64 bits; a bit is set if more than half of the XXH64 (seed 42) hashes
of a document's word shingles have it set.

Candidate search for pairs at ``MAX_BITS`` = 3 or fewer differing bits. The 64 bits
are three segments of 22, 21 and 21 bits. Of three errors dealt to three segments,
two segments hold at most one each (pigeonhole), so it suffices to find, for each
of the three pairs of segments, fingerprints that differ by at most one bit in both.
A segment (zero-extended to 23 bits) decodes in the perfect binary Golay code
(23, 12, 7) to one 12-bit codeword index. The words within one bit of a segment
decode to at most six different indices. If two segments differ by at most one bit,
then the index of the one is among those of the other. Hence each fingerprint is
stored under one 24-bit key for each pair of segments and looked up under at most
36; the join is exact, and its condition verifies the bit distance.

Equal fingerprints are one class before the search, so that a group of copies of
any size is one row. Links between different fingerprints meet in connected
components; a hot key's rows are one side of an ordinary join, which Spark splits.

Defined results: a null text is the empty text, whose fingerprint is zero; a row
without id takes the component of its fingerprint's class (null if no row of the
class has an id); rows with the same id are one vertex for each fingerprint. ``keep_one``
tells rows apart by their place and so keeps one row of every component, whatever the ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.graph import connected_components
from clusterloom.session import cut_lineage, number_rows

MAX_BITS = 3
SEED = 42

#: Bits of the three segments, from the highest bit down.
SEGMENTS = (22, 21, 21)
PAIRS = ((0, 1), (0, 2), (1, 2))

#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# ------------------------------------------------------------------ fingerprints

def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, highest bit first."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    whole = len(bits) // 255 * 255
    total = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:  # sums of 255 bits fit a byte
        total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes, size: int = 3, block: int = 1 << 16) -> int:
    """The unsigned fingerprint of one UTF-8 text; its shingles are hashed ``block`` at a time."""
    words = text.translate(_FOLD).split()
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[j:] for j in range(size))))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    total, n = np.zeros(64, np.int64), len(words) - size + 1
    for at in range(0, n, block):
        total += _ones(np.fromiter(hashes, np.uint64, min(block, n - at)))
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text",
                 place_col: str | None = None) -> DataFrame:
    """``_id, _fp`` (the fingerprint as a signed long) per row, and ``_place`` if a column for it is named; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fp = np.fromiter((fingerprint(t.as_py() or b"", size) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]],
                                             ["_id", "_fp", "_place"][:batch.num_columns])
        pa.default_memory_pool().release_unused()  # the worker may be kept for other stages

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"),
                       *([F.col(place_col).cast("long").alias("_place")] if place_col else []))
    return rows.mapInArrow(run, "_id long, _fp long" + (", _place long" if place_col else ""))


# ------------------------------------------------------------------ Golay keys

@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each high part (x >> 11), and the error pattern of each remainder."""
    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    high = np.array([remainder(h << 11) for h in range(1 << 12)], np.int32)
    errors = np.zeros(1 << 11, np.int32)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            errors[high[e >> 11] ^ (e & 0x7FF)] = e
    return high, errors


def codeword_index(x: np.ndarray) -> np.ndarray:
    """The 12-bit index of the one codeword within three bits of each 23-bit word."""
    high, errors = _tables()
    return (x ^ errors[high[x >> 11] ^ (x & 0x7FF)]) >> 11


def near_indices(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices of the words within one bit of each ``bits``-bit word: (flat, how many of each)."""
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.int32)
    found = np.sort(codeword_index(x[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return found[new], new.sum(axis=1)


def segments(fp: np.ndarray) -> list[np.ndarray]:
    out, low = [], 64
    for bits in SEGMENTS:
        low -= bits
        out.append((fp >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int32))
    return out


def stored_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): one key for each pair of segments."""
    index = [codeword_index(s) for s in segments(fp)]
    keys = [(p << 24) | (index[a] << 12) | index[b] for p, (a, b) in enumerate(PAIRS)]
    return np.tile(np.arange(len(fp)), len(PAIRS)), np.concatenate(keys).astype(np.int32)


def probe_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): at most 36 keys for each pair of segments."""
    near = [near_indices(s, bits) for s, bits in zip(segments(fp), SEGMENTS)]
    rows, keys = [], []
    for p, (a, b) in enumerate(PAIRS):
        (fa, na), (fb, nb) = near[a], near[b]
        n = na * nb
        row = np.repeat(np.arange(len(fp)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        i = (np.cumsum(na) - na)[row] + within // nb[row]
        j = (np.cumsum(nb) - nb)[row] + within % nb[row]
        rows.append(row)
        keys.append((p << 24) | (fa[i] << 12) | fb[j])
    return np.concatenate(rows), np.concatenate(keys).astype(np.int32)


def _keyed(make, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                fp = batch.column(0).slice(at, 2000).to_numpy()
                row, key = make(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["_key", name])
    return run


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """All pairs ``_a < _b`` of the distinct fingerprints ``_fp`` at ``max_bits`` (3 at most) or fewer bits."""
    if max_bits > MAX_BITS:
        raise ValueError("the keys find pairs at three or fewer bits")
    fps = classes.select("_fp")
    stored = fps.mapInArrow(_keyed(stored_keys, "_a"), "_key int, _a long")
    probes = fps.mapInArrow(_keyed(probe_keys, "_b"), "_key int, _b long")
    near = (stored["_key"] == probes["_key"]) & (F.col("_a") < F.col("_b")) & (
        F.bit_count(F.col("_a").bitwiseXOR(F.col("_b"))) <= max_bits)
    # Spark sizes keys like the fingerprints they come from, up to 108 times too low: it must not broadcast them
    return stored.join(probes.hint("merge"), near).select("_a", "_b").distinct()


def components(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``_fp, _component, component_id`` of each distinct fingerprint.

    ``classes``: ``_fp`` and ``_rep``, the smallest id with it (null: none has one). The vertices are
    fingerprints: _component is the smallest one reachable, component_id the smallest id of its component.
    """
    near = cut_lineage(links(classes, max_bits))
    linked = near.select(F.col("_a").alias("_fp")).union(near.select("_b")).distinct()
    joined = connected_components(linked, near, "_fp", "_a", "_b")  # only fingerprints with links
    joined = cut_lineage(classes.join(joined, "_fp").select("_fp", "_rep", F.col("component").alias("_component")))
    least = joined.groupBy("_component").agg(F.min("_rep").alias("_least"))
    named = joined.join(least, "_component").select("_fp", "_component", "_least")
    return classes.join(named, "_fp", "left").select(
        "_fp", F.coalesce("_component", "_fp").alias("_component"), F.coalesce("_least", "_rep").alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = 3, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint`` (16 hex digits), ``component_id`` per row of ``docs``.

    component_id: the smallest id reachable through links at ``max_bits`` or fewer bits.
    """
    rows = cut_lineage(fingerprints(docs, size, id_col, text_col))
    classes = cut_lineage(rows.groupBy("_fp").agg(F.min("_id").alias("_rep")))
    return rows.join(components(classes, max_bits), "_fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = 3, max_bits: int = MAX_BITS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, all columns: the one with the smallest id, the first of several.

    Rows are told apart by their place, not by id: of rows that repeat an id, each stays or goes by its own
    text. Rows without id come after those with one.
    """
    # written once, so that a row's place is the same in every later job
    at = number_rows(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), "_place")
    rows = cut_lineage(fingerprints(at, size, f"row.`{id_col}`", f"row.`{text_col}`", "_place"))
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_place")
    classes = cut_lineage(rows.groupBy("_fp").agg(F.min("_id").alias("_rep"), F.min(order).alias("_order")))
    found = cut_lineage(components(classes.select("_fp", "_rep"), max_bits).select("_fp", "_component"))
    first = found.join(classes, "_fp").groupBy("_component").agg(F.min("_order").alias("_first"))
    kept = found.join(first, "_component").select("_fp", F.col("_first._place").alias("_kept"))
    gone = cut_lineage(rows.join(kept, "_fp").where(F.col("_place") != F.col("_kept")).select("_place"))
    return at.join(gone, "_place", "left_anti").select("row.*")
