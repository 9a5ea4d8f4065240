"""Vector bin packing of tokenised documents into training sequences.

Every sequence has three limits at once: tokens, segments and loss-bearing tokens
(prompt tokens of instruction data carry no loss). The dot-product heuristic picks,
of the pieces that fit, the one whose demand has the largest dot product with what
is left of the three limits, all measured in shares of the limits. Where nothing
fits whole, a piece is cut to what is left.

Packing happens where the rows lie: a task streams its partition, packs chunks of
about ``CHUNK_TOKENS`` tokens, and carries its unfinished sequence and left-over
pieces to the next chunk. Nothing is shuffled or collected, memory follows the
chunk and the longest document, and a recomputed task gives the same pieces for
the same rows. Sequences that stay below the token limit (those that another limit
closed, and each task's last) are cut into powers of two, which need no padding.

Token ids: the library's own encoding of each distinct word (plain texts) or run between
ASCII white space, kept per worker. The vocabularies this is meant for split at white
space (their pre-tokenizer drops it), so a text's ids are those of its parts in turn.

Defined results: a null or empty text has the end id alone; rows that repeat an id
are packed each; an id of null stays null; empty tables give no pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.bpe_automaton import byte_symbols
from clusterloom.llm.texts import Kept

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 4096, 128, 4096
END_ID = 2
CHUNK_TOKENS = 1 << 20


# ------------------------------------------------------------------ token ids

# Fixed value: the pre-tokenizer's pattern of the lower-casing vocabulary.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Fixed value: the words it makes of plain texts, in lower case.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+")
#: Plain texts: ASCII and the letters of Latin-1, which normalisation leaves alone and which have one lower case.
_PLAIN = re.compile("[\0-\x7fÀ-ÖØ-öø-ÿ]*")
_RUNS = re.compile("[^\t-\r ]+")
#: ASCII marks after an ASCII letter or digit, at the end of a run.
_END_MARKS = re.compile("(?<=[A-Za-z0-9])[!-/:-@\\[-`{-~]+$")


class WordIds:
    """Ids, as little-endian 32-bit bytes, of texts for a vocabulary that splits at white space.

    ``words`` keeps the ids of the pre-tokenizer's words in plain texts, ``runs`` those of whole
    runs without ASCII white space, where other characters or a special token stand in them (then
    normalisation looks across words). Vocabularies with another pre-tokenizer use runs only.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_words = {"type": "Lowercase"} in steps and splits[0].get("pattern") == {"Regex": _PATTERN}
        special = [t["content"].lower() for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else re.compile("(?!)")
        self.shown = {b: c for c, b in byte_symbols().items()}
        self.words, self.runs = Kept(self._word, 120_000), Kept(self._run, 60_000)

    def _word(self, word: str) -> bytes:
        """A lower-case word: only the model has to see it, its bytes as the characters that stand for them."""
        symbols = word if word.isascii() and word.isprintable() else "".join(map(self.shown.get, word.encode()))
        return np.array([t.id for t in self.tokenizer.model.tokenize(symbols)], "<u4").tobytes()

    def _plain(self, text: str) -> bytes | None:
        """The ids of a plain text, None for others."""
        if self.by_words and _PLAIN.fullmatch(text):
            text = text.lower()
            if not self.special.search(text):
                return b"".join(map(self.words.__getitem__, _WORDS.findall(text)))
        return None

    def _run(self, run: str) -> bytes:
        found = self._plain(run)
        if found is None and self.by_words and (marks := _END_MARKS.search(run)) and not self.special.search(run.lower()):
            found = self.runs[run[:marks.start()]] + self._plain(marks.group())
        if found is None:
            found = np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
        return found

    def ids(self, text: str) -> bytes:
        found = self._plain(text)
        return b"".join(map(self.runs.__getitem__, _RUNS.findall(text))) if found is None else found


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def release(path: str) -> None:
    """Give back, at the end of a task, what the worker's next task can do without: older words, free buffers."""
    coder = word_ids(path)
    coder.words.older, coder.runs.older = {}, {}
    pa.default_memory_pool().release_unused()


def encode_texts(column: pa.Array, path: str, end_id: int | None) -> Iterator[np.ndarray]:
    """Ids of each text in turn, with ``end_id`` after them."""
    coder = word_ids(path)
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    for value in column.cast(pa.large_binary()):
        yield np.frombuffer(coder.ids((value.as_py() or b"").decode("utf-8", "replace")) + tail, "<u4")


# ------------------------------------------------------------------ packing

class Piece(NamedTuple):
    """Ids ``start`` to ``start + length`` of document ``doc``; the first ``prompt`` ids of it carry no loss."""

    doc: int
    start: int
    length: int
    prompt: int

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.prompt))

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return self._replace(length=length), self._replace(start=self.start + length, length=self.length - length)

    def longest(self, tokens: int, loss: int) -> int:
        """How many of its first ids fit."""
        free = max(0, self.prompt - self.start)
        return min(self.length, tokens, free + loss)


class Pool:
    """Pieces that wait for a place, with their demands in arrays."""

    def __init__(self, pieces: list[Piece]):
        room = max(16, 2 * len(pieces))
        self.pieces: list[Piece | None] = []
        self.tokens, self.loss = np.zeros(room), np.zeros(room)
        self.open = np.zeros(room, bool)
        self.left = 0
        for p in pieces:
            self.add(p)

    def add(self, piece: Piece) -> None:
        at = len(self.pieces)
        if at == len(self.tokens):
            self.tokens, self.loss = (np.concatenate([x, np.zeros(at)]) for x in (self.tokens, self.loss))
            self.open = np.concatenate([self.open, np.zeros(at, bool)])
        self.pieces.append(piece)
        self.tokens[at], self.loss[at], self.open[at] = piece.length, piece.loss, True
        self.left += 1

    def take(self, at: int) -> Piece:
        self.open[at] = False
        self.left -= 1
        piece, self.pieces[at] = self.pieces[at], None
        return piece

    def best(self, rest: tuple[int, int, int], limits: tuple[int, int, int]) -> tuple[int, bool]:
        """The piece with the largest dot product with the rest of the limits: (place, fits whole)."""
        n = len(self.pieces)
        t, loss, is_open = self.tokens[:n], self.loss[:n], self.open[:n]
        score = t * (rest[0] / limits[0] ** 2) + loss * (rest[2] / limits[2] ** 2)  # a segment counts alike for all
        whole = is_open & (t <= rest[0]) & (loss <= rest[2])
        fits = bool(whole.any())
        return int(np.argmax(np.where(whole if fits else is_open, score, -1.0))), fits


def pack(pieces: list[Piece], limits: tuple[int, int, int], last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences, and what is left over for the next call (nothing if this is the ``last``).

    A sequence below the token limit is closed only by another limit or at the
    end, and comes out in parts whose lengths are powers of two.
    """
    done, whole = [], []
    for p in pieces:  # the first full lengths of long documents without a prompt need no search
        while p.length >= limits[0] and p.start >= p.prompt and limits[2] >= limits[0]:
            head, p = p.cut(limits[0])
            done.append([head])
        if p.length:
            whole.append(p)
    pool = Pool(whole)
    while pool.left:
        rest, sequence = list(limits), []
        while pool.left and rest[0] and rest[1]:
            at, fits = pool.best(tuple(rest), limits)
            piece = pool.take(at)
            if not fits:
                size = piece.longest(rest[0], rest[2])
                if size == 0:
                    pool.add(piece)
                    break
                piece, other = piece.cut(size)
                pool.add(other)
            sequence.append(piece)
            rest = [rest[0] - piece.length, rest[1] - 1, rest[2] - piece.loss]
        if rest[0] == 0:
            done.append(sequence)
        elif not pool.left and not last:
            return done, sequence
        else:
            done += powers_of_two(sequence)
    return done, []


def powers_of_two(sequence: list[Piece]) -> list[list[Piece]]:
    """The pieces in order, in parts whose lengths are the powers of two that sum to the whole."""
    total, out, queue = sum(p.length for p in sequence), [], list(sequence)
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            part, room = [], 1 << bit
            while room:
                p = queue.pop(0)
                if p.length > room:
                    p, other = p.cut(room)
                    queue.insert(0, other)
                part.append(p)
                room -= p.length
            out.append(part)
    return out


_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
           ("sequence_id", pa.int64()), ("offset", pa.int64()), ("segment", pa.int32()), ("loss_tokens", pa.int64()),
           ("sequence_tokens", pa.int64())]


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int | None = END_ID, max_tokens: int = MAX_TOKENS,
                   max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, prompt_col: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, segment, loss_tokens,
    sequence_tokens. ``prompt_col``: how many first ids of the row carry no loss (null: none)."""
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits must be positive")
    limits = (max_tokens, max_segments, max_loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_id = TaskContext.get().partitionId() << 33
        ids: dict[int, np.ndarray] = {}  # ids of documents with pieces that wait
        keys: dict[int, object] = {}
        left: list[Piece] = []
        serial = waiting = 0

        def rows(last: bool):
            nonlocal left, next_id, waiting
            done, left = pack(left, limits, last)
            columns = [[] for _ in range(1 + len(_FIELDS))]
            for sequence in done:
                offset, total = 0, sum(p.length for p in sequence)
                for k, p in enumerate(sequence):
                    own = ids[p.doc]
                    crc = zlib.crc32(own[p.start:p.start + p.length].tobytes())
                    for column, value in zip(columns, (keys[p.doc], p.start, p.length, crc, len(own), next_id, offset,
                                                       k, p.loss, total)):
                        column.append(value)
                    offset += p.length
                next_id += 1
            kept = {p.doc for p in left}
            for doc in [d for d in ids if d not in kept]:
                del ids[doc], keys[doc]
            waiting = sum(p.length for p in left)
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], id_type), *(pa.array(c, t) for c, (_, t) in zip(columns[1:], _FIELDS))],
                    names=["_id", *(n for n, _ in _FIELDS)])

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            prompts = batch.column(2).to_pylist()
            names = batch.column(0).to_pylist()
            for row, own in enumerate(encode_texts(batch.column(1), tokenizer_path, end_id)):
                if len(own):
                    ids[serial], keys[serial] = own, names[row]
                    left.append(Piece(serial, 0, len(own), max(0, min(prompts[row] or 0, len(own)))))
                    serial, waiting = serial + 1, waiting + len(own)
                if waiting >= chunk_tokens:
                    yield from rows(False)
        if left:
            yield from rows(True)
        release(tokenizer_path)

    rows_in = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"),
                          (F.col(prompt_col).cast("int") if prompt_col else F.lit(0)).alias("_prompt"))
    kind = rows_in.schema["_id"].dataType.simpleString()
    return rows_in.mapInArrow(
        run, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, "
             "segment int, loss_tokens long, sequence_tokens long").withColumnRenamed("_id", id_col)
