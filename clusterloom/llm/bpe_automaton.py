"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It accepts exactly the token sequences that the merge
list produces, and is built one merge after the other (Berglund, Martens and van
der Merwe, "Constructing a BPE tokenization DFA", 2024). It starts with one state
that loops on every base symbol. The gadget for a merge (u, v) -> uv: let q be the
state after u. If q has an arc v, then u v can't stand side by side any more, so
u leads to a new copy of q without v; and every state with an arc u gets an arc uv to
the state that v leads to.

Where u leads doesn't depend on where it starts, so a state is named by the tokens
that lead to it, and a copy need not be written out: it keeps its parent, the one arc
it lacks and its time. ``Automaton.arc`` answers whether a state has an arc from
these three tables by following the two rules above; answers are kept in a
transition table.

Encoding a pre-split word: every prefix of a word has exactly one token sequence
that is accepted. So one pass over the positions, along a trie of the tokens and
the transition table, finds the one token that ends at each position, and the path
is read back from the end. Decoding emits each arc's label.

Words are split as the GPT-2 style byte-level pre-tokenizer does; runs of white space
with the characters after them are split and encoded once and kept per worker.

Defined results: a null text is the empty text (no ids, empty decoded text); rows are
encoded each on their own; special tokens found in a text are single ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.texts import Kept

KEPT_ARCS = 2_000_000

# Fixed value: how the byte-level pre-tokenizer splits a text.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

# Fixed value: the characters with the Unicode property White_Space.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUN = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """``after[t]``: the state that token t leads to. State 0 is the first one, with all arcs."""

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]]):
        """``base``: the base symbols' ids; ``merges``: (u, v, uv) ids in order."""
        self.after = dict.fromkeys(base, 0)
        self.first: dict[int, int] = {}  # the left half of a merged token
        self.made = dict.fromkeys(base, 0)  # when a token's arcs appeared
        self.parent, self.lacks, self.since = [0], [-1], [0]
        self.kept: dict[int, bool] = {}
        for time, (u, v, uv) in enumerate(merges, 1):
            if uv in self.made or u not in self.after or v not in self.after:
                continue
            q = self.after[u]
            if not self.arc(q, v):
                continue
            self.after[uv] = self.after[v]
            self.first[uv], self.made[uv] = u, time
            self.parent.append(q)
            self.lacks.append(v)
            self.since.append(time)
            self.after[u] = len(self.parent) - 1
        self.kept.clear()

    def arc(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc ``token``."""
        key = state << 32 | token
        found = self.kept.get(key)
        if found is None:
            if len(self.kept) >= KEPT_ARCS:
                self.kept.clear()
            found = self.kept[key] = self._arc(state, token)
        return found

    def _arc(self, state: int, token: int) -> bool:
        made, since, lacks = self.made, self.since, self.lacks
        while state:
            # a merge at or after the state's own time gave it uv exactly if it had u;
            # the merge that made the state comes after the copy
            if made[token] >= since[state]:
                token = self.first[token]
            elif token == lacks[state]:
                return False
            else:
                state = self.parent[state]
        return True


class Encoder:
    """Byte-level BPE from the JSON of the tokenizers library, run by the automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte_of = spec["model"], byte_symbols()
        vocab: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels: dict[int, bytes] = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()
                                         if s not in self.special}
        self.labels |= {i: s.encode() for s, i in self.special.items()}
        base = [vocab[c] for c in byte_of if c in vocab]
        self.automaton = Automaton(base, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.trie = self._trie()
        self.words = Kept(lambda word: self.word(word.encode("utf-8", "replace")), 400_000)
        self.runs = Kept(self.run, 600_000)
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) \
            if self.special else None

    def _trie(self) -> dict:
        """Nested dicts by byte; the token that ends at a node is under -1."""
        root: dict = {}
        for token in self.automaton.after:
            node = root
            for b in self.labels[token]:
                node = node.setdefault(b, {})
            node[-1] = token
        return root

    def word(self, word: bytes) -> tuple[int, ...]:
        """The ids of one pre-split word: the token that ends at each position, then back from the end."""
        n, auto = len(word), self.automaton
        after, arc, trie = auto.after, auto.arc, self.trie
        state = [-1] * (n + 1)  # -1: not reached yet
        ends = [0] * (n + 1)
        state[0] = 0
        for at in range(n):
            here = state[at]
            node = trie
            for stop in range(at, n):
                node = node.get(word[stop])
                if node is None:
                    break
                token = node.get(-1)
                if token is not None and state[stop + 1] < 0 and arc(here, token):
                    ends[stop + 1] = token
                    state[stop + 1] = after[token]
        out = []
        while n:
            out.append(ends[n])
            n -= len(self.labels[ends[n]])
        return tuple(reversed(out))

    def run(self, run: str) -> tuple[int, ...]:
        """The ids of a run of white space and what follows up to the next white space."""
        return tuple(chain.from_iterable(map(self.words.__getitem__, SPLIT.findall(run))))

    def parts(self, text: str) -> list[tuple[int, ...]]:
        """The ids of a text, run by run."""
        if self.specials is None or not self.specials.search(text):
            return list(map(self.runs.__getitem__, _RUN.findall(text)))
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += map(self.runs.__getitem__, _RUN.findall(text[at:m.start()]))
            out.append((self.special[m.group()],))
            at = m.end()
        return out + list(map(self.runs.__getitem__, _RUN.findall(text[at:])))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids`` (array of int) per row; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                ids = [coder.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))],
                                                 ["_id", "ids"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text`` per row of ids (null: empty); no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [coder.decode(i.as_py() or ()) for i in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["_id", "text"])

    ids = rows.select(F.col(id_col).alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids"))
    kind = ids.schema["_id"].dataType.simpleString()
    return ids.mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoded and decoded again in one pass, as digests: ``id_col, n_tokens, ids_sha256, decoded_sha256``.

    ids_sha256 is over the decimal ids joined by commas.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        shown = Kept(lambda ids: ",".join(map(str, ids)).encode(), 400_000)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for value in batch.column(1):
                parts = coder.parts(value.as_py() or "")
                ids = list(chain.from_iterable(parts))
                counts.append(len(ids))
                encoded.append(hashlib.sha256(b",".join(map(shown.__getitem__, parts))).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()),
                 pa.array(decoded, pa.string())], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                           ).withColumnRenamed("_id", id_col)
