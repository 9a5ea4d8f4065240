"""Token counts of every prefix of a text, by dynamic programming over prefixes.

For byte-level BPE the last token of a prefix decides all others: the encoding of a prefix
that ends with token t is the encoding of the prefix before t, then t. A token can end
there only if it may stand after the last token of that shorter prefix, and exactly one
does (the tokenization automaton answers which). So one pass over a pre-split word gives
``count[i] = count[i - len(t)] + 1`` for all its prefixes, and a text's counts are those
of its words on top of the words before.

The counts are those of the prefix *as a text of its own*, which the splitting rule sees
differently in three places, all kept exact: white space at a prefix's end is one word
(the whole text leaves the last blank to the next word); ``'re``, ``'ve`` and ``'ll`` cut
after two characters are two words; a cut special token is ordinary text.

With the counts stored, questions about truncation and budgets need no encoding:
``tokens_in`` (tokens of the first n characters), ``longest_prefix`` (how much of a text
fits a budget) and ``truncate``. Counts aren't monotone: one more character may join
two tokens. ``longest_prefix`` takes that into account.

Defined results: a null text is the empty text (0 bytes, 0 tokens, ``counts`` [0]); rows
are counted each on their own, so repeated rows and ids (also null) give a row each; empty
tables give no rows; only the id and text columns are read, so other columns can't clash.
A long text costs its length, in time and memory (4 bytes a character); longer words than
``Kept`` stores are counted anew each time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.bpe_automaton import _RUN, _SPACE, SPLIT, encoder
from clusterloom.llm.texts import Kept

#: Rows and characters of one output batch, a single longer text excepted.
BATCH_ROWS, BATCH_CHARS = 500, 1 << 20

_LEAD = re.compile(f"[{_SPACE}]*")

# Fixed value: the contractions of the pre-tokenizer that are two words when their last letter is cut off.
_CUT_IN_TWO = frozenset(("'re", "'ve", "'ll"))


class PrefixCounter:
    """Counts for one vocabulary file; what it learns about words and runs is kept, up to a bound."""

    def __init__(self, path: str):
        coder = encoder(path)
        self.automaton, self.trie, self.specials = coder.automaton, coder.trie, coder.specials
        self.words = Kept(self._word, 300_000)
        self.runs = Kept(self._run, 400_000)

    def _word(self, word: str) -> tuple[int, ...]:
        """Tokens of each prefix (by characters) of a pre-split word."""
        data = word.encode("utf-8", "replace")
        n, after, arc, trie = len(data), self.automaton.after, self.automaton.arc, self.trie
        state, count = [-1] * (n + 1), [0] * (n + 1)  # -1: not reached yet
        state[0] = 0
        for at in range(n):
            here, node, one_more = state[at], trie, count[at] + 1
            for stop in range(at + 1, n + 1):
                node = node.get(data[stop - 1])
                if node is None:
                    break
                if state[stop] < 0:
                    token = node.get(-1)
                    if token is not None and arc(here, token):
                        state[stop], count[stop] = after[token], one_more
        if n == len(word):
            return tuple(count[1:])
        return tuple(count[i] for i in range(1, n + 1) if i == n or data[i] & 0xC0 != 0x80)

    def _run(self, run: str) -> bytes:
        """Tokens of each prefix of a run of white space and what follows, as little-endian 32-bit numbers."""
        lead = _LEAD.match(run).end()
        pieces = SPLIT.findall(run)
        if len(pieces) == 1 and lead <= 1 and run not in _CUT_IN_TWO:
            return np.array(self.words[run], "<u4").tobytes()
        out = list(self.words[run[:lead]]) if lead else []
        at = base = 0
        for piece in pieces:
            counts = self.words[piece]
            total = base + counts[-1]
            if piece in _CUT_IN_TWO:
                mark = self.words["'"][-1]
                counts = (mark, mark + self.words[piece[1]][-1], counts[-1])
            if at + len(piece) > lead:
                out += [base + c for c in counts[max(lead - at, 0):]]
            base, at = total, at + len(piece)
        return np.array(out, "<u4").tobytes()

    def _plain(self, text: str) -> np.ndarray:
        """Tokens of the prefixes with 1, 2, ... characters of a text without special tokens."""
        runs = _RUN.findall(text)
        local = np.frombuffer(b"".join(map(self.runs.__getitem__, runs)), "<u4")
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        ends = np.cumsum(sizes)
        totals = local[ends - 1] if len(runs) else local
        return local + np.repeat(np.cumsum(totals) - totals, sizes)

    def counts(self, text: str) -> np.ndarray:
        """Tokens of the prefixes with 0, 1, ..., len(text) characters."""
        found = list(self.specials.finditer(text)) if self.specials is not None else []
        if not found:
            return np.concatenate([[0], self._plain(text)]).astype(np.int32)
        out, at, base = [np.zeros(1, np.int64)], 0, 0
        for m in found:
            part = self.counts(text[at:m.end() - 1])  # all prefixes that end before the special token does
            out.append(base + part[1:])
            base += int(part[m.start() - at]) + 1
            out.append(np.array([base]))
            at = m.end()
        out.append(base + self._plain(text[at:]))
        return np.concatenate(out).astype(np.int32)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive rows with a bounded number of rows and characters, one row at least."""
    first = chars = 0
    for k, t in enumerate(texts):
        size = len(t or "")
        if k > first and (k - first >= BATCH_ROWS or chars + size > BATCH_CHARS):
            yield first, k
            first, chars = k, 0
        chars += size
    if first < len(texts):
        yield first, len(texts)


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, counts`` per row; no shuffle.

    counts[i] (array of int, from 0): the tokens of the first i characters (code points). n_tokens: its last.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).counts
        for batch in batches:
            for start in range(0, len(batch), BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                texts = part.column(1).to_pylist()
                for first, end in _batches(texts):
                    found = [count(t or "") for t in texts[first:end]]
                    offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(first, end - first),
                         pa.array([len((t or "").encode("utf-8", "replace")) for t in texts[first:end]], pa.int64()),
                         pa.array([int(f[-1]) for f in found], pa.int64()),
                         pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))],
                        ["_id", "n_bytes", "n_tokens", "counts"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, n_bytes long, n_tokens long, counts array<int>"
                           ).withColumnRenamed("_id", id_col)


# ------------------------------------------------------------------ questions, answered from the counts

def tokens_in(chars: Column | int, counts: str = "counts") -> Column:
    """Tokens of the first ``chars`` characters (of the whole text where it is shorter)."""
    chars = F.lit(chars) if isinstance(chars, int) else chars
    return F.get(counts, F.greatest(F.least(chars, F.size(counts) - 1), F.lit(0)))


def longest_prefix(budget: Column | int, counts: str = "counts") -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens; a negative budget fits nothing (null)."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    fits = F.transform(counts, lambda c: c <= budget)
    from_end = F.array_position(F.reverse(fits), F.lit(True))  # 0: none
    return F.when(from_end > 0, (F.size(counts) - from_end).cast("int"))


def truncate(docs: DataFrame, stored: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text"
             ) -> DataFrame:
    """The columns of ``docs`` with each text cut to its longest prefix within ``budget`` tokens.

    ``stored``: the rows of ``prefix_counts``, one for each id of ``docs``; a row without them keeps its text.
    """
    cut = stored.select(F.col(id_col).alias("_known"), longest_prefix(budget).alias("_chars"))
    rows = docs.join(cut, docs[id_col] == cut["_known"], "left")
    text = F.when(cut["_known"].isNull(), F.col(text_col)).otherwise(
        F.expr(f"left(`{text_col}`, coalesce(_chars, 0))"))
    return rows.withColumn(text_col, text).select(*docs.columns)
