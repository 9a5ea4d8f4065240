"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of about ``FRAME_BYTES`` bytes, cut between
code points, with the cumulative numbers of units (code points) and bytes before each
frame. A position is found by a search in the cumulative counts; only the frames that a cut
goes through are decompressed, and their parts compressed again. Frames between the cuts go
into the output as they are, in the order that the form asks for, with the markers as frames
of their own. Digests and texts come from streaming the frames in order, one at a time.

Restoring needs the output and its form only: the markers are looked for in the streamed
output, the sections between them are cut out by bytes, and put back in the text's order.

``digest`` of a row decides its cuts and form: the hex sha256 of ``seed:id`` in four groups of
eight digits. Cuts: the first two modulo n + 1; plain if the third modulo 100 is at least
``rate``; spm if the fourth modulo 100 is below ``spm``, else psm. A text that is empty or has
a marker in it is plain.

Defined results: a null text is the empty text; a null id is hashed as the empty string; rows
that repeat an id have the same draws, each over its own text; empty tables give no rows; only
the id and text columns are read, so other columns can't clash. A task holds the frames of
the rows of one slice (about 1 MB of text, or one longer document) and one open frame.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.texts import slices

FRAME_BYTES = 1 << 17
LEVEL = 3

#: Markers before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")


@lru_cache(maxsize=1)
def _coders() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()


def _heads(data: bytes) -> np.ndarray:
    """Which bytes begin a code point."""
    return (np.frombuffer(data, np.uint8) & 0xC0) != 0x80


class Frames:
    """Independent frames with the units and bytes before each, and in all."""

    def __init__(self, data: Iterable[bytes] = (), units: Iterable[int] = (0,), sizes: Iterable[int] = (0,)):
        self.data, self.units, self.sizes = list(data), list(units), list(sizes)

    @classmethod
    def of(cls, text: bytes, frame_bytes: int = FRAME_BYTES) -> Frames:
        out, at = cls(), 0
        while at < len(text):
            end = min(len(text), at + max(4, frame_bytes))
            while end < len(text) and text[end] & 0xC0 == 0x80 and end - at > 1:
                end -= 1
            out.add_text(text[at:end])
            at = end
        return out

    def add_text(self, part: bytes) -> None:
        if part:
            self.add(_coders()[0].compress(part), int(np.count_nonzero(_heads(part))), len(part))

    def add(self, frame: bytes, units: int, size: int) -> None:
        self.data.append(frame)
        self.units.append(self.units[-1] + units)
        self.sizes.append(self.sizes[-1] + size)

    def text(self, k: int) -> bytes:
        """The bytes of frame ``k``."""
        return _coders()[1].decompress(self.data[k], max_output_size=self.sizes[k + 1] - self.sizes[k])

    def stream(self) -> Iterator[bytes]:
        return map(self.text, range(len(self.data)))

    def copy(self, source: Frames, start: int, end: int, by_bytes: bool = False) -> None:
        """Append the units (or bytes) ``start`` to ``end`` of ``source``; whole frames stay as they are."""
        before = source.sizes if by_bytes else source.units
        k = max(0, bisect_right(before, start) - 1)
        while start < end:
            low, high = before[k], before[k + 1]
            if start <= low and high <= end:
                self.add(source.data[k], source.units[k + 1] - source.units[k], source.sizes[k + 1] - source.sizes[k])
            elif high > start:
                part = source.text(k)
                cut = [max(start, low) - low, min(end, high) - low]
                if not by_bytes:
                    places = np.append(np.flatnonzero(_heads(part)), len(part))
                    cut = places[cut].tolist()
                self.add_text(part[cut[0]:cut[1]])
            start, k = max(start, min(high, end)), k + 1

    def find(self, mark: bytes, start: int = 0) -> int:
        """The byte where ``mark`` stands first at or after byte ``start``; -1 if nowhere."""
        k = max(0, bisect_right(self.sizes, start) - 1)
        carry, base = b"", start
        for k in range(k, len(self.data)):
            part = self.text(k)[max(0, start - self.sizes[k]):]
            window = carry + part
            at = window.find(mark)
            if at >= 0:
                return base + at
            carry = window[-(len(mark) - 1):] if len(mark) > 1 else b""
            base += len(window) - len(carry)
        return -1


def draws(row_id: object, seed: int = 1) -> tuple[int, int, int, int]:
    """The four numbers that decide a row's cuts and form."""
    text = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()
    return tuple(int(text[i:i + 8], 16) for i in (0, 8, 16, 24))


def form_and_cuts(row_id: object, n: int, marked: bool, rate: int, spm: int, seed: int) -> tuple[str, int, int]:
    h1, h2, h3, h4 = draws(row_id, seed)
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    if n == 0 or marked or h3 % 100 >= rate:
        return "plain", 0, 0
    return "spm" if h4 % 100 < spm else "psm", cuts[0], cuts[1]


def arrange(text: Frames, form: str, first: int, second: int, markers: tuple[str, str, str] = MARKERS) -> Frames:
    """The output: the text's frames with cuts after ``first`` and ``second`` units, in the order of ``form``."""
    if form == "plain":
        return text
    prefix, suffix, middle = zip([m.encode() for m in markers], (0, second, first), (first, text.units[-1], second))
    out = Frames()
    for mark, start, end in (prefix, suffix, middle) if form == "psm" else (suffix, prefix, middle):
        out.add_text(mark)
        out.copy(text, start, end)
    return out


def restore(output: Frames, form: str, markers: tuple[str, str, str] = MARKERS) -> Frames:
    """The text, from the output and its form alone."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in markers)
    order = (p, s, m) if form == "psm" else (s, p, m)
    starts, at = [], 0
    for k, mark in enumerate(order):
        at = output.find(mark, at)
        if at < 0 or k == 0 and at != 0:
            raise ValueError("the output lacks a marker of its form")
        starts.append(at)
        at += len(mark)
    ends = [*starts[1:], output.sizes[-1]]
    section = {mark: (start + len(mark), end) for mark, start, end in zip(order, starts, ends)}
    text = Frames()
    for mark in (p, m, s):
        text.copy(output, *section[mark], by_bytes=True)
    return text


def sha256(frames: Frames) -> str:
    digest = hashlib.sha256()
    for part in frames.stream():
        digest.update(part)
    return digest.hexdigest()


_STORED = "units array<long>, sizes array<long>, frames array<binary>"
_LONGS, _BLOBS = pa.list_(pa.int64()), pa.list_(pa.binary())


def fill_in_middle(docs: DataFrame, rate: int = 90, spm: int = 20, seed: int = 1,
                   markers: tuple[str, str, str] = MARKERS, frame_bytes: int = FRAME_BYTES, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``id_col, n, form, prefix_chars, middle_chars, units, sizes, frames`` per row; no shuffle.

    The last three are the output as frames, with cumulative units and bytes (from 0). prefix_chars and
    middle_chars are null in the plain form.
    """
    if len(set(markers)) != 3 or not all(markers):
        raise ValueError("three different markers are needed")
    marks = [m.encode() for m in markers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                ids = batch.column(0).slice(first, end - first)
                columns = [[] for _ in range(7)]
                for k, row_id in enumerate(ids.to_pylist()):
                    raw = data[offsets[k]:offsets[k + 1]].tobytes()
                    text = Frames.of(raw, frame_bytes)
                    form, a, b = form_and_cuts(row_id, text.units[-1], any(m in raw for m in marks), rate, spm, seed)
                    out = arrange(text, form, a, b, markers)
                    cuts = (None, None) if form == "plain" else (a, b - a)
                    for column, value in zip(columns, (text.units[-1], form, *cuts, out.units, out.sizes, out.data)):
                        column.append(value)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), _LONGS, _LONGS, _BLOBS)
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c, t) for c, t in zip(columns, kinds))],
                    ["_id", "n", "form", "prefix_chars", "middle_chars", "units", "sizes", "frames"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, {_STORED}"
                           ).withColumnRenamed("_id", id_col)


def _each(rows: DataFrame, make, fields: dict[str, pa.DataType], schema: str) -> DataFrame:
    """``rows`` without the frames, with ``fields`` that ``make(form, frames)`` gives for each row."""
    kept = [c for c in rows.columns if c not in ("units", "sizes", "frames")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.slice(at, 100)
                stored = zip(*(part.column(c).to_pylist() for c in ("form", "frames", "units", "sizes")))
                found = [make(form, Frames(*frames)) for form, *frames in stored]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept),
                     *(pa.array([f[i] for f in found], t) for i, t in enumerate(fields.values()))], [*kept, *fields])

    before = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
    return rows.mapInArrow(run, f"{before}, {schema}")


def digests(rows: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``output_sha256, restored_sha256`` in place of the frames; the restored text is rebuilt from output and form."""
    def make(form: str, output: Frames) -> tuple[str, str]:
        return sha256(output), sha256(restore(output, form, markers))

    kinds = {"output_sha256": pa.string(), "restored_sha256": pa.string()}
    return _each(rows, make, kinds, "output_sha256 string, restored_sha256 string")


def texts(rows: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``output, restored`` as strings in place of the frames."""
    def make(form: str, output: Frames) -> tuple[str, str]:
        return tuple(b"".join(x.stream()).decode("utf-8", "replace") for x in (output, restore(output, form, markers)))

    return _each(rows, make, {"output": pa.string(), "restored": pa.string()}, "output string, restored string")


def selected(rows: DataFrame, start: str, units: str) -> DataFrame:
    """``selection``: the units (columns ``start``, ``units``) of each stored text; only the frames it touches are opened."""
    kept = rows.withColumn("form", F.concat_ws(",", F.col(start).cast("string"), F.col(units).cast("string")))

    def make(where: str, text: Frames) -> tuple[str]:
        a, size = map(int, where.split(","))
        a = max(0, min(a, text.units[-1]))
        out = Frames()
        out.copy(text, a, min(a + max(0, size), text.units[-1]))
        return (b"".join(out.stream()).decode("utf-8", "replace"),)

    return _each(kept, make, {"selection": pa.string()}, "selection string").drop("form")


#: The same digests in DuckDB; the restored text is cut out of the output at its markers.
ORACLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
numbers AS (
  SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM drawn),
forms AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
outputs AS (
  SELECT *, CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a)
    END AS output
  FROM forms),
places AS (
  SELECT *, CASE WHEN form = 'plain' THEN 0 ELSE position('<P>' IN output) END AS p,
         position('<S>' IN output) AS s, position('<M>' IN output) AS m
  FROM outputs)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
         WHEN 'psm' THEN substring(output, p + 3, s - p - 3) || substring(output, m + 3) || substring(output, s + 3, m - s - 3)
         ELSE substring(output, p + 3, m - p - 3) || substring(output, m + 3) || substring(output, s + 3, p - s - 3)
         END) AS restored_sha256
FROM places
"""
