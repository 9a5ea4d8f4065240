"""Personal data: fixed patterns, and a semi-Markov conditional random field beyond them.

Base spans are the matches of four patterns (email, ip, card, phone) that pass their
checks; they are found in linear time and always reported.

The semi-Markov CRF (Sarawagi and Cohen, 2004) scores whole segments. Its input are
regions: neighbouring white-space tokens that hold a digit or an ``@``, cut to units
from their first to their last letter or digit. A segment of up to ``LONGEST`` units
has features of the whole span (digits, groups, separators, checksum, octets, domain)
for each type, and types have transition weights; a unit outside any entity scores
zero. Dynamic programming over the units chooses boundaries and types together.

Training maximises the conditional likelihood on a bounded sample of regions
(``MAX_DOCUMENTS`` documents, ``MAX_REGIONS`` regions by a hash of their text), labelled
by the base spans that coincide with units; regions of more than ``MAX_UNITS`` units or
4,096 characters aren't learned from. Decoding leaves units under base spans as they are
and runs over the units between them, however many; it adds the segments it finds there.
A segment has at most ``LONGEST_CHARS`` characters.

Defined results: a null text is the empty text; a text without digits and ``@`` has no
spans; rows that repeat an id are scanned each; without regions to learn from nothing
is added. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int]

KINDS = ("email", "ip", "card", "phone")
_RANK = {k: i for i, k in enumerate(KINDS)}

LONGEST = 8
LONGEST_CHARS = 80
MAX_DOCUMENTS, MAX_REGIONS, MAX_UNITS = 20_000, 2_000, 32
EPOCHS, RATE, PENALTY = 25, 0.5, 1e-3

_ANY = re.compile("[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile("[^0-9]")
_INSIDE = re.compile(r"[+(]?[A-Za-z0-9](?:.*[A-Za-z0-9])?", re.DOTALL)


# ------------------------------------------------------------------ base spans

def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """The local part of each ``@`` reaches back over its characters, to the last match at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def _octet(number: str) -> bool:
    number = number.lstrip("0")
    return len(number) <= 3 and int(number or 0) <= 255


def addresses(text: str) -> Iterator[Span]:
    """Four numbers of a dotted chain at a time, each at most 255."""
    for chain in _NUMBERS.finditer(text):
        parts, at = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[k:k + 4])) + 3
            if all(map(_octet, parts[k:k + 4])):
                yield "ip", at, end
            at = end + 1


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = _NO_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                yield "phone", m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    if not _ANY.search(text):
        return []
    return [*emails(text), *addresses(text), *cards(text), *phones(text)]


# ------------------------------------------------------------------ regions and features

def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Units (start, end) of neighbouring tokens that hold a digit or ``@``; one space parts neighbours."""
    units, last, n = [], -2, len(text)
    sign = _ANY.search(text)
    while sign:
        start = end = sign.start()
        while start > max(last, 0) and not text[start - 1].isspace():
            start -= 1
        while end < n and not text[end].isspace():
            end += 1
        inside = _INSIDE.search(text, start, end)
        if units and not (start == last + 1 and text[last] == " "):
            yield units
            units = []
        if inside:
            units.append(inside.span())
        last = end
        sign = _ANY.search(text, end)
    if units:
        yield units


_NAMES = ["always", *(f"units{k}" for k in range(1, 6)), *(f"digits{k}" for k in range(9)), "at0", "at1", "at2",
          *(f"dots{k}" for k in range(6)), "plus", "letters0", "letters1", "letters2", "luhn", "no luhn", "octets",
          "wrong octets", "domain", "no domain", "space", "dash", "paren", "slash", "equals", "mark", "groups alike",
          "hex", "long", "before word", "before sign", "after word", "after sign"]
_AT = {name: k for k, name in enumerate(_NAMES)}
_DIGIT_STEPS = (1, 4, 7, 9, 13, 16, 17, 20)


def segment_features(text: str, start: int, end: int, units: int) -> list[int]:
    """Indices of the features of the whole span ``text[start:end]``."""
    s = text[start:end]
    digits = _NO_DIGIT.sub("", s)
    letters = sum(c.isalpha() for c in s)
    names = ["always", f"units{min(units, 5)}", f"digits{sum(len(digits) >= k for k in _DIGIT_STEPS)}",
             f"at{min(s.count('@'), 2)}", f"dots{min(s.count('.'), 5)}",
             "letters0" if not letters else "letters1" if letters * 2 < len(s) else "letters2"]
    if s[0] == "+":
        names.append("plus")
    if 13 <= len(digits) <= 19 and not letters:
        names.append("luhn" if luhn(digits) else "no luhn")
    parts = s.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        names.append("octets" if all(len(p) < 4 and int(p) < 256 for p in parts) else "wrong octets")
    if "@" in s:
        names.append("domain" if _DOMAIN.fullmatch(s, s.rfind("@") + 1) else "no domain")
    for sign, name in ((" ", "space"), ("-", "dash"), ("(", "paren"), ("/", "slash"), ("=", "equals")):
        if sign in s:
            names.append(name)
    if any(c in "_%:;,!?#$&*\"'" for c in s):
        names.append("mark")
    groups = re.split("[ -]", s)
    if len(groups) > 1 and len({len(g) for g in groups[:-1]}) == 1:
        names.append("groups alike")
    if letters and all(c in "0123456789abcdefABCDEF" for c in s):
        names.append("hex")
    if len(s) > 24:
        names.append("long")
    for place, side in ((start - 1, "before"), (end, "after")):
        if 0 <= place < len(text) and not text[place].isspace():
            names.append(f"{side} {'word' if text[place].isalnum() else 'sign'}")
    return [_AT[n] for n in names]


class Lattice(NamedTuple):
    """Candidate segments of ``n`` units: ``ends[j]`` lists (first unit, row of ``features``) of those that end before j."""

    n: int
    ends: list[list[tuple[int, int]]]
    features: np.ndarray


def lattice(text: str, units: list[tuple[int, int]]) -> Lattice:
    ends, rows = [[] for _ in range(len(units) + 1)], []
    for i in range(len(units)):
        for j in range(i + 1, min(i + LONGEST, len(units)) + 1):
            start, end = units[i][0], units[j - 1][1]
            if end - start > LONGEST_CHARS and j > i + 1:
                break
            row = np.zeros(len(_NAMES))
            if end - start <= LONGEST_CHARS:
                row[segment_features(text, start, end, j - i)] = 1.0
                ends[j].append((i, len(rows)))
                rows.append(row)
    return Lattice(len(units), ends, np.array(rows).reshape(-1, len(_NAMES)))


# ------------------------------------------------------------------ model

class Model(NamedTuple):
    """``weights``: features x types; ``moves``: from (types and outside) to (types and outside)."""

    weights: np.ndarray
    moves: np.ndarray


OUT = len(KINDS)


def _steps(at: Lattice, j: int, scores: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
    """(first unit, state, score, row) of what may end before unit j; outside units have row -1."""
    yield j - 1, OUT, 0.0, -1
    for i, row in at.ends[j]:
        for t in range(OUT):
            yield i, t, scores[row, t], row


def decode(at: Lattice, model: Model, before: int = OUT) -> list[tuple[int, int, int]]:
    """The best segmentation's entities (first unit, end unit, type). ``before``: the state to the left."""
    scores = at.features @ model.weights
    best = np.full((at.n + 1, OUT + 1), -np.inf)
    best[0, before] = 0.0
    back: dict[tuple[int, int], tuple[int, int]] = {}
    for j in range(1, at.n + 1):
        for i, state, score, _ in _steps(at, j, scores):
            via = best[i] + model.moves[:, state]
            k = int(via.argmax())
            if via[k] + score > best[j, state]:
                best[j, state] = via[k] + score
                back[j, state] = i, k
    found, j, state = [], at.n, int(best[at.n].argmax())
    while j:
        i, k = back[j, state]
        if state != OUT:
            found.append((i, j, state))
        j, state = i, k
    return found[::-1]


def decode_text(text: str, units: list[tuple[int, int]], model: Model, before: int = OUT) -> list[tuple[int, int, int]]:
    """``decode`` of a region of any length: segments are scored as they are met.

    Kept are the best scores before the last ``LONGEST`` units and two bytes a unit and state to walk back.
    """
    n, states = len(units), OUT + 1
    length, via = np.zeros((n + 1, states), np.int8), np.zeros((n + 1, states), np.int8)
    columns = np.arange(states)
    first = np.full(states, -np.inf)
    first[before] = 0.0
    enter: list = [None] * LONGEST  # by unit modulo LONGEST: the best way into each state from there
    best = first
    for j in range(1, n + 1):
        moved = best[:, None] + model.moves
        k = moved.argmax(axis=0)
        enter[(j - 1) % LONGEST] = moved[k, columns], k
        best = np.full(states, -np.inf)
        best[OUT], length[j, OUT], via[j, OUT] = moved[k[OUT], OUT], 1, k[OUT]
        end = units[j - 1][1]
        for i in range(max(0, j - LONGEST), j):
            start = units[i][0]
            if end - start > LONGEST_CHARS:
                continue
            value, k = enter[i % LONGEST]
            value = value[:OUT] + model.weights[segment_features(text, start, end, j - i)].sum(axis=0)
            better = np.flatnonzero(value > best[:OUT])
            best[better], length[j, better], via[j, better] = value[better], j - i, k[better]
    found, j, state = [], n, int(best.argmax())
    while j:
        i, k = j - int(length[j, state]), int(via[j, state])
        if state != OUT:
            found.append((i, j, state))
        j, state = i, k
    return found[::-1]


def _gradient(at: Lattice, gold: list[tuple[int, int, int]], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood of ``gold`` (entities by first unit, end unit, type)."""
    scores = at.features @ model.weights
    forward = np.full((at.n + 1, OUT + 1), -np.inf)
    backward = np.full((at.n + 1, OUT + 1), -np.inf)
    forward[0, OUT], backward[at.n] = 0.0, 0.0
    steps = [None, *(list(_steps(at, j, scores)) for j in range(1, at.n + 1))]
    for j in range(1, at.n + 1):
        for i, state, score, _ in steps[j]:
            forward[j, state] = np.logaddexp(forward[j, state],
                                             np.logaddexp.reduce(forward[i] + model.moves[:, state]) + score)
    total = np.logaddexp.reduce(forward[at.n])
    expected, moved = np.zeros_like(scores), np.zeros_like(model.moves)
    for j in range(at.n, 0, -1):
        for i, state, score, row in steps[j]:
            after = model.moves[:, state] + score + backward[j, state]
            share = np.exp(forward[i] + after - total)
            moved[:, state] += share
            if row >= 0:
                expected[row, state] += share.sum()
            backward[i] = np.logaddexp(backward[i], after)
    observed, seen = np.zeros_like(scores), np.zeros_like(model.moves)
    rows = {(i, j): row for j in range(1, at.n + 1) for i, row in at.ends[j]}
    state, j = OUT, 0
    for i, end, t in [*gold, (at.n, at.n, None)]:
        for _ in range(j, i):
            seen[state, OUT] += 1
            state = OUT
        if t is not None:
            observed[rows[i, end], t] += 1
            seen[state, t] += 1
            state, j = t, end
    return at.features.T @ (observed - expected), seen - moved


def fit(examples: list[tuple[str, list[tuple[int, int]], list[tuple[int, int, int]]]]) -> Model:
    """AdaGrad on the conditional likelihood of (text, units, entities), in the order given."""
    model = Model(np.zeros((len(_NAMES), OUT)), np.zeros((OUT + 1, OUT + 1)))
    squares = [np.full_like(m, 1e-6) for m in model]
    lattices = [(lattice(text, units), gold) for text, units, gold in examples]
    for _ in range(EPOCHS):
        for at in range(0, len(lattices), 64):
            total = [np.zeros_like(m) for m in model]
            for one, gold in lattices[at:at + 64]:
                for t, g in zip(total, _gradient(one, gold, model)):
                    t += g
            for m, t, s in zip(model, total, squares):
                t -= PENALTY * len(lattices) * m / max(1, len(lattices) // 64)
                s += t * t
                m += RATE * t / np.sqrt(s)
    return model


def labelled(text: str, units: list[tuple[int, int]], base: list[Span]) -> list[tuple[int, int, int]] | None:
    """Base spans as entities of a region; None where one doesn't coincide with units or is too long."""
    first, last = {u[0]: k for k, u in enumerate(units)}, {u[1]: k + 1 for k, u in enumerate(units)}
    gold, done = [], 0
    for kind, start, end in sorted(base, key=lambda s: (s[1], _RANK[s[0]])):
        if end <= units[0][0] or start >= units[-1][1]:
            continue
        i, j = first.get(start), last.get(end)
        if i is None or j is None or i < done or j - i > LONGEST or end - start > LONGEST_CHARS:
            return None
        gold.append((i, j, _RANK[kind]))
        done = j
    return gold


# ------------------------------------------------------------------ Spark

def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[int, tuple] = {}
        for value in batch.column(0):
            text = value.as_py() or ""
            base = base_spans(text)
            for units in regions(text):
                if len(units) > MAX_UNITS:
                    continue
                low = max(0, units[0][0] - 1)
                cut = text[low:units[-1][1] + 1]
                gold = labelled(text, units, base)
                if gold is not None and len(cut) <= 4096:
                    order = xxhash.xxh64_intdigest(cut.encode("utf-8", "replace")) >> 1
                    rows[order] = (cut, [x - low for u in units for x in u], [x for g in gold for x in g])
        top = sorted(rows)[:MAX_REGIONS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(top, pa.int64()), pa.array([rows[k][0] for k in top], pa.string()),
             *(pa.array([rows[k][c] for k in top], pa.list_(pa.int32())) for c in (1, 2))],
            ["_order", "_cut", "_units", "_gold"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All sampled regions, in one partition: one row with the model's numbers."""
    kept = {}
    for batch in batches:
        for order, cut, units, gold in zip(*(c.to_pylist() for c in batch.columns)):
            kept[order] = (cut, list(zip(units[::2], units[1::2])), list(zip(gold[::3], gold[1::3], gold[2::3])))
    if kept:
        model = fit([kept[k] for k in sorted(kept)])
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.ravel().tolist()], pa.list_(pa.float64())) for m in model], ["weights", "moves"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_documents: int = MAX_DOCUMENTS,
          max_regions: int = MAX_REGIONS) -> Model | None:
    """Learn from at most ``max_regions`` regions of about ``max_documents`` documents; None without regions."""
    share = min(1.0, max_documents / max(docs.count(), 1))
    key = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1_000_000))
    texts = docs.where(key < F.lit(int(share * 1_000_000))).select(F.col(text_col).cast("string").alias("_text"))
    rows = (texts.mapInArrow(_examples, "_order long, _cut string, _units array<int>, _gold array<int>")
            .orderBy("_order").limit(max_regions))
    got = rows.mapInArrow(_fit, "weights array<double>, moves array<double>").collect()
    if not got:
        return None
    return Model(np.array(got[0][0]).reshape(len(_NAMES), OUT), np.array(got[0][1]).reshape(OUT + 1, OUT + 1))


def added_spans(text: str, base: list[Span], model: Model) -> Iterator[Span]:
    """Entities that the model finds between base spans."""
    covered = sorted((start, end, _RANK[kind]) for kind, start, end in base)
    k = 0
    for units in regions(text):
        free, before = [], OUT
        for unit in [*units, None]:
            if unit is not None:
                while k < len(covered) and covered[k][1] <= unit[0]:
                    k += 1
                hit = next((c for c in covered[k:k + 4] if c[0] < unit[1] and c[1] > unit[0]), None)
                if hit is None:
                    free.append(unit)
                    continue
            if free:
                for i, j, t in decode_text(text, free, model, before):
                    yield KINDS[t], free[i][0], free[j - 1][1]
            free, before = [], hit[2] if unit is not None else OUT


def scan(text: str, model: Model | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind, then start."""
    base = base_spans(text)
    if model is None or not _ANY.search(text):
        return base, base
    return base, sorted({*base, *added_spans(text, base, model)}, key=lambda s: (_RANK[s[0]], s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``pii`` (array of kind, start, end), counts and a digest of the base spans, all spans joined."""
    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [scan(value.as_py() or "", model) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0),
                 pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for _, spans in rows], kind),
                 *(pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS),
                 pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                 pa.array([joined(spans) for _, spans in rows], pa.string())],
                ["_id", "pii", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, pii array<struct<kind:string,start:long,end:long>>, n_email long, "
                                "n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
                           ).withColumnRenamed("_id", id_col)
