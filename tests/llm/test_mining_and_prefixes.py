"""Hard negatives, fill-in-middle frames and prefix counts against brute force and the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clusterloom.llm import fim_frames as fim
from clusterloom.llm import hard_negatives as hn
from clusterloom.llm import prefix_counts as pc

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<float>, label int, score string, _x string, rank string"


# ------------------------------------------------------------------ hard negatives

def mined(rows, every=100):
    """All anchors against all rows, in Python integers."""
    seen = {}
    for vec_id, vec, label, *_ in rows:
        if vec_id is None or vec is None or label is None or any(v is None or not np.isfinite(v) for v in vec):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        seen[vec_id, label, tuple(int(np.floor(256 * float(np.float32(v)))) for v in vec)] = None
    out = []
    for anchor in seen:
        if anchor[0] % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(anchor[2], r[2])), r[0], r[1]) for r in seen
                        if r is not anchor and len(r[2]) == len(anchor[2]))
        positives = [r for r in scored if r[2] == anchor[1]][:5]
        for score, positive, _ in positives:
            hard = [r for r in scored if r[2] != anchor[1] and 30 * -score <= 100 * -r[0] <= 90 * -score][:10]
            out += [(anchor[0], positive, k, r[1], -score, -r[0]) for k, r in enumerate(hard, 1)]
    return sorted(out)


def vectors(n, dim, seed, spread=0.4, groups=6, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    x = (centres[rng.integers(groups, size=n)] + rng.normal(0, spread, (n, dim))) * scale
    return [(i, [float(np.float32(v)) for v in row], int(rng.integers(10)), "x", "x", "x") for i, row in enumerate(x)]


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("spread,scale", [(0.3, 1.0), (3.0, 100.0), (0.3, 3e5)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, spread, scale):
    """Small windows, pieces and steps, so that walks go through several rounds and stop early; large whole numbers."""
    for name, value in (("FIRST_WINDOW", 100), ("GROWTH", 2), ("PIECE", 32), ("MEMBERS", 3), ("STEP", 8), ("BINS", 64),
                        ("LIST_MEMBERS", 2)):
        monkeypatch.setattr(hn, name, value)
    rows = vectors(700, 8, 3, spread, scale=scale)
    df = spark.createDataFrame(rows, VECTORS)
    assert got(hn.mine(df, clusters=4)) == mined(rows)


def test_hard_negatives_awkward(spark):
    rows = vectors(240, 4, 5)
    rows += [(None, [1.0] * 4, 1, "", "", ""), (300, None, 1, "", "", ""), (301, [1.0, None, 0.0, 0.0], 1, "", "", ""),
             (302, [1.0, float("nan"), 0.0, 0.0], 1, "", "", ""), (303, [1.0, float("inf"), 0.0, 0.0], 1, "", "", ""),
             (304, [1.0] * 4, None, "", "", ""), (400, [0.0] * 4, 3, "", "", ""), (500, [], 2, "", "", ""),
             (501, [], 2, "", "", ""), (502, [], 4, "", "", ""), (600, [1.0, 2.0], 5, "", "", ""),
             (601, [1.0, 2.0], 5, "", "", ""), (602, [0.5, 1.0], 6, "", "", ""), (603, [0.5, 1.0], 7, "", "", "")]
    rows += [rows[0], rows[100], (100, [9.0] * 4, 1, "", "", "")]  # equal rows, and an id with two vectors
    rows += [(1000 + i, [1.0, 1.0, 0.0, 0.0], i % 3, "", "", "") for i in range(60)]  # ties
    df = spark.createDataFrame(rows, VECTORS)
    assert got(hn.mine(df)) == mined(rows)
    assert got(hn.mine(df.where("vec_id = 1"))) == [] and got(hn.mine(df.limit(0))) == []
    assert got(hn.mine(df.where("vec_id = 100"))) == mined([r for r in rows if r[0] == 100])
    with pytest.raises(ValueError):
        hn.mine(df, low=90, high=30)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    members, rows = rng.normal(size=(50, 6)) + 1, rng.normal(size=(400, 6)) * rng.uniform(0, 5, (400, 1))
    centre = hn.centroids(members, 1)
    angle, norm = hn.angles(members, centre)
    t, size = hn.angles(rows, centre)
    most = hn.bounds(t[:, 0], size, angle[:, 0].min(), angle[:, 0].max())
    assert (members @ rows.T <= norm[:, None] * most[None, :] + 1e-9).all()
    assert (most < size - 1e-6).any()  # and they bound something


# ------------------------------------------------------------------ fill-in-middle

def sha(text):
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def filled(doc_id, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in fim.MARKERS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def fim_rows(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab<PSM>é漢😀 \n") for _ in range(rng.choice([0, 1, 2, 5, 40, 3000]))) for _ in range(300)]
    texts += [None, "", "<P>", "x<M>y", "<", "<P", ">", "<S<S" * 9, "😀" * 200, "plain text " * 900]
    rows = [(i, t, "x", "x", "x") for i, t in enumerate(texts)]
    rows += [rows[7], (None, "no id", "x", "x", "x"), (7, "another text", "x", "x", "x"), (None, None, "x", "x", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n string, frames string, form string")


@pytest.mark.parametrize("frame_bytes", [7, 1 << 17])
def test_fill_in_middle(spark, frame_bytes):
    rows, df = fim_rows(spark)
    stored = fim.fill_in_middle(df, frame_bytes=frame_bytes)
    out = sorted((tuple(r) for r in fim.digests(stored).collect()), key=repr)
    want = [(i, *filled(i, t)) for i, t, *_ in rows]
    assert out == sorted(((*w[:5], sha(w[5]), sha(r[1] or "")) for w, r in zip(want, rows)), key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    shown = sorted(((r.doc_id, r.output, r.restored) for r in fim.texts(stored).collect()), key=repr)
    assert shown == sorted(((r[0], w[5], r[1] or "") for w, r in zip(want, rows)), key=repr)


def test_fill_in_middle_awkward(spark, awkward, no_docs):
    out = sorted((tuple(r) for r in fim.digests(fim.fill_in_middle(awkward)).collect()), key=repr)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    want = [(i, *filled(i, t)) for i, t in rows]
    assert out == sorted(((*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, rows)), key=repr)
    assert fim.digests(fim.fill_in_middle(no_docs)).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(awkward, markers=("<P>", "<P>", "<M>"))


def test_other_rates_and_markers(spark):
    df = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(200)], "doc_id long, text string")
    forms = {r.form for r in fim.fill_in_middle(df, rate=0).collect()}
    assert forms == {"plain"}
    rows = fim.texts(fim.fill_in_middle(df, rate=100, spm=100, seed=9, markers=("[p]", "[s]", "[middle]")),
                     ("[p]", "[s]", "[middle]")).collect()
    assert {r.form for r in rows} == {"spm"} and all(r.output.startswith("[s]") for r in rows)
    assert all(r.restored == f"text {r.doc_id} " * 20 for r in rows)


def test_frames_open_only_what_a_cut_touches(monkeypatch):
    text = fim.Frames.of(("é" * 50 + "漢字") .encode() * 400, 64)
    opened, whole = [], fim.Frames.text
    monkeypatch.setattr(fim.Frames, "text", lambda self, k: opened.append(k) or whole(self, k))
    out = fim.Frames()
    out.copy(text, 1001, 15_003)
    assert len(opened) <= 2 and len(out.data) > 100
    assert b"".join(out.stream()).decode() == (("é" * 50 + "漢字") * 400)[1001:15_003]
    assert text.units[-1] == 52 * 400 and text.sizes[-1] == 106 * 400


def test_markers_across_frames():
    frames = fim.Frames()
    for part in (b"ab<", b"S", b"> <S", b"<S>", b"x"):
        frames.add_text(part)
    assert [frames.find(b"<S>", k) for k in (0, 2, 3, 7, 8, 9)] == [2, 2, 8, 8, 8, -1]


def test_selection(spark):
    df = spark.createDataFrame([(1, "añb漢c" * 50, 3, 4), (2, None, 0, 9), (3, "abc", 2, 50), (4, "abc", 7, 1)],
                               "doc_id long, text string, a int, b int")
    stored = fim.fill_in_middle(df, rate=0, frame_bytes=11).join(df.select("doc_id", "a", "b"), "doc_id")
    assert dict(fim.selected(stored, "a", "b").select("doc_id", "selection").collect()) == {
        1: ("añb漢c" * 50)[3:7], 2: "", 3: "c", 4: ""}


# ------------------------------------------------------------------ prefix counts

@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_every_prefix(library):
    rng = random.Random(4)
    symbols = [*"abc ' \n\t.relsv<|>09é漢😀́　\x1f", "<|endoftext|>", "'re", "'ll", "  ", " the", "indivisible"]
    texts = ["".join(rng.choice(symbols) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    texts += ["", " ", "<|endoftext|>", "a  <|endoftext|>  b", "<|endoftext|><|endoftext|", "don'r", "x  'll "]
    count = pc.counter(BYTE_BPE).counts
    for text in texts:
        assert count(text).tolist() == [library(text[:i]) for i in range(len(text) + 1)], text


def test_stored_counts(spark, awkward, no_docs, library):
    stored = pc.prefix_counts(awkward, BYTE_BPE)
    out = sorted(((r.doc_id, r.n_bytes, r.n_tokens, len(r.counts), r.counts[-1]) for r in stored.collect()), key=repr)
    texts = [(r.doc_id, r.text or "") for r in awkward.collect()]
    assert out == sorted(((i, len(t.encode()), library(t), len(t) + 1, library(t)) for i, t in texts), key=repr)
    assert pc.prefix_counts(no_docs, BYTE_BPE).count() == 0


def test_questions_without_encoding(spark, library):
    texts = ["one two three indivisible words", "hello", "", None, "漢字 and  blanks  "]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(9, "never counted")], "doc_id long, text string")
    stored = pc.prefix_counts(docs.where("doc_id < 9"), BYTE_BPE).cache()
    for chars in (0, 3, 8, 500):
        rows = stored.select("doc_id", pc.tokens_in(chars).alias("n")).collect()
        assert all(r.n == library((texts[r.doc_id] or "")[:chars]) for r in rows)
    for budget in (-1, 0, 1, 3, 100):
        for r in stored.select("doc_id", pc.longest_prefix(budget).alias("n")).collect():
            fits = [i for i in range(len(texts[r.doc_id] or "") + 1) if library((texts[r.doc_id] or "")[:i]) <= budget]
            assert r.n == max(fits, default=None)
    cut = {r.doc_id: r.text for r in pc.truncate(docs, stored, 3).collect()}
    assert cut[9] == "never counted" and cut[3] is None and library(cut[0]) <= 3 and texts[0].startswith(cut[0])
    assert cut[1] == "hello" and pc.truncate(docs, stored, 3).columns == ["doc_id", "text"]


def test_word_and_run_stores_stay_bounded():
    counter = pc.PrefixCounter(BYTE_BPE)
    counter.runs.limit = counter.words.limit = 50
    rng = random.Random(0)
    for _ in range(20):
        counter.counts(" ".join(str(rng.random()) for _ in range(30)))
    assert max(map(len, (counter.runs, counter.words, counter.runs.older, counter.words.older))) <= 51


def test_queries_return_the_named_columns(spark):
    from clusterloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    columns = {"op11_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
               "op12_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
               "op13_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"]}
    for name, want in columns.items():
        assert QUERIES[name](spark, sf).columns == want
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    over = QUERIES["op13_token_counts"](spark, sf).where("over_limit <> (n_tokens > 1024)").count()
    assert over == 0 and docs.select(F.count("*")).first()[0] == QUERIES["op13_token_counts"](spark, sf).count()
