"""WARC archives, the BPE automaton, vector packing and the pipeline: round trips and brute force."""

import base64
import gzip
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clusterloom.llm import bpe_automaton as ba
from clusterloom.llm import golay_simhash, packing, secrets_scan, toxicity, warc

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# ------------------------------------------------------------------ WARC

def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def page_rows():
    html = ["<p>a</p>", None, "", "é\r\n\r\nWARC/1.1\r\n", "<p>a</p>", "x" * 50_000, "<p>a</p>", "é\r\n\r\nWARC/1.1\r\n"]
    return [(k * 3, None if k == 2 else f"http://h/{k}\r\nX: y", h, "z") for k, h in enumerate(html)]


def test_warc_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string")
    root = warc.archive_folder(spark)
    index = warc.write(pages.repartition(3), root, file_bytes=600)
    got = {r.page_id: r for r in warc.read(index, root, with_payload=True).collect()}
    last = {}
    for i, _, h, _ in rows:
        last[h or ""] = max(last.get(h or "", -1), i)
    assert len(got) == len(rows)
    for i, _, h, _ in rows:
        first = last[h or ""]
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len((h or "").encode()), sha(h))
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
        assert r.payload == ((h or "") if i == first else None)
    some = index.where(F.col("_id").isin(0, 9, 15))
    assert {r.page_id for r in warc.read(some, root).collect()} == {0, 9, 15}


def test_warc_least_and_awkward(spark):
    pages = spark.createDataFrame(page_rows() + [page_rows()[0], (None, None, "<p>a</p>", "z")],
                                  "page_id long, url string, html string, file string")
    root = warc.archive_folder(spark)
    out = warc.read(warc.write(pages, root, least=1), root).collect()
    assert len(out) == 10
    assert all(r.record_type == "response" for r in out if r.payload_bytes == 0 or r.page_id is None)
    root = warc.archive_folder(spark)
    assert warc.read(warc.write(pages.limit(0), root), root).count() == 0


def test_ranges_are_coalesced():
    import pandas as pd

    index = pd.DataFrame({"offset": [50, 0, 1000, 60], "length": [10, 50, 5, 40]})
    assert [(a, b, len(r)) for a, b, r in warc.ranges(index, gap=100)] == [(0, 100, 3), (1000, 1005, 1)]
    assert [(a, b) for a, b, _ in warc.ranges(index, gap=10_000, most=60)] == [(0, 60), (60, 100), (1000, 1005)]


def test_changed_archive_is_noticed(spark):
    pages = spark.createDataFrame(page_rows()[:1], "page_id long, url string, html string, file string")
    root = warc.archive_folder(spark)
    index = warc.write(pages, root)
    system, folder = warc.location(root)
    name = index.first().file
    data = gzip.decompress(system.open_input_file(f"{folder}/{name}").read())
    assert data.startswith(b"WARC/1.1\r\n") and b"<p>a</p>" in data  # any WARC reader can read it
    changed = gzip.compress(data.replace(b"<p>a", b"<p>b"), warc.GZIP_LEVEL, mtime=0)
    with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
        out.write(changed)
    with pytest.raises(Exception, match="differs from its index row"):
        warc.read(index.withColumn("length", F.lit(len(changed))), root).collect()


# ------------------------------------------------------------------ BPE automaton

def strange_texts():
    rng = np.random.default_rng(8)
    pool = ["a", "aa", "th", "the", " ", "  ", "\n", "é", "漢", "'s", "'ll", "1", "23", "!", "...", " ", " ", "\t", "Ġ",
            "<|endoftext|>", "ing", "\x1c", "\u0085", "😀", "́", "tion", "x" * 40]
    fixed = ["", " ", "aaaaaaaaaaaaaaa", " aaaaa  aaaa ", "word  next", "a \n b", "<|endoftext|><|endoftext|> a", "\n\n  x\n",
             "don't we'll they'RE", "ab" * 300]
    return fixed + ["".join(rng.choice(pool, rng.integers(1, 25))) for _ in range(1500)]


def test_automaton_encodes_like_the_library(documents):
    ours, theirs = ba.encoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    theirs.no_truncation()
    theirs.no_padding()
    for text in strange_texts() + [r.text for r in documents.select("text").limit(60).collect()]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids, repr(text)
        assert ours.decode(ids) == text


def test_automaton_matches_greedy_merging():
    rng = np.random.default_rng(3)
    for _ in range(20):  # random merge lists over three symbols
        label, merges = {0: "a", 1: "b", 2: "c"}, []
        while len(merges) < 25:
            u, v = (int(k) for k in rng.choice(list(label), 2))
            joined = label[u] + label[v]
            if joined not in label.values() and len(joined) < 12:
                made = dict(label)
                merges.append((u, v, len(made)))
                label[len(made)] = joined
        auto = ba.Automaton([0, 1, 2], merges)
        for _ in range(60):
            ids = rng.integers(0, 3, rng.integers(1, 14)).tolist()
            while True:  # the earliest merge, leftmost first
                pairs = {(a, b): k for k, (a, b, _) in reversed(list(enumerate(merges)))}
                ranks = [pairs.get(p, 99) for p in zip(ids, ids[1:])]
                if not ranks or min(ranks) == 99:
                    break
                u, v, uv = merges[min(ranks)]
                out, k = [], 0
                while k < len(ids):
                    if ids[k:k + 2] == [u, v]:
                        out.append(uv)
                        k += 2
                    else:
                        out.append(ids[k])
                        k += 1
                ids = out
            state = 0
            for t in ids:
                assert auto.arc(state, t)
                state = auto.after[t]


def test_bpe_digests(spark, documents, awkward, no_docs):
    docs = documents.select("doc_id", "text").limit(40).unionByName(spark.createDataFrame(
        [(10_000 + i, t) for i, t in enumerate([None, "", "<|endoftext|> x", "😀" * 200])], "doc_id long, text string"))
    theirs = Tokenizer.from_file(BYTE_BPE)
    got = {r.doc_id: r for r in ba.digests(docs, BYTE_BPE).collect()}
    for r in docs.collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = theirs.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = ba.decode(ba.encode(awkward, BYTE_BPE), BYTE_BPE)
    want = awkward.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assert sorted(back.collect(), key=str) == sorted(want.collect(), key=str)
    assert ba.digests(no_docs, BYTE_BPE).count() == 0


# ------------------------------------------------------------------ packing

def check_pieces(rows, ids, limits, prompts=None):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for doc, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[doc][at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[doc])
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        total = sum(r.length for r in own)
        loss = sum(max(0, r.start + r.length - max(r.start, (prompts or {}).get(r.doc_id, 0))) for r in own)
        assert total <= limits[0] and len(own) <= limits[1] and loss <= limits[2]
        assert sum(r.loss_tokens for r in own) == loss and {r.sequence_tokens for r in own} == {total}
        padding += 0 if total & (total - 1) == 0 else limits[0] - total
    return padding


@pytest.mark.parametrize("limits", [(4096, 128, 4096), (256, 3, 200), (64, 1, 64)])
def test_packing_documents(documents, limits):
    docs = documents.select("doc_id", "text").where("doc_id < 120")
    rows = packing.pack_documents(docs.repartition(3), WORD_BPE, max_tokens=limits[0], max_segments=limits[1],
                                  max_loss=limits[2], chunk_tokens=5000).collect()
    theirs = Tokenizer.from_file(WORD_BPE)
    ids = {r.doc_id: theirs.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    assert check_pieces(rows, ids, limits) == 0


def test_packing_with_prompts(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["cat"] * int(rng.integers(0, 90))), int(rng.integers(0, 60)) if i % 5 else None)
            for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prompt int")
    limits = (128, 6, 70)
    got = packing.pack_documents(docs, WORD_BPE, max_tokens=128, max_segments=6, max_loss=70, prompt_col="prompt",
                                 chunk_tokens=3000).collect()
    theirs = Tokenizer.from_file(WORD_BPE)
    ids = {i: theirs.encode(t, add_special_tokens=False).ids + [2] for i, t, _ in rows}
    prompts = {i: min(p or 0, len(ids[i])) for i, _, p in rows}
    check_pieces(got, ids, limits, prompts)


def test_runs_encode_like_whole_texts():
    import pyarrow as pa

    theirs = Tokenizer.from_file(WORD_BPE)
    texts = [t for t in strange_texts() if "endoftext" not in t] + ["<|endoftext|>a <|startoftext|>", "ΑΣ ΣΑΣ Σ", "Á a ́x"]
    for text, ids in zip(texts, packing.encode_texts(pa.array(texts), WORD_BPE, None)):
        assert ids.tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


def test_kept_results_turn_over():
    from clusterloom.llm.texts import Kept

    made = []
    kept = Kept(lambda k: made.append(k) or k * 2, limit=2, longest=2)
    assert [kept[k] for k in ("a", "b", "c", "a", "d", "e", "a", "abc", "abc")] == [
        "aa", "bb", "cc", "aa", "dd", "ee", "aa", "abcabc", "abcabc"]
    assert made == ["a", "b", "c", "d", "e", "abc", "abc"]


def test_packing_awkward(awkward, no_docs):
    rows = packing.pack_documents(awkward, WORD_BPE).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in awkward.select("doc_id").collect()}
    assert packing.pack_documents(no_docs, WORD_BPE).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(awkward, WORD_BPE, max_segments=0)


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, sf)
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, p in scores.items() if not p}
    once = stage["near_duplicates"](spark, clean, sf)
    groups = {r.doc_id: r.component_id for r in golay_simhash.near_duplicates(clean).collect()}
    assert {r.doc_id for r in once.collect()} == {i for i, c in groups.items() if i == c}
    safe = stage["secrets"](spark, once, sf)
    before = {r.doc_id: r for r in once.collect()}
    for r in safe.collect():
        assert r.text == secrets_scan.redacted(before[r.doc_id].text)
        assert r.n_chars == (before[r.doc_id].n_chars if r.text == before[r.doc_id].text else len(r.text))
    assert safe.columns == once.columns == clean.columns == docs.columns
    pieces = stage["packing"](spark, safe, sf).collect()
    theirs = Tokenizer.from_file(WORD_BPE)
    ids = {r.doc_id: theirs.encode(r.text or "", add_special_tokens=False).ids + [2] for r in safe.collect()}
    assert check_pieces(pieces, ids, (4096, 128, 4096)) == 0
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(pieces)


def test_pipeline_awkward(spark, awkward, no_docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    for docs in (awkward, no_docs):
        at = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            at = stage(spark, at, str(tmp_path))
            if k < 3:
                assert at.columns == docs.columns
        at.collect()


def test_word_ids_are_the_librarys():
    """Plain texts go word by word, other characters and special tokens run by run."""
    tokenizer = Tokenizer.from_file(WORD_BPE)
    rng = np.random.default_rng(8)
    symbols = [*"abzSTREV'.,!\"()-_<|>0129 \n\t\x0b\x1f\0\x7f\x85éÄß×÷漢Σςẞ\u0301À\xa0İ…", "'re", "'LL", "<|endoftext|>",
               "<|ENDOFTEXT|>", "don't", "ΟΔΟΣ"]
    texts = ["".join(rng.choice(symbols, rng.integers(0, 30))) for _ in range(4000)]
    coder = packing.WordIds(WORD_BPE)
    for text in texts:
        ids = np.frombuffer(coder.ids(text), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_other_vocabularies_go_by_runs():
    coder = packing.WordIds(BYTE_BPE)
    assert not coder.by_words and coder.ids("one two") == coder.runs["one"] + coder.runs["two"]
