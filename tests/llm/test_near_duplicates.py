"""SimHash by Golay codes, MinHash fingerprints and sorted projections against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clusterloom.llm import fingerprints as fp
from clusterloom.llm import golay_simhash as gs
from clusterloom.llm import sorted_projections as sp


def components(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# ------------------------------------------------------------------ SimHash

def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int32)[::97]
    high, errors = gs._tables()
    assert len(np.unique(errors)) == 2048 and np.bitwise_count(errors).max() == 3
    codeword = words ^ errors[high[words >> 11] ^ (words & 0x7FF)]
    assert (high[codeword >> 11] == (codeword & 0x7FF)).all()  # remainder zero
    assert np.bitwise_count(words ^ codeword).max() <= 3


def test_at_most_six_indices():
    rng = np.random.default_rng(0)
    for bits in gs.SEGMENTS:
        _, counts = gs.near_indices(rng.integers(0, 1 << bits, 2000).astype(np.int32), bits)
        assert counts.max() <= 6


def test_keys_find_every_pair_at_three_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    b = a.copy()
    for k in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64)
    row_a, key_a = gs.stored_keys(a)
    row_b, key_b = gs.probe_keys(b)
    stored = set(zip(row_a.tolist(), key_a.tolist()))
    found = {r for r, k in zip(row_b.tolist(), key_b.tolist()) if (r, k) in stored}
    assert len(found) == len(a)


def test_simhash_matches_brute_force(spark, documents):
    extra = [(10_000, None), (10_001, ""), (10_002, " \t"), (10_003, "A b"), (10_004, "a B"), (10_005, "x" * 70_000)]
    base = documents.select("text").first()[0].split()
    for k in range(40):  # near copies of one document
        words = list(base)
        words[k % len(words)] = f"changed{k}"
        extra.append((11_000 + k, " ".join(words)))
    docs = documents.select("doc_id", "text").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    rows.sort()
    f = np.array([x for _, x in rows], np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3, 1))
    root = components(len(rows), near.tolist())
    want = {i: ("%016x" % x, rows[root[k]][0]) for k, (i, x) in enumerate(rows)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in gs.near_duplicates(docs).collect()}
    assert got == want
    kept = {r.doc_id for r in gs.keep_one(docs).select("doc_id").collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_keys_are_not_broadcast(spark):
    """A table of fingerprints looks small, the keys made of it are many more: neither side may go to the driver."""
    classes = spark.range(300).select(F.xxhash64("id").alias("_fp"))
    plan = gs.links(classes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_blocks_of_shingles_add_up():
    text = b" ".join(b"w%d" % (i * i % 1009) for i in range(1500))
    assert gs.fingerprint(text, block=64) == gs.fingerprint(text) == plain_fingerprint(text.decode())


def test_simhash_awkward(awkward, no_docs):
    out = gs.near_duplicates(awkward).collect()
    assert len(out) == awkward.count()
    by = {r.doc_id: r for r in out}
    assert by[0].fingerprint == by[1].fingerprint == by[2].fingerprint == "0" * 16
    assert by[2].component_id == 0 and by[9].component_id == 8 and by[None].component_id is None
    assert gs.near_duplicates(no_docs).count() == 0 and gs.keep_one(no_docs).count() == 0
    kept = gs.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id is null").count() == 1
    assert kept.where("doc_id = 5").count() == 1  # of two equal rows one stays
    with pytest.raises(ValueError):
        gs.near_duplicates(awkward, max_bits=4)


def test_keep_one_with_repeated_and_null_ids(spark):
    """Each row goes by its own text: a near copy doesn't take another text with the same id along."""
    a, b, c = (" ".join(f"{w}{k}" for k in range(60)) for w in "abc")
    docs = spark.createDataFrame(
        [(1, a, "x"), (5, a, "y"), (5, b, "z"), (7, b, "x"), (None, a, "n"), (None, c, "first"), (None, c, "second"),
         (9, "own", "x"), (9, "own", "x"), (3, None, "x"), (2, "", "x")], "doc_id long, text string, _place string")
    kept = sorted(map(tuple, gs.keep_one(docs.coalesce(1)).collect()), key=repr)
    assert kept == sorted([(1, a, "x"), (5, b, "z"), (None, c, "first"), (9, "own", "x"), (2, "", "x")], key=repr)


# ------------------------------------------------------------------ MinHash

def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_likeness_is_unbiased():
    rng = np.random.default_rng(4)
    errors = []
    for share in (0.0, 0.2, 0.5, 0.8, 0.95):
        for _ in range(6):
            words = [f"w{k}" for k in rng.integers(0, 10 ** 6, 900)]
            other = words[:int(share * 900)] + [f"v{k}" for k in rng.integers(0, 10 ** 6, 900 - int(share * 900))]
            a, b = " ".join(words), " ".join(other)
            s = fp.text_signatures([a.encode(), b.encode()])
            errors.append(fp.likeness(s[:1], s[1:])[0] - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.1


def test_densified_sparse_documents():
    a = "one two three four five six seven"  # three shingles, most bins empty
    b = "one two three four five six eight"  # two of four shared
    s = fp.text_signatures([a.encode(), b.encode(), a.upper().encode()])
    assert fp.likeness(s[:1], s[1:2])[0] == pytest.approx(0.5, abs=0.12)
    assert (s[0] == s[2]).all()


def test_packing_round_trip():
    values = np.random.default_rng(0).integers(0, 16, (5, fp.BINS)).astype(np.uint8)
    hexes = fp.packed(values)
    assert all(len(h) == fp.BINS * fp.BITS // 4 for h in hexes) and (fp.unpacked(hexes) == values).all()


@pytest.mark.parametrize("ranges", [1, 7])
def test_next_documents(spark, documents, ranges):
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(2 ** 62 + 1, "é" * 301), (2 ** 62 + 2, None), (2 ** 62 + 3, "ab"), (-7, "a b c d e f")], "doc_id long, text string"))
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in fp.with_next(docs.repartition(5), ranges=ranges).collect()}
    assert len(got) == len(rows)
    worst = 0
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        new = fp.edited(text, after)
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        own, changed, nxt = fp.text_signatures([t.encode() for t in (text, new, after)])
        assert got[i].fingerprint == fp.packed(own[None])[0] and got[i].edited_fingerprint == fp.packed(changed[None])[0]
        assert got[i].near_next == pytest.approx(fp.likeness(own[None], nxt[None])[0])
        worst = max(worst, abs(got[i].near_edited - jaccard(text, new)))
    assert worst < 0.2


def test_fingerprints_awkward(awkward, no_docs):
    out = fp.with_next(awkward, ranges=4).collect()
    assert len(out) == awkward.count()
    assert fp.fingerprint(awkward).count() == awkward.count()
    assert fp.with_next(no_docs).count() == 0
    alone = fp.with_next(awkward.where("doc_id = 5").limit(1)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


# ------------------------------------------------------------------ sorted projections

def planted_vectors(n=400, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[50:120] = x[50] + rng.normal(size=(70, dim)) * 0.05 * np.linalg.norm(x[50]) / np.sqrt(dim)
    for k in range(200, 260, 2):  # pairs between cosines 0.85 and 0.99
        u = x[k] / np.linalg.norm(x[k])
        v = rng.normal(size=dim)
        v -= (v @ u) * u
        c = rng.uniform(0.85, 0.99)
        x[k + 1] = 3 * (c * u + np.sqrt(1 - c * c) * v / np.linalg.norm(v))
    x[300:340] = x[300]
    return x


def plain_links(ids, x, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    root = components(len(x), np.argwhere(np.triu(near)).tolist())
    return {i: (int(near[k].sum()), ids[root[k]]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("sub_block", [2048, 16])
def test_sorted_projections_match_brute_force(spark, monkeypatch, sub_block):
    monkeypatch.setattr(sp, "SUB_BLOCK", sub_block)
    monkeypatch.setattr(sp, "BLOCK", 512)
    x = planted_vectors()
    ids = list(range(100, 100 + len(x)))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in sp.near_duplicates(df.repartition(3)).collect()}
    want = plain_links(ids, x, 0.9)
    assert sum(got[i] == want[i] for i in ids) >= 0.99 * len(ids)
    assert all(got[i][0] <= want[i][0] for i in ids)  # never a link below the threshold


def test_sorted_projections_awkward(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 0.0, 0.0]),
            (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0]), (9, [1.0, 1.0]), (None, [1.0, 1.0]), (10, [-1.0, 1.0]),
            (11, [1e300, 1e300])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, _rep string, label string")
    got = sp.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in (0, 1, 2, 3, 4, 5, 6, 10))
    assert {by[i].component_id for i in (7, 8, 9, 11)} == {7} and by[7].n_links == 4 and not by[8].kept
    assert by[None].n_links == 0 and by[None].component_id is None and not by[None].kept
    assert sp.near_duplicates(df.limit(0)).count() == 0
    assert sp.near_duplicates(df.where(F.col("vec_id") < 3)).count() == 3


def crowded_vectors(n=3000, dim=64, seed=5):
    """Vectors at cosine 0.8 of each other, every tenth with a partner at cosine 0.9 to 0.93."""
    rng = np.random.default_rng(seed)
    x = np.sqrt(0.8) * np.eye(dim)[0] + np.sqrt(0.2 / (dim - 1)) * rng.normal(size=(n, dim)) * (np.arange(dim) > 0)
    for k in range(0, n, 10):
        u, v = x[k] / np.linalg.norm(x[k]), rng.normal(size=dim)
        v -= (v @ u) * u
        c = rng.uniform(0.9001, 0.93)
        x[k + 1] = c * u + np.sqrt(1 - c * c) * v / np.linalg.norm(v)
    return x


def test_every_link_of_a_crowded_neighbourhood(spark):
    x = crowded_vectors()
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in sp.near_duplicates(df).collect()}
    want = {i: (n, c, i == c) for i, (n, c) in plain_links(ids, x, 0.9).items()}
    assert got == want and sum(n > 0 for n, _, _ in want.values()) >= 600


def test_vectors_of_a_minority_length_link(spark):
    rows = [(k, [1.0, float(k)]) for k in range(0, 50, 10)] + [(100 + k, [3.0, 4.0, 0.0]) for k in range(3)] + [
        (200, [3.0, 4.0, 0.1]), (201, [0.0, 0.0, 1.0]), (300, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in sp.near_duplicates(df).collect()}
    want = {}
    for dim in (1, 2, 3):
        mine = [(i, v) for i, v in rows if len(v) == dim]
        want |= plain_links([i for i, _ in mine], np.array([v for _, v in mine]), 0.9)
    assert got == want and got[102] == (3, 100)


def test_blocks_are_bounded():
    assert sp.blocks_of(0, 64) == 1 and sp.blocks_of(5000, 64) == sp.SPREAD
    for n, dim in ((10 ** 6, 64), (10 ** 6, 4096)):
        assert n / sp.blocks_of(n, dim) <= min(sp.BLOCK, sp.BLOCK_VALUES / dim)


def test_forest_keeps_the_components():
    rng = np.random.default_rng(2)
    parent, kept = np.arange(300), []
    pairs = rng.integers(0, 300, (240, 2))
    for at in range(0, 240, 60):
        a, b = pairs[at:at + 60].T
        kept += [(a[k], b[k]) for k in sp._forest(parent, a, b)]
    assert components(300, kept) == components(300, pairs.tolist()) == parent.tolist()
    assert len(kept) == 300 - len(set(parent.tolist()))


def test_passes_follow_rows_and_threshold():
    assert sp.passes_for(0, 64, 0.9) == (0, 1) and sp.passes_for(1000, 64, 0.9) == (0, 1)
    assert sp.passes_for(10 ** 6, 64, -1.0) == (0, 1) and sp.passes_for(10 ** 6, 64, 1.0)[1] == 1
    agree = 1 - np.arccos(0.9) / np.pi
    for n in (50_000, 10 ** 6, 10 ** 9):
        bits, passes = sp.passes_for(n, 64, 0.9)
        assert bits > 0 and (1 - agree ** bits) ** passes <= 1 - sp.TARGET


def test_codes_do_not_depend_on_the_rows_beside():
    x = sp.unit(np.random.default_rng(1).normal(size=(300, 48)))
    whole = sp.codes_of(x, 6, 9)
    assert (whole == np.concatenate([sp.codes_of(x[k:k + 7], 6, 9) for k in range(0, 300, 7)])).all()


@pytest.mark.parametrize("cell, crowded, window", [(64, 256, 8), (64, 40, 2), (16, 24, 64)])
def test_passes_find_what_all_pairs_find(spark, monkeypatch, cell, crowded, window):
    """Several cells and passes, crowded cells in blocks; counts of links are never added twice."""
    for name, value in (("CELL", cell), ("CROWDED", crowded), ("WINDOW", window), ("COPY", 1)):
        monkeypatch.setattr(sp, name, value)
    x = np.concatenate([planted_vectors(n=900, dim=24, seed=2), crowded_vectors(n=300, dim=24)])
    x[620:640] = x[60]
    ids = list(range(len(x)))
    assert sp.passes_for(len(x), 24, 0.9)[0] >= 4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    kept = np.array([r.embedding for r in df.orderBy("vec_id").collect()])
    want = plain_links(ids, kept, 0.9)
    got = {r.vec_id: (r.n_links, r.component_id) for r in sp.near_duplicates(df).collect()}
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert sum(got[i][0] for i in ids) >= 0.995 * sum(n for n, _ in want.values())
    assert sum(got[i] == want[i] for i in ids) >= 0.95 * len(ids)
    queries = [i for i in ids if i % 100 == 0]
    assert sum(got[i][0] for i in queries) >= 0.99 * sum(want[i][0] for i in queries)
    exact = {r.vec_id: (r.n_links, r.component_id) for r in sp.near_duplicates(df, exact=True).collect()}
    assert exact == want
