"""Embedding near-duplicates by sorted projection passes.

A pass hashes every vector to the signs of random projections and orders the vectors
lexicographically by them. A vector's window is the run of vectors with its leading
signs (a cell), and ``WINDOW`` more on either side of a cell's border within a task.
Cells of up to ``CROWDED`` rows are compared as the sorted rows go by; a more crowded
one is cut into blocks whose pairs meet one by one, so no cell is cut short. Every pair
is verified by its cosine in double precision, and links are united across passes.

Two vectors at the threshold's angle agree in a sign with a known probability, whatever
the table holds; ``passes_for`` takes from it how many passes find such a pair with
probability ``target`` (closer pairs are likelier still), and how many leading
signs make a cell, by the least work for the measured row count. Few rows are one cell
and one pass. With ``exact``, all pairs are compared in blocks instead.

A pair belongs to the first pass that has both vectors in one cell: each task works the
cells of all passes out again, in whole numbers and so equal everywhere, and
counts only its own pairs. A cell returns a number of links per vector and a
spanning forest of its links, never its pairs; only links that none but a border's
window found are returned as pairs. Equal vectors are one row throughout.

Defined results: vectors that are null, empty, zero or with null or non-finite
components link with nothing; vectors of each length are compared among themselves; rows that repeat a vec_id
share their links and component; a row without id links with nothing, has no
component and isn't kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.graph import connected_components
from clusterloom.session import cut_lineage

# Rows and values of a block at most; small tables are cut into up to SPREAD blocks of SUB_BLOCK rows or more.
BLOCK, BLOCK_VALUES = 16384, 1 << 21
SUB_BLOCK, SPREAD = 512, 8
BAND = 256
# Rows of a cell to aim at, and above which a cell goes to blocks; rows compared beyond a cell's border.
CELL, CROWDED, WINDOW = 1024, 4096, 64
# Signs that order a cell's rows beyond its own; comparisons that cost as much as one more copy of a row.
TAIL, COPY = 8, 512
# How likely a pair at the threshold is to be found; bytes of the vectors of a task.
TARGET, TASK_BYTES = 0.999, 32 << 20
SEED = 20


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the largest component goes to one first, against overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def blocks_of(count: int, dim: int) -> int:
    """How many blocks ``count`` vectors of ``dim`` values are dealt to."""
    rows = max(1, min(BLOCK, BLOCK_VALUES // max(dim, 1)))
    return max(1, -(-count // rows), min(SPREAD, count // SUB_BLOCK))


def _forest(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) join trees, in the order given; ``parent`` holds roots, before and after."""
    ra, rb = parent[a], parent[b]
    apart = np.flatnonzero(ra != rb)
    _, first = np.unique(ra[apart] * len(parent) + rb[apart], return_index=True)
    apart, kept, trees = apart[np.sort(first)], [], {}

    def root(i):
        while (up := trees.get(i, i)) != i:
            trees[i] = trees.get(up, up)
            i = up
        return i

    for k, i, j in zip(apart.tolist(), ra[apart].tolist(), rb[apart].tolist()):
        i, j = root(i), root(j)
        if i != j:
            trees[max(i, j)] = min(i, j)
            kept.append(k)
    if trees:
        to = np.arange(len(parent))
        for i in trees:
            to[i] = root(i)
        parent[:] = to[parent]
    return np.array(kept, np.int64)


def passes_for(count: int, dim: int, threshold: float, target: float = TARGET) -> tuple[int, int]:
    """Leading signs of a cell and number of passes for ``count`` vectors of ``dim`` values."""
    cell = max(1, min(CELL, BLOCK_VALUES // max(4 * dim, 1)))
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi

    def passes(bits: int) -> float:
        together = agree ** bits
        return math.ceil(math.log(1 - target) / math.log1p(-together)) if 1e-9 < together < 1 else (
            1 if together else math.inf)

    most = max(0, math.ceil(math.log2(max(count, 1) / cell)))
    bits = min(range(most + 1), key=lambda b: (passes(b) * (COPY + count / 2 ** b), b))
    return bits, passes(bits)


def crowded_rows(dim: int) -> int:
    """Rows of the largest cell that is compared in one piece."""
    return max(1, min(CROWDED, BLOCK_VALUES // max(dim, 1)))


def codes_of(x: np.ndarray, bits: int, passes: int) -> np.ndarray:
    """A number of ``bits + TAIL`` signs for each unit row and pass; sums of whole numbers below 2^53, so exact."""
    planes = np.random.default_rng([SEED, x.shape[1]]).normal(size=(passes, bits + TAIL, x.shape[1]))
    planes = np.rint(planes * 64).reshape(-1, x.shape[1])
    signs = np.rint(x * (1 << 14)) @ planes.T >= 0
    return signs.reshape(len(x), passes, bits + TAIL) @ (1 << np.arange(bits + TAIL - 1, -1, -1, dtype=np.int64))


def _compare(x, reps, copies, a, b, threshold, cells=None, earlier=0):
    """Links between the rows a and b (equal: within them) that share none of the ``earlier`` first cells.

    A number of links per row, and the edges of a forest.
    """
    same, total = a is b, np.zeros(len(x))
    parent, edges = np.arange(len(x)), []
    for at in range(0, len(a), BAND):
        rows = a[at:at + BAND]
        across = b[at:] if same else b
        near = x[rows] @ x[across].T
        i, j = np.nonzero(near >= threshold - 1e-9)
        if same:
            i, j = i[j > i], j[j > i]
        near = near[i, j]
        i, j = rows[i], across[j]
        sure = near >= threshold + 1e-9
        close = np.flatnonzero(~sure)
        sure[close] = (x[i[close]] * x[j[close]]).sum(axis=1) >= threshold
        for p in range(earlier):
            sure &= cells[i, p] != cells[j, p]
        i, j = i[sure], j[sure]
        total += np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
        kept = _forest(parent, i, j)
        edges.append((reps[i[kept]], reps[j[kept]]))
    src, dst = (np.concatenate([e[side] for e in edges] or [reps[:0]]) for side in (0, 1))
    return total.astype(np.int64), src, dst


LINKS = "src long, dst long, _n long, _back long"


def _rows(reps, total, src, dst, window=()) -> pd.DataFrame:
    """Rows of ``LINKS``: numbers of links (dst null), edges (_n null), pairs of a border with both numbers of copies."""
    linked = np.flatnonzero(total)
    none = [pd.NA]
    back = list(zip(*window)) or [(), (), (), ()]
    return pd.DataFrame({
        "src": np.concatenate([reps[linked], src, np.array(back[0], np.int64)]),
        "dst": pd.array(none * len(linked) + dst.tolist() + list(back[1]), "Int64"),
        "_n": pd.array(total[linked].tolist() + none * len(src) + list(back[2]), "Int64"),
        "_back": pd.array(none * (len(linked) + len(src)) + list(back[3]), "Int64")})


def _pairs(threshold: float, plans: dict | None = None):
    """Links of a pair of blocks: of a crowded cell if ``plans`` are given, else of the whole table."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x, mine = unit(_matrix(pdf["_vec"])), pdf["_sub"].to_numpy()
        reps, copies = pdf["_rep"].to_numpy(), pdf["_copies"].to_numpy()
        low, high = key[-2:]
        a = np.flatnonzero(mine == low)
        b = a if low == high else np.flatnonzero(mine == high)
        cells = codes_of(x, *plans[int(key[0])]) >> TAIL if plans else None
        return _rows(reps, *_compare(x, reps, copies, a, b, threshold, cells, int(key[1]) if plans else 0))
    return run


def _coded(plans: dict):
    """Adds ``_codes``, one for each pass, to the rows of Arrow batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("_dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = unit(part.column("_vec").flatten().to_numpy().astype(np.float64).reshape(-1, dim))
                codes = codes_of(x, *plans[int(dim)])
                ends = pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))],
                    names=[*part.schema.names, "_codes"])
    return run


def _walk(threshold: float, plans: dict):
    """Links of the cells of sorted rows, each compared when its last row has gone by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, before = None, [], None

        def cell():
            nonlocal before
            dim, p, _ = key
            reps, copies, values = (np.concatenate(c) for c in zip(*parts))
            x = unit(values.reshape(-1, dim).astype(np.float64))
            cells, every, window = codes_of(x, *plans[dim]) >> TAIL, np.arange(len(x)), []
            if before is not None and before[0] == (dim, p):
                _, x0, cells0, reps0, copies0 = before
                head = slice(0, WINDOW)
                i, j = np.nonzero((x0[:, None] * x[None, head]).sum(axis=2) >= threshold)
                apart = (cells0[i] != cells[j]).all(axis=1)
                window = [(reps0[m], reps[n], copies[n], copies0[m]) if reps0[m] < reps[n] else
                          (reps[n], reps0[m], copies0[m], copies[n]) for m, n in zip(i[apart], j[apart])]
            before = ((dim, p), x[-WINDOW:], cells[-WINDOW:], reps[-WINDOW:], copies[-WINDOW:])
            found = _rows(reps, *_compare(x, reps, copies, every, every, threshold, cells, p), window)
            return pa.RecordBatch.from_pandas(found, pa.schema([(n, pa.int64()) for n in found]), preserve_index=False)

        for batch in batches:
            if not batch.num_rows:
                continue
            dim, p, prefix, reps, copies = (
                batch.column(c).to_numpy() for c in ("_dim", "_pass", "_cell", "_rep", "_copies"))
            vectors = batch.column("_vec")
            cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(p) != 0) | (np.diff(prefix) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(dim)]):
                mine = (int(dim[lo]), int(p[lo]), int(prefix[lo]))
                if key is not None and mine != key:
                    yield cell()
                    parts = []
                key = mine
                parts.append((reps[lo:hi], copies[lo:hi], vectors.slice(lo, hi - lo).flatten().to_numpy()))
        if parts:
            yield cell()
    return run


def _met(dealt: DataFrame, keys: list[str], threshold: float, plans: dict | None) -> DataFrame:
    """Rows with ``_blocks`` dealt to the pairs of blocks of their keys, and compared."""
    dealt = (dealt.withColumn("_sub", F.pmod(F.xxhash64("_rep"), F.col("_blocks")).cast("int"))
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
             .withColumn("_low", F.least("_sub", "_other")).withColumn("_high", F.greatest("_sub", "_other"))
             .select(*keys, "_low", "_high", "_sub", "_rep", "_vec", "_copies"))
    return dealt.groupBy(*keys, "_low", "_high").applyInPandas(_pairs(threshold, plans), LINKS)


def pass_links(vectors: DataFrame, threshold: float, target: float = TARGET) -> DataFrame:
    """``LINKS`` that the sorted passes find between ``_rep, _vec, _copies``."""
    spark = vectors.sparkSession
    sized = vectors.select(F.size("_vec").alias("_dim"), "_rep", "_vec", "_copies")
    counts = dict(sized.groupBy("_dim").count().collect())  # a number per length
    plans = {d: passes_for(n, d, threshold, target) for d, n in counts.items()}
    coded = cut_lineage(sized.mapInArrow(_coded(plans), f"{_ddl(sized)}, _codes array<long>"))
    place = ["_dim", "_pass", "_cell"]
    rows = (coded.select("_dim", "_rep", "_vec", "_copies", F.posexplode("_codes").alias("_pass", "_code"))
            .withColumn("_cell", F.shiftright("_code", TAIL)))
    limits = spark.createDataFrame([(d, crowded_rows(d)) for d in counts], "_dim int, _limit int")
    crowded = cut_lineage(
        rows.groupBy(*place).agg(F.count("*").alias("_rows")).join(F.broadcast(limits), "_dim")
        .where("_rows > _limit").select(*place, F.ceil(F.col("_rows") / F.col("_limit")).cast("int").alias("_blocks")))
    rows = rows.join(crowded, place, "left")
    size = sum(n * plans[d][1] * d * 8 for d, n in counts.items())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    found = (rows.where("_blocks is null").drop("_blocks").repartitionByRange(tasks, *place)
             .sortWithinPartitions("_dim", "_pass", "_code", "_rep").mapInArrow(_walk(threshold, plans), LINKS))
    if crowded.isEmpty():
        return found
    return found.unionByName(_met(rows.where("_blocks is not null"), place[:2] + ["_cell"], threshold, plans))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def all_links(vectors: DataFrame, threshold: float) -> DataFrame:
    """``LINKS`` of all pairs of ``_rep, _vec, _copies``, each compared once."""
    sized = vectors.withColumn("_dim", F.size("_vec"))
    counts = sized.groupBy("_dim").count().collect()  # a number per length
    blocks = vectors.sparkSession.createDataFrame([(d, blocks_of(n, d)) for d, n in counts], "_dim int, _blocks int")
    return _met(sized.join(F.broadcast(blocks), "_dim"), ["_dim"], threshold, None)


def near_duplicates(rows: DataFrame, threshold: float = 0.9, id_col: str = "vec_id",
                    vec_col: str = "embedding", target: float = TARGET, exact: bool = False) -> DataFrame:
    """``id_col, n_links, component_id, kept`` per row.

    n_links: other vectors linked directly; component_id: the smallest id reachable;
    kept: the id is its component's. A pair at the threshold is found with probability
    ``target``, or surely if ``exact``, by comparing all pairs.
    """
    if not -1 <= threshold <= 1:
        raise ValueError("threshold must be a cosine")
    if not 0 < target < 1:
        raise ValueError("target must be in (0, 1)")
    kind = rows.schema[vec_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # floats are sent as floats, and compared as doubles
    vectors = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast(kind).alias("_vec"))
    sound = (F.col("_vec").isNotNull() & (F.size("_vec") > 0)
             & F.forall("_vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
             & F.exists("_vec", lambda v: v != 0))
    good = vectors.where(F.coalesce(sound, F.lit(False)) & F.col("_id").isNotNull())
    classes = cut_lineage(good.groupBy("_vec").agg(F.min("_id").alias("_rep"), F.count("*").alias("_copies")))
    links = cut_lineage(all_links(classes, threshold) if exact else pass_links(classes, threshold, target))
    window = links.where("_back is not null").distinct()  # a border's pair may be met in several passes
    edges = cut_lineage(links.where("dst is not null").select("src", "dst").distinct())
    linked = edges.select(F.col("src").alias("_rep")).union(edges.select("dst")).distinct()
    component = cut_lineage(connected_components(linked, edges, "_rep").withColumnRenamed("component", "_component"))
    counts = (links.where("dst is null").select(F.col("src").alias("_rep"), "_n")
              .unionAll(window.select("src", "_n")).unionAll(window.select("dst", "_back"))
              .groupBy("_rep").agg(F.sum("_n").alias("_links")))
    counts = component.join(counts, "_rep")
    known = (classes.join(counts, "_rep", "left")
             .select("_vec", F.coalesce("_component", "_rep").alias("_component"),
                     (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links")))
    found = good.join(known, "_vec").select("_id", "_links", "_component")
    others = vectors.where(~F.coalesce(sound, F.lit(False)) | F.col("_id").isNull())
    others = others.select("_id", F.lit(0).cast("long").alias("_links"), F.col("_id").alias("_component"))
    return found.unionByName(others).select(
        F.col("_id").alias(id_col), F.col("_links").alias("n_links"), F.col("_component").alias("component_id"),
        F.coalesce(F.col("_id") == F.col("_component"), F.lit(False)).alias("kept"))
