"""K-Means family (C1-C3), nearest-centroid join (J3) and canonical labels.

Lloyd iterations return partial sums by (group, restart, label), so that one Spark job
advances all ``n_init`` restarts, and all groups where each is clustered on its own:

* first centres come from k-means|| over all rows (Bahmani et al., 2012): a few rounds of weighted
  sampling far from the candidates so far, then k-means++ on the weighted candidates;
* the restart with the lowest cost wins;
* k is clamped to the row count, and a centre that loses its rows moves to the farthest one;
* labels are canonical: numbered by (size desc, min item id).

Rows are dealt to the tasks of all cores once, as matrices (``_packed``); an iteration reads these and
not a list for each row.

Centroids are k x D for each group and restart, and k is a parameter; they are shipped
to the tasks, and nothing else is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterloom.session import cut_lineage

MAX_BROADCAST_VALUES = 64_000_000  # doubles shipped at once, 512 MB
# First centres: rounds of k-means||, rows sampled in each for every centre, and candidates of a group where many
# groups are clustered at once.
SEED_ROUNDS, OVERSAMPLING = 4, 2
CANDIDATES_PER_CENTRE = 50
# Numbers of the vectors that one task holds: at most TASK_VALUES, and not so few that a task is mostly start-up.
TASK_VALUES, LEAST_TASK_VALUES = 4_000_000, 1 << 18
# Rows compared with the centres at a time, and numbers of their distances.
PIECE_ROWS, PIECE_VALUES = 2048, 1 << 22
MAX_RETURNED_VALUES = 1 << 21  # numbers that the driver adds up after a pass, 16 MB
# Mini-batch: what the rows of earlier passes weigh after another pass.
FORGET = 0.5


def assign_nearest(df: DataFrame, centers: np.ndarray, vec: str = "embedding",
                   label: str = "label", dist: str = "distance") -> DataFrame:
    """Nearest centroid of every row by Euclidean distance (ties -> lowest index).

    The centroid matrix is shipped in pieces of at most ``MAX_BROADCAST_VALUES``
    numbers, one after the other (one piece for any usual k), and each row keeps
    its best so far. Distances come from one matrix product per Arrow batch; the
    winner's is recomputed by difference.
    """
    centers = np.asarray(centers, dtype=np.float64)
    step = max(1, MAX_BROADCAST_VALUES // max(1, centers.shape[1]))
    for at in range(0, len(centers), step):
        df = _assign_piece(df, centers[at:at + step], at, vec, label, dist)
    return df


def _assign_piece(df: DataFrame, centers: np.ndarray, first: int, vec: str, label: str, dist: str) -> DataFrame:
    bc = df.sparkSession.sparkContext.broadcast(centers)
    fields = [f for f in df.schema.fields if not first or f.name not in (label, dist)]
    schema = T.StructType(fields + [T.StructField(label, T.IntegerType()), T.StructField(dist, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                yield pdf.assign(**{label: pd.Series([], dtype="int32"), dist: pd.Series([], dtype="float64")})
                continue
            idx, best = nearest(np.stack(pdf[vec].to_numpy()).astype(np.float64), bc.value)
            idx = idx.astype(np.int32) + np.int32(first)
            if first:
                kept = pdf[dist].to_numpy() <= best
                idx, best = np.where(kept, pdf[label].to_numpy(), idx), np.where(kept, pdf[dist].to_numpy(), best)
            yield pdf.assign(**{label: idx.astype(np.int32), dist: best})

    return df.mapInPandas(run, schema).select(*schema.names)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and distance to the nearest row of ``c`` for each row of ``x``."""
    d2 = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2.0 * (x @ c.T)
    idx = d2.argmin(axis=1)
    return idx, np.sqrt(((x - c[idx]) ** 2).sum(axis=1))


def canonical_labels(assigned: DataFrame, id_col: str = "item_id", label: str = "label") -> DataFrame:
    """Renumber non-negative labels by (size desc, min item id); -1 stays -1.

    The ranking is a distributed sort of the per-label summary (a clustering may
    have as many labels as rows); the mapping goes back by a join on the label.
    """
    from clusterloom.operators.jobs import global_rank

    summary = (assigned.where(F.col(label) >= 0).groupBy(label)
               .agg(F.count("*").alias("_n"), F.min(id_col).alias("_min_id")))
    ranked = global_rank(summary, [F.desc("_n"), F.asc("_min_id")], "_new")
    return (assigned.join(ranked.select(label, (F.col("_new") - 1).cast("int").alias("_new")), label, "left")
            .withColumn(label, F.coalesce(F.col("_new"), F.lit(-1)).cast("int")).drop("_new"))


def _plus_plus(x: np.ndarray, k: int, rng: np.random.Generator, weight: np.ndarray | None = None) -> np.ndarray:
    """k-means++ over (weighted) candidate rows; fewer than k where the candidates are fewer."""
    w = np.ones(len(x)) if weight is None else weight
    chosen = [int(rng.choice(len(x), p=w / w.sum()))]
    d2 = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    left = np.ones(len(x), bool)
    left[chosen[0]] = False
    while len(chosen) < min(k, len(x)):
        p = np.where(left, w * d2, 0.0)
        nxt = int(rng.choice(len(x), p=p / p.sum())) if p.sum() > 0 else int(np.flatnonzero(left)[0])
        chosen.append(nxt)
        left[nxt] = False
        d2 = np.minimum(d2, ((x - x[nxt]) ** 2).sum(axis=1))
    return x[chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _packed(pts: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """``_g, _id, _vec`` as matrices ``g, u, x`` (bytes): one row for each Arrow batch, its vectors sorted by group.

    Rows are dealt to tasks, and ordered, by a seeded hash of the id, so that every core has its share whatever
    the files of ``pts`` are. ``u`` holds a hash of the id for each round of ``_far_rows``. Also returns how many tasks.
    """
    n, width = pts.count(), pts.select(F.size("_vec")).first()
    values = n * max(1, width[0]) if width else 0
    tasks = max(1, min(-(-values // LEAST_TASK_VALUES),
                       max(pts.sparkSession.sparkContext.defaultParallelism, -(-values // TASK_VALUES))))
    rows = (pts.select(F.col("_g").cast("int").alias("_g"), "_id", F.col("_vec").cast("array<double>").alias("_vec"),
                       F.xxhash64("_id", F.lit(seed)).alias("_h"))
            .repartition(tasks, "_h").sortWithinPartitions("_h", "_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch) == 0:
                continue
            length = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            if batch.column(1).null_count or (length != length[0]).any():
                raise ValueError("vectors are null or not all of one length")
            g, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            u = batch.column(2).flatten().to_numpy().reshape(len(g), SEED_ROUNDS)
            order = np.argsort(g, kind="stable")
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[order].tobytes()], pa.binary()) for m in (g, u, x)], ["g", "u", "x"])

    hashes = F.array(*(F.xxhash64("_id", F.lit(seed + 1 + r)) for r in range(SEED_ROUNDS)))
    return rows.select("_g", "_vec", hashes).mapInArrow(run, "g binary, u binary, x binary"), tasks


def _blocks(batches: Iterator[pa.RecordBatch], first: str = "g", kind: type = np.int32
            ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups (or hashes) and vectors of every row of ``_packed``."""
    for batch in batches:
        for f, x in zip(batch.column(first), batch.column("x")):
            f = np.frombuffer(f.as_buffer(), kind)
            n = len(f) if first == "g" else len(f) // SEED_ROUNDS
            yield f if first == "g" else f.reshape(n, SEED_ROUNDS), np.frombuffer(x.as_buffer(), np.float64).reshape(n, -1)


def _pieces(g: np.ndarray, rows: int) -> Iterator[tuple[int, slice]]:
    """Runs of at most ``rows`` rows of one group; ``g`` is sorted."""
    groups, first = np.unique(g, return_index=True)
    for one, at, end in zip(groups.tolist(), first.tolist(), [*first[1:].tolist(), len(g)]):
        for start in range(at, end, rows):
            yield one, slice(start, min(start + rows, end))


def _far_rows(blocks: DataFrame, candidates: list[np.ndarray], take: list[int], r: int) -> list[np.ndarray]:
    """For each set of candidates ``take`` rows drawn without replacement with weights by the squared distance to the nearest.

    Weighted sampling by keys log(u) / weight with u from a seeded hash of the id: each task keeps its best
    ``take`` rows, and the best of all are the sample. One job, and the same rows when a task runs again.
    """
    bc = blocks.sparkSession.sparkContext.broadcast(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0), np.zeros((0, c.shape[1]))) for c in bc.value]
        for hashes, x in _blocks(batches, "u", np.uint64):
            log_u = np.log(np.maximum((hashes[:, r] >> np.uint64(11)).astype(np.float64) / 2.0 ** 53, 1e-300))
            for at in range(0, len(x), PIECE_ROWS):
                piece, log_piece = x[at:at + PIECE_ROWS], log_u[at:at + PIECE_ROWS]
                for s, c in enumerate(bc.value):
                    d2 = nearest(piece, c)[1] ** 2
                    far = np.flatnonzero(d2 > 0)
                    keys = np.concatenate([kept[s][0], log_piece[far] / d2[far]])
                    rows = np.concatenate([kept[s][1], piece[far]])
                    best = np.argsort(-keys, kind="stable")[:take[s]]
                    kept[s] = keys[best], rows[best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(kept), dtype=np.int32), [len(k) for k, _ in kept])),
             pa.array(np.concatenate([k for k, _ in kept])),
             pa.array([row for _, rows in kept for row in rows.tolist()], pa.list_(pa.float64()))], ["s", "key", "x"])

    best_first = Window.partitionBy("s").orderBy(F.desc("key"), "x")
    drawn = (blocks.select("u", "x").mapInArrow(run, "s int, key double, x array<double>").withColumn("at", F.row_number().over(best_first))
             .where(F.col("at") <= F.element_at(F.array(*map(F.lit, take)), F.col("s") + 1)).collect())
    bc.unpersist()
    found: list[list] = [[] for _ in candidates]
    for row in sorted(drawn, key=lambda row: (row.s, row.at)):
        found[row.s].append(row.x)
    return [np.array(rows, np.float64).reshape(len(rows), c.shape[1]) for rows, c in zip(found, candidates)]


def _weights(blocks: DataFrame, candidates: list[np.ndarray]) -> list[np.ndarray]:
    """How many rows are nearest to each candidate of each set."""
    bc = blocks.sparkSession.sparkContext.broadcast(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(c), np.int64) for c in bc.value]
        for _, x in _blocks(batches):
            for at in range(0, len(x), PIECE_ROWS):
                for n, c in zip(total, bc.value):
                    n += np.bincount(nearest(x[at:at + PIECE_ROWS], c)[0], minlength=len(n))
        for s, n in enumerate(total):
            near = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), s, np.int32)), pa.array(near), pa.array(n[near])],
                                             ["s", "j", "n"])

    out = [np.zeros(len(c)) for c in candidates]
    for s, j, n in blocks.select("g", "x").mapInArrow(run, "s int, j long, n long").groupBy("s", "j").agg(F.sum("n")).collect():
        out[s][j] = n
    bc.unpersist()
    return out


def _seeded(pts: DataFrame, blocks: DataFrame, ks: list[int], n_init: int, seed: int) -> list[list[np.ndarray]]:
    """k-means|| for each of ``ks``, all in the same jobs; ``blocks`` are the rows of ``pts`` packed."""
    order = pts.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").select("_vec")
    first = np.array([r[0] for r in order.limit(1).collect()], np.float64)
    candidates = [first] * len(ks)
    for r in range(SEED_ROUNDS):
        far = _far_rows(blocks, candidates, [max(OVERSAMPLING * k, 1) for k in ks], r)
        if not any(map(len, far)):
            break
        candidates = [np.vstack(both) for both in zip(candidates, far)]
    if any(len(c) < k for c, k in zip(candidates, ks)):
        more = np.array([r[0] for r in order.limit(max(ks)).collect()], np.float64)
        candidates = [np.vstack([c, more[:k]])[:k] if len(c) < k else c for c, k in zip(candidates, ks)]
    return [[_plus_plus(c, k, np.random.default_rng([seed, r]), np.maximum(w, 1e-9)) for r in range(max(1, n_init))]
            for c, k, w in zip(candidates, ks, _weights(blocks, candidates))]


def first_centers(pts: DataFrame, k: int, n_init: int, seed: int) -> list[np.ndarray]:
    """k-means||: ``n_init`` sets of k first centres from all rows of ``pts`` (``_id, _vec``).

    Candidates number at most 1 + SEED_ROUNDS x OVERSAMPLING x k; where the rows have fewer different vectors
    than k, equal ones fill up.
    """
    return _seeded(pts, _packed(pts.withColumn("_g", F.lit(0)), seed)[0], [k], n_init, seed)[0]


def _group_centers(pts: DataFrame, blocks: DataFrame, k: int, n_init: int, seed: int) -> dict[int, list[np.ndarray]]:
    """First centres of every group: k-means|| for one group, k-means++ on hashed candidates for many."""
    from clusterloom.operators.topn import top_n_per_group

    groups = [r[0] for r in pts.select("_g").distinct().limit(2).collect()]
    if len(groups) == 1:
        return {int(groups[0]): _seeded(pts, blocks, [k], n_init, seed)[0]}
    # candidates for the first centres only: the rows with the smallest seeded hashes of each group
    order = F.xxhash64("_id", F.lit(seed))
    first = top_n_per_group(pts.withColumn("_h", order), ["_g"], [F.asc("_h"), F.asc("_id")],
                            max(k * CANDIDATES_PER_CENTRE, k), ["_id"]).select("_g", "_h", "_id", "_vec").toPandas()
    out: dict[int, list] = {}
    for g, own in first.sort_values(["_g", "_h", "_id"]).groupby("_g"):
        x = np.stack(own["_vec"].to_numpy()).astype(np.float64)
        out[int(g)] = [_plus_plus(x, k, np.random.default_rng([seed, r])) for r in range(max(1, n_init))]
    return out


def _stacks(sets: list[np.ndarray | None]) -> list[tuple[tuple[int, ...], np.ndarray]]:
    """Sets of centres with as many centres as one array (sets, k, numbers), with their places in ``sets``; None is left out."""
    by: dict[int, list[int]] = {}
    for r, c in enumerate(sets):
        if c is not None:
            by.setdefault(len(c), []).append(r)
    return [(tuple(rs), np.stack([sets[r] for r in rs])) for rs in by.values()]


def _tally(total: dict, key: tuple, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Add rows to their nearest centres in each set of ``c`` (sets, k, numbers): rows, vector sum, squared
    distances, and the farthest row. Returns how many rows each centre took and their sum.
    """
    sets, k, width = c.shape
    flat = c.reshape(sets * k, width)
    near = (flat @ x.T).reshape(sets, k, len(x))  # |c|^2 - 2 c x: the squared distance without |x|^2
    near *= -2.0
    near += (c * c).sum(axis=2)[:, :, None]
    least, idx = near[:, 0].copy(), np.zeros((sets, len(x)), np.intp)
    for j in range(1, k):
        np.copyto(idx, j, where=near[:, j] < least)
        np.minimum(least, near[:, j], out=least)
    idx += np.arange(sets)[:, None] * k
    d2 = np.maximum(least + (x * x).sum(axis=1), 0.0).ravel()
    idx = idx.ravel()
    row = np.tile(np.arange(len(x)), sets)
    took = near.reshape(sets * k, len(x))
    took.fill(0.0)
    took[idx, row] = 1.0
    n, s = np.bincount(idx, minlength=sets * k), took @ x
    if key not in total:
        total[key] = [np.zeros(sets * k, np.int64), np.zeros(flat.shape), np.zeros(sets * k), np.full(sets * k, -1.0), np.zeros(flat.shape)]
    all_n, all_s, cost, far_d, far = total[key]
    all_n += n
    all_s += s
    cost += np.bincount(idx, d2, minlength=sets * k)
    most = np.full(sets * k, -1.0)
    np.maximum.at(most, idx, d2)
    at = np.flatnonzero(d2 == most[idx])[::-1]
    top = np.zeros(sets * k, np.intp)
    top[idx[at]] = row[at]
    d = np.where(n > 0, np.sqrt(((x[top] - flat) ** 2).sum(axis=1)), -1.0)
    farther = np.flatnonzero(d > far_d)
    far_d[farther], far[farther] = d[farther], x[top[farther]]
    return n.reshape(sets, k), s.reshape(c.shape)


def _tallied(total: dict) -> pa.RecordBatch:
    """What ``_tally`` added up, one row for each group, set and label that took rows."""
    rows = [(g, rs[at // (len(n) // len(rs))], at % (len(n) // len(rs)), n[at], s[at].tolist(), cost[at], far_d[at], far[at].tolist())
            for (g, rs), (n, s, cost, far_d, far) in total.items() for at in np.flatnonzero(n).tolist()]
    types = [pa.int32()] * 3 + [pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], t) for i, t in enumerate(types)],
                                      ["g", "r", "j", "n", "s", "cost", "far_d", "far"])


def _sums(batches: Iterator[pa.RecordBatch], centers: dict[int, list[np.ndarray | None]]
          ) -> Iterator[pa.RecordBatch]:
    """Per group, restart and label: rows, vector sum, squared distances, and the farthest row."""
    total: dict = {}
    stacks: dict[int, list] = {}
    for g, x in _blocks(batches):
        for one, at in _pieces(g, PIECE_ROWS):
            if one not in stacks:
                stacks[one] = _stacks(centers[one])
            for rs, c in stacks[one]:
                step = max(1, PIECE_VALUES // (c.shape[0] * c.shape[1]))
                for start in range(at.start, at.stop, step):
                    _tally(total, (one, rs), x[start:min(start + step, at.stop)], c)
    yield _tallied(total)


_SUMS = "g int, r int, j int, n long, s array<double>, cost double, far_d double, far array<double>"


def _combined() -> list:
    """Aggregates that put the tasks' sums together."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    return [F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector(F.col("s")))).alias("s"),
            F.sum("cost").alias("cost"), F.max("far_d").alias("far_d"), F.max_by("far", "far_d").alias("far")]


class _Sum(NamedTuple):
    g: int
    r: int
    j: int
    n: int
    s: np.ndarray
    cost: float
    far_d: float
    far: np.ndarray


def _pass(blocks: DataFrame, tasks: int, state: dict, work, *more) -> dict[tuple[int, int], list]:
    """One job over all rows: what ``work`` adds up by group, restart and label, put together and listed by (group, restart).

    What the tasks return is added up here while it is at most MAX_RETURNED_VALUES numbers, otherwise in Spark.
    """
    bc = blocks.sparkSession.sparkContext.broadcast(state)
    sums = blocks.select("g", "x").mapInArrow(lambda batches: work(batches, bc.value, *more), _SUMS)
    arrays = [a for sets in state.values() for c in sets if c is not None for a in (c if isinstance(c, tuple) else (c,))]
    if 2 * tasks * sum(a.size for a in arrays) > MAX_RETURNED_VALUES:
        sums = sums.groupBy("g", "r", "j").agg(*_combined())
    found: dict[tuple[int, int, int], _Sum] = {}
    for row in sums.collect():
        new = _Sum(row.g, row.r, row.j, row.n, np.asarray(row.s), row.cost, row.far_d, np.asarray(row.far))
        old = found.get(new[:3])
        if old:
            far = max(old, new, key=lambda x: x.far_d)
            new = _Sum(*new[:3], old.n + new.n, old.s + new.s, old.cost + new.cost, far.far_d, far.far)
        found[new[:3]] = new
    bc.unpersist()
    by: dict[tuple[int, int], list] = {}
    for key in sorted(found):
        by.setdefault(key[:2], []).append(found[key])
    return by


def _advance(blocks: DataFrame, tasks: int, centers: dict[int, list[np.ndarray]], max_iter: int, tol: float
             ) -> tuple[dict, dict]:
    """Lloyd iterations on every set of centres in ``centers`` (changed in place); costs and iterations by (group, set)."""
    cost = {(g, r): np.inf for g in centers for r in range(len(centers[g]))}
    going, iterations = set(cost), {key: 0 for key in cost}
    for _ in range(max_iter):
        if not going:
            break
        live = {g: [c if (g, r) in going else None for r, c in enumerate(rs)] for g, rs in centers.items()}
        for (g, r), found in _pass(blocks, tasks, live, _sums).items():
            old = centers[g][r]
            new = old.copy()
            for row in found:
                new[row.j] = row.s / row.n
            empty = sorted(set(range(len(old))) - {row.j for row in found})
            for j, row in zip(empty, sorted(found, key=lambda x: -x.far_d)):
                new[j] = row.far
            centers[g][r], cost[g, r] = new, sum(row.cost for row in found)
            iterations[g, r] += 1
            if np.sqrt(((new - old) ** 2).sum(axis=1)).max() < max(tol, 1e-12):
                going.discard((g, r))
    return cost, iterations


def lloyd(pts: DataFrame, k: int, n_init: int, max_iter: int, tol: float, seed: int) -> tuple[dict[int, np.ndarray], dict]:
    """Lloyd iterations for every group and restart at once: the best centres of each group.

    ``pts``: ``_g int, _id, _vec``. One job per iteration, whatever the number of
    groups and restarts: tasks return partial sums by (group, restart, label), which
    are combined in Spark and come to the driver (groups x restarts x k rows). A
    restart stops once none of its centres moves by ``tol`` or more. A centre
    without rows moves to the farthest row.
    """
    blocks, tasks = _packed(pts, seed)
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    centers: dict[int, list] = _group_centers(pts, blocks, k, n_init, seed)
    cost, iterations = _advance(blocks, tasks, centers, max_iter, tol)
    blocks.unpersist()
    best = {g: min(range(len(rs)), key=lambda r, g=g: (cost[g, r], r)) for g, rs in centers.items()}
    return ({g: centers[g][best[g]] for g in centers},
            {g: {"iterations": iterations[g, best[g]], "cost": cost[g, best[g]]} for g in centers})


def assign_groups(df: DataFrame, centers: dict[int, np.ndarray], vec: str = "embedding", group: str = "_g") -> DataFrame:
    """J3 inside each group: ``label`` counts through the groups' centres, ``distance`` to the nearest own one."""
    offsets, at = {}, 0
    for g in sorted(centers):
        offsets[g], at = at, at + len(centers[g])
    bc = df.sparkSession.sparkContext.broadcast((centers, offsets))
    schema = T.StructType(df.schema.fields + [T.StructField("label", T.IntegerType()),
                                               T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_centers, first = bc.value
        for batch in batches:
            label, distance = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            x, groups = _matrix(batch.column(vec)), batch.column(group).to_numpy()
            order = np.argsort(groups, kind="stable")
            for g, piece in _pieces(groups[order], PIECE_ROWS):
                at = order[piece]
                idx, distance[at] = nearest(x[at], all_centers[g])
                label[at] = idx + first[g]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label), pa.array(distance)], schema.names)

    return df.mapInArrow(run, schema)


def kmeans(df: DataFrame, k: int = 50, n_init: int = 10, max_iter: int = 300, tol: float = 1e-4,
           seed: int = 42, vec: str = "embedding", id_col: str = "item_id", group: str | None = None
           ) -> tuple[DataFrame, dict]:
    """Lloyd K-Means, best of ``n_init`` seeds by inertia, exactly min(k, n) labels.

    Returns (assignments with ``label, distance``, info dict with k, inertia,
    iterations and n). With ``group`` (an int column) every group is clustered on
    its own, in the same jobs; labels are unique over all groups.
    """
    base = cut_lineage(df if group else df.withColumn("_g", F.lit(0)))
    g = group or "_g"
    n = base.count()
    if n == 0:
        raise ValueError("cannot cluster an empty vector set")
    pts = base.select(F.col(g).alias("_g"), F.col(id_col).alias("_id"), F.col(vec).alias("_vec"))
    centers, runs = lloyd(pts, max(1, min(int(k), n)), n_init, max_iter, tol, seed)
    assigned = cut_lineage(assign_groups(base, centers, vec, g))
    if group is None:
        assigned = assigned.drop("_g")
    inertia = assigned.agg(F.sum(F.col("distance") * F.col("distance"))).first()[0]
    info = {"k": sum(map(len, centers.values())), "inertia": float(inertia), "n": n,
            "iterations": max(r["iterations"] for r in runs.values())}
    return canonical_labels(assigned, id_col), info


def lloyd_step(df: DataFrame, centroids: DataFrame, vec: str = "embedding",
               label: str = "label", id_col: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """One Lloyd iteration from given centroids: assign to the nearest, recompute means.

    ``centroids``: ``label int, centroid array<double>`` with k rows (k-sized, so
    it is collected and broadcast); returns (assignments, new centroids).
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = centroids.orderBy(label).select(label, "centroid").collect()
    labels = np.asarray([r[0] for r in rows], dtype=np.int32)
    centers = np.asarray([r[1] for r in rows], dtype=np.float64)
    idx = assign_nearest(df.select(id_col, vec), centers, vec, label="_idx")
    mapping = df.sparkSession.createDataFrame(
        [(int(i), int(l)) for i, l in enumerate(labels)], "_idx int, " + label + " int")
    assigned = idx.join(mapping, "_idx").drop("_idx")
    new = assigned.groupBy(label).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias("centroid"),
        F.count("*").alias("size"))
    return assigned, new


def _mini_batches(batches: Iterator[pa.RecordBatch], state: dict[int, list[tuple[np.ndarray, np.ndarray]]],
                  batch_size: int) -> Iterator[pa.RecordBatch]:
    """One task's pass: its rows in mini-batches, each of which moves the task's own copy of the centres.

    Returns per group, restart and label what the rows it took sum up to, their squared distances, and the farthest.
    """
    own: dict[int, list] = {}
    total: dict = {}
    for groups, x in _blocks(batches):
        for g, at in _pieces(groups, batch_size):
            if g not in own:
                own[g] = [(rs, c, np.stack([state[g][r][1] for r in rs])) for rs, c in _stacks([c for c, _ in state[g]])]
            for rs, c, counts in own[g]:
                n, s = _tally(total, (g, rs), x[at], c)
                counts += n
                c += (s - n[:, :, None] * c) / np.maximum(counts, 1)[:, :, None]
    yield _tallied(total)


def _merge_pass(center: np.ndarray, counts: np.ndarray, rows: list, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres and counts after a pass, from all tasks' sums: the mean of the rows taken, older rows weighing less."""
    center, counts = center.copy(), counts * FORGET
    for r in rows:
        counts[r.j] += r.n
        center[r.j] += (r.s - r.n * center[r.j]) / counts[r.j]
    low = np.flatnonzero(counts < ratio * counts.max()) if ratio > 0 else np.flatnonzero(counts == 0)
    for j, r in zip(low.tolist(), sorted((r for r in rows if r.far_d > 0), key=lambda r: (-r.far_d, r.j))):
        center[j], counts[j] = r.far, 0.0
    return center, counts


def minibatch_kmeans(df: DataFrame, k: int = 50, batch_size: int = 1024, max_iter: int = 100,
                     seed: int = 42, reassignment_ratio: float = 0.01, vec: str = "embedding",
                     id_col: str = "item_id", tol: float = 0.0, n_init: int = 3, group: str | None = None
                     ) -> tuple[DataFrame, dict]:
    """Mini-batch K-Means, one Spark job for each pass over all rows.

    Rows are dealt to partitions and ordered by a seeded hash of the id, once. In a pass every task takes the
    centres and goes through its rows in batches of ``batch_size``: assign to the nearest, then
    c <- c + (sum - n c) / N_c with the rows N_c that the centre has taken so far (Sculley 2010). What the tasks'
    rows add up to by label is merged by counts, so that a centre is the mean of the rows it took, those of earlier
    passes at half weight for each pass since. All ``n_init`` restarts go through a pass together. Centres whose count is below ``reassignment_ratio`` times the
    largest move to the farthest rows.

    ``max_iter`` counts passes; a pass that moves no centre by ``tol`` (or at all) is the last. First centres come
    from k-means||. With ``group`` (an int column) every group is clustered on its own, in the same
    jobs. Final labels come from one assignment of all rows.
    """
    base = cut_lineage(df if group else df.withColumn("_g", F.lit(0)))
    g_col = group or "_g"
    n = base.count()
    if n == 0:
        raise ValueError("cannot cluster an empty vector set")
    k = max(1, min(int(k), n))
    pts = base.select(F.col(g_col).alias("_g"), F.col(id_col).alias("_id"), F.col(vec).alias("_vec"))
    blocks, tasks = _packed(pts, seed)
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    state = {g: [(c, np.zeros(len(c))) for c in sets] for g, sets in _group_centers(pts, blocks, k, n_init, seed).items()}
    for it in range(max_iter):
        found = _pass(blocks, tasks, state, _mini_batches, int(batch_size))
        after = {g: [_merge_pass(c, counts, found.get((g, r), []), reassignment_ratio)
                     for r, (c, counts) in enumerate(sets)] for g, sets in state.items()}
        moved = max(np.abs(new[0] - old[0]).max() for g in state for new, old in zip(after[g], state[g]))
        state = after
        if moved < max(tol, 1e-12):
            break
    blocks.unpersist()
    # the restart whose rows lay closest to its centres in the last pass
    centers = {g: sets[min(range(len(sets)), key=lambda r, g=g: (sum(x.cost for x in found.get((g, r), [])), r))][0]
               for g, sets in state.items()}
    assigned = cut_lineage(assign_groups(base, centers, vec, g_col))
    if group is None:
        assigned = assigned.drop("_g")
    inertia = assigned.agg(F.sum(F.col("distance") * F.col("distance"))).first()[0]
    return canonical_labels(assigned, id_col), {"k": sum(map(len, centers.values())), "inertia": float(inertia),
                                                "iterations": it + 1, "n": n}


def estimate_k(df: DataFrame, min_k: int = 2, max_k: int = 100, sample_size: int | None = None,
               seed: int = 42, vec: str = "embedding", id_col: str = "item_id") -> tuple[int, list]:
    """Elbow method on all rows, or on a seeded hash sample (W9) where ``sample_size`` is given."""
    from clusterloom.operators.jobs import sample_rows

    sample = (df if sample_size is None else sample_rows(df, sample_size, seed, id_col)).persist(
        StorageLevel.MEMORY_AND_DISK)
    n = sample.count()
    max_k = min(max_k, n - 1)
    if max_k < min_k:
        return max(1, min(min_k, n)), []
    step = max(1, (max_k - min_k) // 10)
    grid = list(range(min_k, max_k + 1, step))
    pts = cut_lineage(sample.select(F.lit(0).alias("_g"), F.col(id_col).alias("_id"), F.col(vec).alias("_vec")))
    sample.unpersist()
    # every k and restart is a set of centres that goes through the same jobs
    blocks, tasks = _packed(pts, seed)
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    sets = {0: [c for starts in _seeded(pts, blocks, grid, 3, seed) for c in starts]}
    cost, _ = _advance(blocks, tasks, sets, 100, 1e-4)
    best = [min(range(3 * i, 3 * i + 3), key=lambda r: (cost[0, r], r)) for i in range(len(grid))]
    last = _pass(blocks, tasks, {0: [sets[0][r] for r in best]}, _sums)
    blocks.unpersist()
    costs = [(kk, float(sum(row.cost for row in last[0, i]))) for i, kk in enumerate(grid)]
    if len(costs) <= 2:
        return costs[len(costs) // 2][0], costs
    c = np.asarray([x[1] for x in costs])
    second = np.diff(c, 2)
    return costs[int(np.argmax(second)) + 1][0], costs


def incremental_assign(new: DataFrame, centroids: DataFrame, max_distance: float | None = None,
                       vec: str = "embedding", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Add new items to existing clusters and update sizes and centroids.

    ``centroids``: ``label, centroid, size`` (k rows, broadcast as a bounded
    matrix). A new item joins its nearest centroid unless it is farther than
    ``max_distance`` (then -1). Updated centroid = (n c + sum of new) / (n + m),
    from one partial aggregate of the new rows per label.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = centroids.orderBy(label).select(label, "centroid", "size").collect()
    labels = [int(r[0]) for r in rows]
    centers = np.asarray([r[1] for r in rows], dtype=np.float64)
    idx = assign_nearest(new, centers, vec, label="_idx")
    mapping = new.sparkSession.createDataFrame([(i, l) for i, l in enumerate(labels)], f"_idx int, {label} int")
    assigned = idx.join(mapping, "_idx").drop("_idx")
    if max_distance is not None:
        assigned = assigned.withColumn(label, F.when(F.col("distance") <= F.lit(float(max_distance)),
                                                     F.col(label)).otherwise(F.lit(-1)))
    add = assigned.where(F.col(label) >= 0).groupBy(label).agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col(vec)))).alias("_s"), F.count("*").alias("_m"))
    upd = (centroids.join(add, label, "left")
           .withColumn("_m", F.coalesce("_m", F.lit(0)))
           .withColumn("centroid", F.when(F.col("_m") > 0, F.zip_with(
               "centroid", "_s", lambda c, s: (c * F.col("size") + s) / (F.col("size") + F.col("_m"))))
               .otherwise(F.col("centroid")))
           .withColumn("size", F.col("size") + F.col("_m")).drop("_s", "_m"))
    return assigned, upd
