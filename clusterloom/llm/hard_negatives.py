"""Hard-negative mining over shared candidate lists of anchor clusters, after MAXIMUS (Abuzaid et al., 2019).

Anchors are clustered by direction (``LIST_MEMBERS`` or more to a cluster on average), and a
cluster is cut into rings by the members' angle to the centroid, where they are many. For a ring with angles from ``low`` to ``high``, a row i at angle t from the
centroid scores at most ``|u| * |i| * cos(gap)`` with any member u, where ``gap`` is how far t
lies outside ``[low, high]`` (triangle inequality on the sphere). ``|i| * cos(gap)`` orders one
list of all rows for the ring. Every member walks its ring's list from the top and stops
when what is left can't enter its result any more: its last place is taken by a score above
the bound of the rest, or the bound lies below the lowest score it may take.

On Spark a list is never one group. A pass over the rows counts the bounds of each list
in ``BINS`` bins; the walk goes through windows of bins, ``FIRST_WINDOW`` rows at first and
``GROWTH`` times as many each time, so a list has logarithmically many. In a window, only rows
of lists with members still walking are sent out, dealt to pieces of at most ``PIECE`` rows
(many rows at one bound, as copies have, are more pieces); a task sorts its piece by the
bound and walks it with at most ``MEMBERS`` members. A round ends with each walker's best
so far, which is written and read back. Lists hold no rows that nobody walked to.

Two walks: first for positives (same label), whose scores set the ranges of the second one,
for negatives (another label). The work is at most anchors x rows; how much of it the bounds
save depends on how far apart the clusters lie.

Scores are exact: vectors become whole numbers, products are taken in double precision where
2**53 is out of reach, in Python integers beyond; scores beyond 64 bits raise an error.

Defined results: rows with a null id, label or vector, or any null or non-finite component take
no part; equal rows (id, label, vector) are one row; rows that repeat an id otherwise are rows of
their own, each of them an anchor if the id is divisible by ``every``; rows of different vector
lengths don't meet; all scores with a zero or empty vector are 0; ties go by the smaller
id; empty tables give no rows; only the id, label and vector columns are read. The centroids
are fit on at most ``SAMPLE`` anchors; they steer the work and never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.session import cut_lineage, number_rows

CLUSTERS, SAMPLE = 16, 4096
LIST_MEMBERS = 512  # a list costs a copy of the rows walked, so it has this many members if there are so many
RING = 0.15  # radians
BINS = 1024
FIRST_WINDOW, GROWTH = 16384, 8
PIECE, MEMBERS, STEP = 4096, 1024, 512
SLACK = 1e-6  # radians, against rounding of angles
LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1  # scores without a limit


# ------------------------------------------------------------------ vectors

def integral_rows(rows: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int = 256,
                  shift: tuple[int, int] | None = (7, 10)) -> DataFrame:
    """``_row, _id, _label, _x`` (array of whole doubles): the rows that take part, each once.

    ``shift`` (m, classes): where the id is divisible by m, the label becomes (label + 1) modulo classes.
    """
    vec = F.col("_vec")
    sound = (F.col("_id").isNotNull() & F.col("_label").isNotNull() & vec.isNotNull()
             & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    label = F.col("_label")
    if shift:
        label = F.when(F.col("_id") % shift[0] == 0, (label + 1) % shift[1]).otherwise(label)
    good = (rows.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("_label"),
                        F.col(vec_col).cast("array<double>").alias("_vec")).where(sound)
            .select("_id", label.alias("_label"),
                    F.transform("_vec", lambda v: F.floor(v * scale).cast("double")).alias("_x")))
    return number_rows(good.distinct(), "_row")


def _stack(column: pa.Array) -> np.ndarray:
    """A list column of rows with one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def _pack(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([row.tobytes() for row in x.astype(kind)], pa.binary())


def _unpack(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products (64 bits) of whole-numbered rows."""
    top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if top < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    left, right = ([list(map(int, row)) for row in m.tolist()] for m in (a, b))
    return np.array([[sum(map(int.__mul__, x, y)) for y in right] for x in left], np.int64).reshape(len(a), len(b))


# ------------------------------------------------------------------ lists

class List(NamedTuple):
    """One candidate list: rows of ``dim`` values around ``centre``, for members at angles ``low`` to ``high``."""

    dim: int
    centre: int
    low: float
    high: float
    members: int


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero stays zero) and lengths."""
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1.0)[:, None], norm


def centroids(x: np.ndarray, k: int, seed: int = 0, rounds: int = 10) -> np.ndarray:
    """Spherical k-means on a sample; at least one centroid of length one."""
    x = directions(x)[0]
    x = x[(x != 0).any(axis=1)]
    dim = x.shape[1]
    if len(x) == 0:
        return np.eye(1, dim)
    rng = np.random.default_rng(seed)
    c = x[[int(rng.integers(len(x)))]]
    for _ in range(min(k, len(x)) - 1):  # the next one is far from all so far
        far = np.maximum(1.0 - (x @ c.T).max(axis=1), 0.0)
        if far.sum() <= 1e-9:
            break
        c = np.vstack([c, x[rng.choice(len(x), p=far / far.sum())]])
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        c = np.where((norm > 0)[:, None], sums / np.where(norm > 0, norm, 1.0)[:, None], c)
    return c


def angles(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles to all centroids (0 for zero vectors) and lengths."""
    unit, norm = directions(x)
    t = np.arccos(np.clip(unit @ centres.T, -1.0, 1.0))
    t[norm == 0] = 0.0
    return t, norm


def bounds(t: np.ndarray, norm: np.ndarray, low: float, high: float) -> np.ndarray:
    """At most so much, times a member's length, is the score of a row at angle ``t`` with any member."""
    gap = np.maximum(np.maximum(t - high, low - t) - SLACK, 0.0)
    return norm * np.cos(gap) + 1e-9 * norm


class Plan(NamedTuple):
    """What the tasks need: centroids by dimension, the lists, the longest row of each dimension, and the bins."""

    centres: dict[int, np.ndarray]
    lists: list[List]
    longest: dict[int, float]
    n_bins: int

    def kind(self, dim: int) -> str:
        """The smallest type that holds the whole numbers of all rows with ``dim`` values."""
        return next((k for k in ("<i2", "<i4") if self.longest[dim] < np.iinfo(k).max), "<f8")

    def bins(self, bound: np.ndarray, dim: int) -> np.ndarray:
        """Bins from the highest bound (0) down."""
        top = self.longest[dim] * (1 + 1e-8) or 1.0
        return np.clip(((top - bound) / (2 * top) * self.n_bins).astype(np.int64), 0, self.n_bins - 1)

    def ceiling(self, dim: int, first: int) -> float:
        """No bound in bin ``first`` or later is above."""
        top = self.longest[dim] * (1 + 1e-8) or 1.0
        return top - 2 * top * first / self.n_bins + 1e-9 * top


def _by_dim(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places, matrix) of the rows of each vector length of a batch."""
    sizes = pa.compute.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, _stack(batch.column(column).take(pa.array(at)))


def plan_lists(base: DataFrame, anchors: DataFrame, clusters: int, seed: int) -> tuple[Plan, DataFrame]:
    """The plan, and the anchors with their list: ``_row, _id, _label, _x`` (binary), ``_norm, _list``."""
    order = F.xxhash64("_row", F.lit(seed))
    sample = anchors.orderBy(order).limit(SAMPLE).select("_x").toPandas()["_x"]
    by_dim: dict[int, list] = {}
    for x in sample:
        by_dim.setdefault(len(x), []).append(np.asarray(x, np.float64))
    found = dict(anchors.groupBy(F.size("_x")).count().collect())  # a number per vector length
    centres = {d: centroids(np.array(by_dim[d]).reshape(len(by_dim[d]), d),
                            max(1, min(clusters, n // LIST_MEMBERS)), seed) if d in by_dim else np.eye(1, d)
               for d, n in found.items()}
    longest = {r[0]: r[1] for r in base.groupBy(F.size("_x")).agg(F.sqrt(F.max(F.aggregate(
        "_x", F.lit(0.0), lambda a, v: a + v * v)))).collect()}
    plan = Plan(centres, [], longest, BINS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _by_dim(batch, 3):
                t, norm = angles(x, centres[dim])
                near = t.argmin(axis=1)
                own = t[np.arange(len(t)), near]
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in range(3)), _pack(x, plan.kind(dim)), pa.array(norm), pa.array(own),
                     pa.array(np.full(len(at), dim, np.int32)), pa.array(near.astype(np.int32)),
                     pa.array((own / RING).astype(np.int32))],
                    ["_row", "_id", "_label", "_x", "_norm", "_angle", "_dim", "_centre", "_ring"])

    placed = cut_lineage(anchors.select("_row", "_id", "_label", "_x").mapInArrow(
        place, "_row long, _id long, _label long, _x binary, _norm double, _angle double, _dim int, _centre int, "
               "_ring int"))
    keys = ["_dim", "_centre", "_ring"]
    rings = placed.groupBy(*keys).agg(F.min("_angle"), F.max("_angle"), F.count("*")).orderBy(*keys).collect()
    lists: list[List] = []
    names = []
    for dim, centre, ring, low, high, n in rings:
        last = lists[-1] if lists else None
        if last and (last.dim, last.centre) == (dim, centre) and last.members < LIST_MEMBERS:
            lists[-1] = last._replace(high=high, members=last.members + n)  # with the ring inside it
        else:
            lists.append(List(dim, centre, low, high, n))
        names.append((dim, centre, ring, len(lists) - 1))
    members = placed.join(F.broadcast(base.sparkSession.createDataFrame(
        names, "_dim int, _centre int, _ring int, _list int")), keys).drop("_angle", *keys)
    return plan._replace(lists=lists), cut_lineage(members)


def count_bins(base: DataFrame, plan: Plan) -> np.ndarray:
    """Rows of each list by bin (lists x bins numbers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(plan.lists), plan.n_bins), np.int64)
        for batch in batches:
            for dim, _, x in _by_dim(batch, 0):
                if dim in plan.centres:
                    t, norm = angles(x, plan.centres[dim])
                    for k, own in enumerate(plan.lists):
                        if own.dim == dim:
                            bound = bounds(t[:, own.centre], norm, own.low, own.high)
                            total[k] += np.bincount(plan.bins(bound, dim), minlength=plan.n_bins)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)),
                                          pa.array(total[k, b])], ["k", "b", "n"])

    counts = np.zeros((len(plan.lists), plan.n_bins), np.int64)
    for k, b, n in (base.select("_x").mapInArrow(run, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n"))
                    .collect()):
        counts[k, b] = n
    return counts


# ------------------------------------------------------------------ walking

def _walk(plan: Plan, same_label: bool, top: int, step: int):
    """One piece of a list, walked by some of its members: their best ``top`` rows in it."""
    out = ["_walker", "_other", "_score"]

    def run(members: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if len(members) == 0 or len(rows) == 0:
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in out})
        rows = rows.sort_values("_bound", ascending=False, kind="stable")
        kind = plan.kind(plan.lists[int(members["_list"].iloc[0])].dim)
        y, bound = _unpack(rows["r_x"], kind), rows["_bound"].to_numpy()
        ids, labels, numbers = (rows[c].to_numpy(np.int64) for c in ("r_id", "r_label", "r_row"))
        # walkers of one anchor share its scores
        anchors, anchor = np.unique(members["_row"].to_numpy(), return_index=True)
        of = np.searchsorted(anchors, members["_row"].to_numpy())
        x = _unpack(members["_x"].iloc[anchor], kind)
        own = members["_label"].to_numpy(np.int64)[anchor]
        low, high, walker = (members[c].to_numpy(np.int64) for c in ("_low", "_high", "_walker"))
        least, norm = members["_least"].to_numpy(np.int64).copy(), members["_norm"].to_numpy()
        walking, found = np.arange(len(members)), []
        taken = [np.zeros(0, np.int64)] * 3  # walker's place, row's place, score
        for at in range(0, len(rows), step):
            rest = norm[walking] * bound[at]
            walking = walking[~((least[walking] > rest) | (low[walking] > rest))]
            if len(walking) == 0:
                break
            end = min(at + step, len(rows))
            live = np.unique(of[walking])
            score = products(x[live], y[at:end])
            fits = own[live][:, None] == labels[None, at:end] if same_label else own[live][:, None] != labels[None, at:end]
            fits &= anchors[live][:, None] != numbers[None, at:end]
            line = np.searchsorted(live, of[walking])
            s = score[line]
            good = fits[line] & (s >= low[walking][:, None]) & (s <= high[walking][:, None]) & (s >= least[walking][:, None])
            a, b = np.nonzero(good)
            taken = [np.concatenate(p) for p in zip(taken, (walking[a], at + b, s[a, b]))]
            order = np.lexsort((ids[taken[1]], -taken[2], taken[0]))
            taken = [t[order] for t in taken]
            rank = np.arange(len(order)) - np.searchsorted(taken[0], taken[0])
            taken = [t[rank < top] for t in taken]
            last = rank[rank < top] == top - 1
            least[taken[0][last]] = np.maximum(least[taken[0][last]], taken[2][last])
        return pd.DataFrame({"_walker": walker[taken[0]], "_other": ids[taken[1]], "_score": taken[2]})
    return run


def _rows_of_window(base: DataFrame, plan: Plan, window: dict[int, tuple[int, int]], counts: np.ndarray,
                    blocks: dict[int, int]) -> DataFrame:
    """The rows of the lists' current windows, dealt to pieces, once for every block of members."""
    pieces = {k: max(1, -(-int(counts[k, a:b].sum()) // PIECE)) for k, (a, b) in window.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _by_dim(batch, 3):
                if dim not in plan.centres:
                    continue
                t, norm = angles(x, plan.centres[dim])
                rows = batch.take(pa.array(at))
                for k, (first, end) in window.items():
                    own = plan.lists[k]
                    if own.dim != dim:
                        continue
                    bound = bounds(t[:, own.centre], norm, own.low, own.high)
                    bins = plan.bins(bound, dim)
                    here = np.flatnonzero((bins >= first) & (bins < end))
                    if len(here) == 0:
                        continue
                    kept = rows.take(pa.array(here))
                    numbers = kept.column(0).to_numpy()
                    piece = (numbers * 0x9E3779B1 >> 7) % pieces[k]
                    packed = _pack(x[here], plan.kind(dim))
                    for block in range(blocks[k]):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(here), k, np.int32)), pa.array(piece.astype(np.int32)),
                             pa.array(np.full(len(here), block, np.int32)), pa.array(bound[here]), kept.column(0),
                             kept.column(1), kept.column(2), packed],
                            ["_list", "_piece", "_block", "_bound", "r_row", "r_id", "r_label", "r_x"])

    return base.select("_row", "_id", "_label", "_x").mapInArrow(
        run, "_list int, _piece int, _block int, _bound double, r_row long, r_id long, r_label long, r_x binary")


def walk_lists(base: DataFrame, plan: Plan, counts: np.ndarray, walkers: DataFrame, same_label: bool, top: int
               ) -> DataFrame:
    """``_walker, _other, _score, _rank``: the ``top`` best rows of each walker, by score, then id.

    ``walkers``: ``_walker`` (a number of its own), ``_row, _label, _x, _norm, _list`` of its anchor, and the
    scores ``_low`` to ``_high`` that it may take.
    """
    spark = base.sparkSession
    ahead = np.concatenate([np.zeros((len(counts), 1), np.int64), counts.cumsum(axis=1)], axis=1)
    position, size = dict.fromkeys(range(len(counts)), 0), FIRST_WINDOW
    best, kinds = None, "_walker long, _other long, _score long"
    walkers = walkers.where(F.col("_low") <= F.col("_high")).withColumn("_least", F.lit(LEAST))
    while True:
        # lists with rows left, and the bound of the rest
        left = [(k, plan.ceiling(plan.lists[k].dim, at)) for k, at in position.items() if ahead[k, -1] > ahead[k, at]]
        if not left:
            break
        rest = spark.createDataFrame(left, "_list int, _rest double")
        walking = cut_lineage(walkers.join(F.broadcast(rest), "_list").where(
            (F.col("_least") <= F.col("_norm") * F.col("_rest")) & (F.col("_low") <= F.col("_norm") * F.col("_rest"))))
        sizes = dict(walking.groupBy("_list").count().collect())  # a number per list
        if not sizes:
            break
        window = {}
        for k in sizes:
            at = position[k]
            end = int(np.searchsorted(ahead[k], ahead[k, at] + size, "left"))
            window[k] = (at, max(at + 1, min(end, plan.n_bins)))
        blocks = {k: -(-n // MEMBERS) for k, n in sizes.items()}
        rows = _rows_of_window(base, plan, window, counts, blocks)
        many = F.create_map(*[F.lit(int(v)) for k in blocks for v in (k, blocks[k])])
        pieces = F.create_map(*[F.lit(int(v)) for k, (a, b) in window.items()
                                for v in (k, max(1, -(-int(counts[k, a:b].sum()) // PIECE)))])
        dealt = (walking.withColumn("_block", F.pmod(F.xxhash64("_row"), many[F.col("_list")]).cast("int"))
                 .withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces[F.col("_list")] - 1))).drop("_rest"))
        keys = ["_list", "_piece", "_block"]
        found = dealt.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(
            _walk(plan, same_label, top, STEP), kinds)
        order = Window.partitionBy("_walker").orderBy(F.desc("_score"), "_other")
        best = cut_lineage((found if best is None else found.unionByName(best.drop("_rank")))
                           .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top))
        last = best.where(F.col("_rank") == top).select("_walker", F.col("_score").alias("_kth"))
        walkers = walking.drop("_rest").join(last, "_walker", "left").withColumn(
            "_least", F.coalesce("_kth", "_least")).drop("_kth")
        position = {k: window[k][1] for k in sizes}
        size *= GROWTH
    return best if best is not None else spark.createDataFrame([], kinds + ", _rank int")


def mine(rows: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, every: int = 100,
         scale: int = 256, shift: tuple[int, int] | None = (7, 10), id_col: str = "vec_id", label_col: str = "label",
         vec_col: str = "embedding", clusters: int = CLUSTERS, seed: int = 0) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors: ids divisible by ``every``. For each of an anchor's first ``positives`` other rows of its label, the
    first ``negatives`` rows of other labels with scores from ``low`` to ``high`` percent of the positive's.
    """
    if not 0 <= low <= high:
        raise ValueError("percentages must not be negative or in falling order")
    base = integral_rows(rows, id_col, label_col, vec_col, scale, shift)
    anchors = base.where(F.col("_id") % every == 0)
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
              "negative_score long")
    if anchors.isEmpty():
        return rows.sparkSession.createDataFrame([], schema)
    plan, members = plan_lists(base, anchors, clusters, seed)
    counts = count_bins(base, plan)
    every_score = {"_low": F.lit(LEAST), "_high": F.lit(MOST)}
    near = walk_lists(base, plan, counts, members.drop("_id").withColumn("_walker", F.col("_row"))
                      .withColumns(every_score), True, positives)
    pairs = near.select(F.col("_walker").alias("_row"), F.col("_other").alias("positive_id"),
                        F.col("_score").alias("positive_score"), F.col("_rank").alias("_place"))
    # whole scores s with low * p <= 100 s <= high * p, without overflow: p is 100 whole + part
    whole, part = F.expr("positive_score div 100"), F.col("positive_score") % 100
    ranges = {"_low": whole * low + F.ceil(part * low / 100), "_high": whole * high + F.floor(part * high / 100)}
    walkers = cut_lineage(pairs.join(members, "_row").withColumns(ranges).withColumn(
        "_walker", F.col("_row") * positives + F.col("_place") - 1))
    mined = walk_lists(base, plan, counts, walkers.select("_walker", "_row", "_label", "_x", "_norm", "_list", "_low",
                                                          "_high"), False, negatives)
    named = walkers.select("_walker", F.col("_id").alias("anchor_id"), "positive_id", "positive_score")
    return mined.join(named, "_walker").select(
        "anchor_id", "positive_id", F.col("_rank").cast("int").alias("rank"), F.col("_other").alias("negative_id"),
        "positive_score", F.col("_score").alias("negative_score"))


#: The same result in DuckDB, every anchor against every row.
ORACLE = """
WITH sound AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
negatives AS (
  SELECT anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 10
"""
