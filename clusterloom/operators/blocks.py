"""Blocked pair computation: the one physical primitive behind every all-pairs operator.

Rows are hashed into blocks of about ``block_rows`` rows (their number grows with the
data, block size does not). Blocks are dealt in at most ``MAX_RANGES`` ranges of
neighbouring blocks, and a row is shuffled once for every range: as the left side to
the ranges from its own on, as the right side to the ranges before. A pair of ranges
is one ``cogroup(...).applyInPandas`` group, which goes through its block pairs one
after the other: a dense matrix product on at most ``block_rows`` x ``block_rows``
distances, of which only a *reduced* result is kept (top-k per row, edges under a
threshold, per-(row, cluster) sums). Every unordered pair of rows meets exactly once.
Hot keys cannot skew it: blocks are formed by a hash of the row id, not by any data key.

A range holds at most ``RANGE_VALUES`` numbers; only beyond ``MAX_RANGES`` such ranges
(a million rows of 64 numbers) their number grows, and with it the copies of a row.
Memory per group is bounded by two ranges and one block of distances. Exact all-pairs
work is inherently O(n^2); this layout makes it O(n^2 / P) per core with a shuffle in
proportion to the rows, and never builds a row-level cross join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BLOCK_ROWS = 2048
MAX_RANGES = 16
RANGE_VALUES = 1 << 22  # numbers in the vectors of a range of blocks, 32 MB


def n_blocks_for(df: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS) -> int:
    n = df.count()
    return max(1, math.ceil(n / max(1, block_rows)))


def pair_matrix(x: np.ndarray, y: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Dense distance block between row sets x (m x D) and y (n x D)."""
    if metric in ("euclidean", "l2", "sqeuclidean"):
        nx, ny = (x * x).sum(1), (y * y).sum(1)
        d2 = nx[:, None] + ny[None, :]  # the same sum from either side
        product = x @ y.T
        product *= 2.0
        d2 -= product
        # the expansion cancels for near rows: take their differences instead
        a, b = np.nonzero(d2 <= 1e-6 * (nx.max(initial=0.0) + ny.max(initial=0.0)))
        near = d2[a, b] <= 1e-6 * (nx[a] + ny[b])
        a, b = a[near], b[near]
        for at in range(0, len(a), 1 << 16):
            i, j = a[at:at + (1 << 16)], b[at:at + (1 << 16)]
            d2[i, j] = ((x[i] - y[j]) ** 2).sum(1)
        np.maximum(d2, 0.0, out=d2)
        return d2 if metric == "sqeuclidean" else np.sqrt(d2)
    if metric == "cosine":
        nx = np.linalg.norm(x, axis=1)[:, None]
        ny = np.linalg.norm(y, axis=1)[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            sim = (x @ y.T) / (nx * ny)
        return 1.0 - np.nan_to_num(sim, nan=0.0)
    if metric in ("manhattan", "l1", "cityblock"):
        out = np.empty((len(x), len(y)))
        step = max(1, 2_000_000 // max(1, len(y) * x.shape[1]))
        for s in range(0, len(x), step):
            out[s:s + step] = np.abs(x[s:s + step, None, :] - y[None, :, :]).sum(2)
        return out
    raise ValueError(f"unknown metric {metric!r}")


def _stack(col: pd.Series) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.stack(col.to_numpy()).astype(np.float64)


def range_cap(pts: DataFrame, block_rows: int) -> int:
    """Blocks that a range may hold at most, by the width of a row."""
    width = len(pts.columns)
    if "_vec" in pts.columns:
        width = max(width, pts.select(F.max(F.size("_vec"))).first()[0] or 1)
    return max(1, RANGE_VALUES // (width * block_rows))


def as_right(rows: pd.DataFrame, keys: Iterable[str] = ()) -> pd.DataFrame:
    return rows.rename(columns={c: f"r_{c}" for c in rows.columns if c not in keys})


def reduce_pairs(reducer, pairs: Iterator[tuple], empty: pd.DataFrame) -> pd.DataFrame:
    """``reducer`` over block pairs ``(left block, left rows, right block, right rows)`` of one group.

    A reducer with ``over`` takes the pairs as they come and may keep what it learns from one for the next;
    ``merge`` shrinks what the pairs of a left block gave.
    """
    if hasattr(reducer, "over"):
        return reducer.over(pairs)
    out, last = [], None
    for a, l, b, r in pairs:
        if hasattr(reducer, "merge") and last not in (None, a) and len(out) > 1:
            out = [reducer.merge(pd.concat(out, ignore_index=True))]
        out.append(reducer(l, r, a == b))
        last = a
    if not out:
        return reducer(empty, as_right(empty), False)
    found = pd.concat([o for o in out if len(o)] or out[:1], ignore_index=True)
    return reducer.merge(found) if hasattr(reducer, "merge") and len(out) > 1 else found


def self_block_cogroup(pts: DataFrame, reducer: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame],
                       schema: str, n_blocks: int, id_col: str = "_id", group: str | None = None,
                       block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Run ``reducer(left, right, is_diagonal)`` on every unordered block pair of ``pts``.

    Right-side columns are prefixed ``r_`` (a self-cogroup with equal names is
    ambiguous). ``pts`` should carry only the columns the reducer needs. With
    ``group`` only rows of the same group meet, each group in blocks of its own
    (``block_rows`` each; ``n_blocks`` isn't used). Rows with a column ``_blk`` are placed already.
    """
    if group is None:
        base = pts.withColumn("_nb", F.lit(int(n_blocks)))
    else:
        sizes = pts.groupBy(group).agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("_nb"))
        base = pts.join(sizes, group)
    cap = range_cap(pts, block_rows) if group is not None or n_blocks > MAX_RANGES else 1
    span = F.least(F.ceil(F.col("_nb") / F.lit(MAX_RANGES)), F.lit(cap)).cast("int")  # blocks to a range
    if "_blk" not in pts.columns:
        base = base.withColumn("_blk", F.pmod(F.xxhash64(F.col(id_col)), F.col("_nb")).cast("int"))
    base = base.withColumn("_rng", F.floor(F.col("_blk") / span).cast("int")).withColumn(
        "_last", F.floor((F.col("_nb") - 1) / span).cast("int")).drop("_nb")
    left = base.withColumn("_gh", F.explode(F.sequence("_rng", "_last"))).withColumnRenamed("_rng", "_gl").drop("_last")
    right = base.where(F.col("_rng") > 0).withColumn(
        "_gl", F.explode(F.sequence(F.lit(0), F.col("_rng") - 1))).withColumnRenamed("_rng", "_gh").drop("_last")
    keys = ["_gl", "_gh"] + ([group] if group else [])
    right = right.select(*[F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns])

    def run(lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        one = len(lpdf) > 0 and int(lpdf["_gl"].iloc[0]) == int(lpdf["_gh"].iloc[0])
        lefts = [(int(b), rows) for b, rows in lpdf.groupby("_blk")]
        rights = ([(b, as_right(rows, keys)) for b, rows in lefts] if one else
                  [(int(b), rows) for b, rows in rpdf.groupby("r__blk")])
        return reduce_pairs(reducer, ((a, l, b, r) for a, l in lefts for b, r in rights if not one or a <= b),
                            lpdf.iloc[0:0])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def equal_rows(pts: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """``a, b``: each row's id ``b`` with the smallest id ``a`` of the rows that have its very vector (and ``keys``)."""
    finite = pts.where(F.forall("_vec", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    first = finite.groupBy("_vec", *keys).agg(F.min("_id").alias("a"), F.count("*").alias("_n")).where(F.col("_n") > 1)
    return finite.join(first, ["_vec", *keys]).where(F.col("_id") != F.col("a")).select(
        "a", F.col("_id").alias("b")).distinct()


def place_whole(pts: DataFrame, by: str, block_rows: int = DEFAULT_BLOCK_ROWS) -> tuple[DataFrame, int]:
    """``pts`` with ``_blk`` and ``_whole``, and the number of blocks: rows of one value of ``by`` share a block.

    Only a value with more rows than a quarter of a block's is cut in pieces, by a hash of ``_id``.
    """
    sizes = pts.groupBy(by).agg(F.count("*").alias("_rows"))
    whole = F.col("_rows") <= F.lit(max(1, block_rows // 4))
    small, large = sizes.agg(F.sum(F.when(whole, F.col("_rows"))), F.sum(F.when(~whole, F.col("_rows")))).first()
    n_small = max(1, -(-(small or 0) * 4 // (3 * block_rows)))
    n_large = max(1, -(-(large or 0) // block_rows))
    piece = F.pmod(F.xxhash64("_id"), F.ceil(F.col("_rows") / F.lit(block_rows)))
    placed = pts.join(sizes, by).withColumn("_whole", whole).withColumn("_blk", F.when(
        whole, F.pmod(F.xxhash64(by), F.lit(n_small))).otherwise(
            F.lit(n_small) + F.pmod(F.xxhash64(F.col(by), piece), F.lit(n_large))).cast("int"))
    return placed.drop("_rows"), n_small + n_large


def value_links(l: pd.DataFrame, r: pd.DataFrame, by: str, metric: str, mean: bool) -> tuple[np.ndarray, ...]:
    """Of each value of ``by`` on the left with each on the right: the largest distance of two rows with different ids,
    -inf if there are none, or (``mean``) the sum of all distances; as ``values, whole`` of both sides and the matrix."""
    sides = []
    for rows, mark in ((l, ""), (r, "r_")):
        v = rows[f"{mark}{by}"].to_numpy(np.int64)
        order = np.argsort(v, kind="stable")
        values, first = np.unique(v[order], return_index=True)
        sides.append((values, rows[f"{mark}_whole"].to_numpy(bool)[order][first], first, rows.iloc[order]))
    (vl, wl, fl, l), (vr, wr, fr, r) = sides
    d = pair_matrix(_stack(l["_vec"]), _stack(r["r__vec"]), metric)
    if mean:
        return vl, wl, vr, wr, np.add.reduceat(np.add.reduceat(d, fl, axis=0), fr, axis=1)
    li, ri = l["_id"].to_numpy(np.int64), r["r__id"].to_numpy(np.int64)
    if np.intersect1d(li, ri).size:
        d = np.where(li[:, None] == ri[None, :], -np.inf, d)
    return vl, wl, vr, wr, np.maximum.reduceat(np.maximum.reduceat(d, fl, axis=0), fr, axis=1)


def cross_block_cogroup(left: DataFrame, right: DataFrame,
                        reducer: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame],
                        schema: str, left_blocks: int, right_blocks: int,
                        left_id: str = "_id", right_id: str = "r__id") -> DataFrame:
    """Ordered variant: every left block meets every right block once.

    ``right`` columns must already be prefixed ``r_``.
    """
    Bl, Br = int(left_blocks), int(right_blocks)
    lb = left.withColumn("_gl", F.pmod(F.xxhash64(F.col(left_id)), F.lit(Bl)).cast("int")).withColumn(
        "_gh", F.explode(F.sequence(F.lit(0), F.lit(Br - 1))))
    rb = right.withColumn("_gh", F.pmod(F.xxhash64(F.col(right_id)), F.lit(Br)).cast("int")).withColumn(
        "_gl", F.explode(F.sequence(F.lit(0), F.lit(Bl - 1))))

    def run(lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if len(lpdf) == 0 or len(rpdf) == 0:
            return reducer(lpdf.iloc[0:0], rpdf.iloc[0:0], False)
        return reducer(lpdf, rpdf, False)

    return lb.groupBy("_gl", "_gh").cogroup(rb.groupBy("_gl", "_gh")).applyInPandas(run, schema)


# ----------------------------------------------------------------------------- reducers

def _topk_rows(d: np.ndarray, ids_r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise k smallest by (distance, neighbour id); returns (row index, col index) pairs."""
    m, n = d.shape
    if n == 0 or m == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kk = min(k, n)
    if kk < n:
        part = np.partition(d, kk - 1, axis=1)[:, kk - 1:kk]
        mask = d <= part  # keeps ties at the k-th value so the merge can break them by id
    else:
        mask = np.isfinite(d)
    rows, cols = np.nonzero(mask & np.isfinite(d))
    order = np.lexsort((ids_r[cols], d[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    # rank within row, keep first kk
    starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    keep = rank < kk
    return rows[keep], cols[keep]


class Screen:
    """Euclidean links of two blocks without their matrix in double precision.

    One product in single precision gives all squared distances with a known error; what may be among a row's nearest
    is computed from the differences in double, so that results are exact. The link is the distance over ``alpha``, at
    least the values ``core`` of both rows, or with ``size`` the ward distance of clusters of these sizes.
    """

    def __init__(self, alpha: float = 1.0, core: str | None = None, size: str | None = None):
        self.alpha, self.core, self.size = alpha, core, size

    def side(self, rows: pd.DataFrame, mark: str) -> dict | None:
        """A block's matrices; None if single precision can't hold them."""
        x = _stack(rows[f"{mark}_vec"])
        sq = (x * x).sum(1)
        if not len(x) or not (sq < 1e30).all():
            return None
        one = np.ones(len(x))
        out = {"x": x, "error": (x.shape[1] + 8) * 2.0 ** -23 * sq,  # of a squared distance, added up over both rows
               "u": np.column_stack([-2.0 * x, sq, one]).astype(np.float32),
               "v": np.column_stack([x, one, sq]).astype(np.float32)}
        if self.core is not None:
            out["core"] = rows[f"{mark}{self.core}"].to_numpy(np.float64)
        if self.size is not None:
            out["size"] = rows[f"{mark}{self.size}"].to_numpy(np.float64)
            out["inverse"] = 1.0 / out["size"]
        return out

    def exact(self, l: dict, i: np.ndarray, r: dict, j: np.ndarray) -> np.ndarray:
        d = np.empty(len(i))
        for at in range(0, len(i), 1 << 13):
            s = slice(at, at + (1 << 13))
            gap = l["x"][i[s]] - r["x"][j[s]]
            d[s] = (gap * gap).sum(1)
        d = np.sqrt(d)
        if self.size is not None:
            nl, nr = l["size"][i], r["size"][j]
            return np.sqrt(2.0 * nl * nr / (nl + nr)) * d
        if self.alpha != 1.0:
            d /= self.alpha
        return np.maximum(np.maximum(d, l["core"][i]), r["core"][j]) if self.core is not None else d

    def reach(self, squares: np.ndarray, own: dict, far: dict, k: int, axis: int) -> np.ndarray:
        """An upper bound of the k-th least link of the rows along ``axis``: that of the least of some 64 groups of links."""
        if axis == 0:
            squares = squares.T
        links = squares if self.size is None else squares / np.add.outer(
            (far["inverse"] * 0.5).astype(np.float32), (own["inverse"] * 0.5).astype(np.float32))
        if self.core is not None:
            links = np.maximum(links, ((far["core"] * self.alpha) ** 2).astype(np.float32)[:, None])
        if len(links) < k:
            return np.full(links.shape[1], np.inf)
        least = _kth_of_groups(links, k)
        error = own["error"] + far["error"].max()
        if self.size is not None:
            error = error * 2.0 / (own["inverse"] + far["inverse"].min())
        link = np.sqrt(np.maximum(least + error, 0.0)) * (1 + 1e-6) / (self.alpha if self.size is None else 1.0)
        return np.maximum(link, own["core"]) if self.core is not None else link

    def within(self, squares: np.ndarray, own: dict, far: dict, limit: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows along ``axis`` and the others that may have a link of at most the row's ``limit`` (-inf: none)."""
        look = limit >= 0
        limit = np.where(look, limit, 0.0)
        error = (own["error"] + far["error"].max()) * (1 + 1e-6)
        if self.size is None:
            most = np.where(look, (limit * self.alpha) ** 2 * (1 + 1e-6) + error, -np.inf).astype(np.float32)
            most = most[:, None] if axis == 0 else most[None, :]
        else:
            half = limit ** 2 * 0.5 * (1 + 1e-6)
            base = np.where(look, half * own["inverse"] + error, -np.inf)
            if far["inverse"].min() == far["inverse"].max():
                most = (base + half * far["inverse"][0]).astype(np.float32)
                most = most[:, None] if axis == 0 else most[None, :]
            else:
                x, y = (half, far["inverse"]) if axis == 0 else (far["inverse"], half)
                most = np.multiply.outer(x.astype(np.float32), y.astype(np.float32))
                most += base.astype(np.float32)[:, None] if axis == 0 else base.astype(np.float32)[None, :]
        at = np.flatnonzero(squares <= most)
        a, b = np.divmod(at, squares.shape[1])
        return (a, b) if axis == 0 else (b, a)


def _kth_of_groups(links: np.ndarray, k: int) -> np.ndarray:
    """Of each column the k-th least of the least links of some 64 groups of rows."""
    n, groups = len(links), max(64, 4 * k)
    if n >= 2 * groups:
        cut = n // groups * groups
        links = links[:cut].reshape(n // groups, groups, -1).min(axis=0)
    return np.partition(links, k - 1, axis=0)[k - 1].astype(np.float64)


class ProductScreen(Screen):
    """The same for links that are 1 less the product of two rows: average cosine links of clusters of unit vectors."""

    def side(self, rows: pd.DataFrame, mark: str) -> dict | None:
        x = _stack(rows[f"{mark}_vec"])
        sq = (x * x).sum(1)
        if not len(x) or not (sq < 1e30).all():
            return None
        one = np.ones(len(x))
        return {"x": x, "error": (x.shape[1] + 8) * 2.0 ** -23 * (sq + 1.0),
                "u": np.column_stack([-x, one]).astype(np.float32), "v": np.column_stack([x, one]).astype(np.float32)}

    def exact(self, l: dict, i: np.ndarray, r: dict, j: np.ndarray) -> np.ndarray:
        d = np.empty(len(i))
        for at in range(0, len(i), 1 << 13):
            s = slice(at, at + (1 << 13))
            d[s] = 1.0 - (l["x"][i[s]] * r["x"][j[s]]).sum(1)
        return d

    def reach(self, squares: np.ndarray, own: dict, far: dict, k: int, axis: int) -> np.ndarray:
        links = squares.T if axis == 0 else squares
        if len(links) < k:
            return np.full(links.shape[1], np.inf)
        return _kth_of_groups(links, k) + (own["error"] + far["error"].max()) * (1 + 1e-6)

    def within(self, squares: np.ndarray, own: dict, far: dict, limit: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
        # -inf (doesn't look) stays so
        most = (limit + (own["error"] + far["error"].max()) * (1 + 1e-6)).astype(np.float32)
        a, b = np.divmod(np.flatnonzero(squares <= (most[:, None] if axis == 0 else most[None, :])), squares.shape[1])
        return (a, b) if axis == 0 else (b, a)


class NearestReducer:
    """The ``k`` nearest rows of each row of a block pair, ``id, nbr_id, dist``, ties by the smaller id.

    ``links(left, right)`` is the matrix of distances; rows that agree in the column ``apart`` aren't neighbours.
    With ``need`` only rows with that flag look for neighbours. Over the pairs of a group a block keeps the
    nearest so far, and of a further matrix only what is not above the k-th of them is looked at. With a
    ``screen`` the matrix is one of single precision, and only links that may count are computed.
    """

    def __init__(self, k: int, links: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], apart: str | None = "_id",
                 need: str | None = None, screen: Screen | None = None):
        self.k, self.links, self.apart, self.need, self.screen = k, links, apart, need, screen

    def __call__(self, l: pd.DataFrame, r: pd.DataFrame, diag: bool) -> pd.DataFrame:
        return self.over(iter([(0, l, 0 if diag else 1, r)]))

    def over(self, pairs: Iterator[tuple]) -> pd.DataFrame:
        found: dict[int, tuple] = {}
        seen: dict[tuple, tuple] = {}
        for a, l, b, r in pairs:
            if len(l) == 0 or len(r) == 0:
                continue
            for key in [k for k in seen if k[0] == "" and k[1] != a]:
                del seen[key]
            l, li, nl, sl = self._side(seen, a, l, "")
            r, ri, nr, sr = self._side(seen, b, r, "r_")
            if sl is not None and sr is not None and self._screened(found, a, l, li, nl, sl, b, r, ri, nr, sr):
                continue
            if a == b:
                if nl.any():
                    self._keep(found, a, li, np.flatnonzero(nl), self._matrix(l, r, np.array_equal(li, ri))[nl], ri)
                continue
            if nl.any():
                d = self._matrix(l if nl.all() else l[nl], r)
                self._keep(found, a, li, np.flatnonzero(nl), d, ri)
                if nr.any():
                    self._keep(found, b, ri, np.flatnonzero(nr), d if nr.all() else d[:, nr], li[nl], right=True)
            if nr.any() and not nl.all():
                self._keep(found, b, ri, np.flatnonzero(nr), self._matrix(l[~nl], r[nr]), li[~nl], right=True)
        parts = [(ids[row], nbr, dist) for ids, row, nbr, dist, _ in found.values()]
        parts.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
        return pd.DataFrame({name: np.concatenate([p[i] for p in parts]) for i, name in enumerate(("id", "nbr_id", "dist"))})

    def _side(self, seen: dict, block: int, rows: pd.DataFrame, mark: str) -> tuple:
        """A block by ascending id, whichever side it comes from: its rows, ids, flags and matrices."""
        if (mark, block) not in seen:
            ids = rows[f"{mark}_id"].to_numpy(np.int64)
            if (ids[1:] < ids[:-1]).any():
                order = np.argsort(ids, kind="stable")
                rows, ids = rows.iloc[order], ids[order]
            flags = np.ones(len(rows), bool) if self.need is None else rows[f"{mark}{self.need}"].to_numpy(bool)
            seen[mark, block] = rows, ids, flags, None if self.screen is None else self.screen.side(rows, mark)
        return seen[mark, block]

    def _screened(self, found: dict, a: int, l: pd.DataFrame, li: np.ndarray, nl: np.ndarray, sl: dict, b: int,
                  r: pd.DataFrame, ri: np.ndarray, nr: np.ndarray, sr: dict) -> bool:
        """Merge what the pair of blocks holds into ``found``; False if too many links may count."""
        looks = [(a, li, ri, nl, sl, sr, 0)] if nl.any() else []
        if a != b and nr.any():
            looks.append((b, ri, li, nr, sr, sl, 1))
        if not looks:
            return True
        marks = None
        if self.apart is not None:
            marks = l[self.apart].to_numpy(np.int64), r[f"r_{self.apart}"].to_numpy(np.int64)
        # the rows that look, or all if both sides' are as many
        few = nl.sum() * len(ri) + (0 if a == b else nr.sum() * len(li)) < len(li) * len(ri)
        squares = None if few else sl["u"] @ sr["v"].T
        news = []
        for block, ids, others, need, own, far, axis in looks:
            at = np.flatnonzero(need) if few else np.arange(len(ids))
            part = {key: value[at] for key, value in own.items()} if few else own
            if few:
                squares = part["u"] @ far["v"].T if axis == 0 else far["u"] @ part["v"].T
            limit = (found[block][4] if block in found else np.full(len(ids), np.inf))[at]
            limit = np.where(need[at], limit, -np.inf)
            if np.isposinf(limit).any():
                seed = squares
                if marks is not None and np.intersect1d(*marks).size:
                    x, y = (marks[0][at], marks[1]) if axis == 0 else (marks[0], marks[1][at])
                    seed = np.where(x[:, None] == y[None, :], np.float32(np.inf), squares)
                limit = np.minimum(limit, self.screen.reach(seed, part, far, self.k, axis))
            if np.isposinf(limit).any():
                return False
            i, j = self.screen.within(squares, part, far, limit, axis)
            if len(i) > squares.size // 16 + 64 * self.k:
                return False
            if marks is not None:
                x, y = marks if axis == 0 else marks[::-1]
                apart = x[at[i]] != y[j]
                i, j = i[apart], j[apart]
            d = self.screen.exact(part, i, far, j)
            good = d <= limit[i]
            news.append((block, ids, at[i[good]], others[j[good]], d[good]))
        for new in news:
            self._merge(found, *new)
        return True

    def _matrix(self, l: pd.DataFrame, r: pd.DataFrame, same: bool = False) -> np.ndarray:
        d = self.links(l, r)
        if same:  # a link is one number, whichever of its ends looks
            d = np.minimum(d, d.T)
        if self.apart is not None:
            x, y = l[self.apart].to_numpy(np.int64), r[f"r_{self.apart}"].to_numpy(np.int64)
            if np.intersect1d(x, y).size:
                d = np.where(x[:, None] == y[None, :], np.inf, d)
        return d

    def _keep(self, found: dict, block: int, ids: np.ndarray, at: np.ndarray, d: np.ndarray, other: np.ndarray,
              right: bool = False) -> None:
        """Merge the matrix ``d`` of the rows ``at`` of a block (``right``: of its columns) with what the block has."""
        limit = found[block][4][at] if block in found else np.full(len(at), np.inf)
        if np.isinf(limit).all():
            a, b = _topk_rows(d.T if right else d, other, self.k)
        else:
            limit = np.where(np.isinf(limit), np.finfo(np.float64).max, limit)
            a, b = np.nonzero(d <= (limit[None, :] if right else limit[:, None]))
            if right:
                a, b = b, a
        self._merge(found, block, ids, at[a], other[b], d[b, a] if right else d[a, b])

    def _merge(self, found: dict, block: int, ids: np.ndarray, at: np.ndarray, other: np.ndarray, d: np.ndarray) -> None:
        """Links of the rows ``at`` of a block to the ids ``other``, with what the block has."""
        if block not in found:  # ids, then row, neighbour and distance of the nearest, and the k-th distance of each row
            found[block] = (ids, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(ids), np.inf))
        _, row, nbr, dist, bound = found[block]
        if not len(at):
            return
        row, nbr, dist = np.concatenate([row, at]), np.concatenate([nbr, other]), np.concatenate([dist, d])
        order = np.lexsort((nbr, dist, row))
        row, nbr, dist = row[order], nbr[order], dist[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < self.k
        row, nbr, dist, rank = row[kept], nbr[kept], dist[kept], rank[kept]
        bound = bound.copy()
        bound[row[rank == self.k - 1]] = dist[rank == self.k - 1]
        found[block] = (ids, row, nbr, dist, bound)


def vector_links(metric: str) -> Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]:
    return lambda l, r: pair_matrix(_stack(l["_vec"]), _stack(r["r__vec"]), metric)


def knn_reducer(k: int, metric: str = "euclidean", exclude_self: bool = True) -> NearestReducer:
    """Top-k candidates for both sides of a block pair: ``id, nbr_id, dist``."""
    return NearestReducer(k, vector_links(metric), "_id" if exclude_self else None,
                          screen=Screen() if metric in ("euclidean", "l2") else None)


def within_reducer(threshold: float, metric: str = "euclidean"):
    """Unordered pairs (a < b) with distance <= threshold: ``id_a, id_b, dist``."""

    def red(l: pd.DataFrame, r: pd.DataFrame, diag: bool) -> pd.DataFrame:
        if len(l) == 0:
            return pd.DataFrame({"id_a": pd.Series([], dtype="int64"), "id_b": pd.Series([], dtype="int64"),
                                 "dist": pd.Series([], dtype="float64")})
        li, ri = l["_id"].to_numpy(np.int64), r["r__id"].to_numpy(np.int64)
        xl, xr = _stack(l["_vec"]), _stack(r["r__vec"])
        d = pair_matrix(xl, xr, metric)
        if np.isfinite(threshold) and metric in ("euclidean", "l2"):  # rounding must not decide at the threshold
            a, b = np.nonzero(np.abs(d - threshold) <= 1e-9 * (1.0 + threshold))
            d[a, b] = np.sqrt(((xl[a] - xr[b]) ** 2).sum(1))
        mask = (d <= threshold) & (li[:, None] != ri[None, :])
        if diag:
            mask &= li[:, None] < ri[None, :]
        a, b = np.nonzero(mask)
        lo, hi = np.minimum(li[a], ri[b]), np.maximum(li[a], ri[b])
        return pd.DataFrame({"id_a": lo, "id_b": hi, "dist": d[a, b]})

    return red


def _components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row reachable from each of ``n`` rows over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (root[a], root[b], a, b):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def component_reducer(threshold: float, metric: str = "euclidean"):
    """Which rows of a block pair hang together by distances <= threshold: ``id_a, id_b``, fewer rows than the blocks.

    Every row but the first of a component points to that first one, so that a dense block pair returns a
    forest and not its links.
    """
    within = within_reducer(threshold, metric)

    def red(l: pd.DataFrame, r: pd.DataFrame, diag: bool) -> pd.DataFrame:
        return _forest(within(l, r, diag))

    red.merge = _forest
    return red


def _forest(pairs: pd.DataFrame) -> pd.DataFrame:
    """A forest with the components of the links ``id_a, id_b``."""
    ids, at = np.unique(np.concatenate([pairs["id_a"], pairs["id_b"]]).astype(np.int64), return_inverse=True)
    root = _components(at[:len(pairs)], at[len(pairs):], len(ids))
    linked = np.flatnonzero(root != np.arange(len(ids)))
    return pd.DataFrame({"id_a": ids[root[linked]], "id_b": ids[linked]})


def cluster_sum_reducer(metric: str = "euclidean"):
    """Per (row, other row's label): sum of distances and count (self excluded)."""

    def red(l: pd.DataFrame, r: pd.DataFrame, diag: bool) -> pd.DataFrame:
        empty = pd.DataFrame({"id": pd.Series([], dtype="int64"), "label": pd.Series([], dtype="int32"),
                              "dsum": pd.Series([], dtype="float64"), "cnt": pd.Series([], dtype="int64")})
        if len(l) == 0:
            return empty
        li, ri = l["_id"].to_numpy(np.int64), r["r__id"].to_numpy(np.int64)
        ll, rl = l["_label"].to_numpy(np.int64), r["r__label"].to_numpy(np.int64)
        d = pair_matrix(_stack(l["_vec"]), _stack(r["r__vec"]), metric)
        same = li[:, None] == ri[None, :]
        frames = []

        def sums(dm, valid, labels_other, ids_self):
            uniq, inv = np.unique(labels_other, return_inverse=True)
            onehot = np.zeros((len(labels_other), len(uniq)))
            onehot[np.arange(len(labels_other)), inv] = 1.0
            dsum = np.where(valid, dm, 0.0) @ onehot
            cnt = valid.astype(np.float64) @ onehot
            rr, cc = np.nonzero(cnt > 0)
            return pd.DataFrame({"id": ids_self[rr], "label": uniq[cc].astype(np.int32),
                                 "dsum": dsum[rr, cc], "cnt": cnt[rr, cc].astype(np.int64)})

        frames.append(sums(d, ~same, rl, li))
        if not diag:
            frames.append(sums(d.T, ~same.T, ll, ri))
        return pd.concat(frames, ignore_index=True) if frames else empty

    red.merge = lambda sums: sums.groupby(["id", "label"], as_index=False).sum()
    return red


def outside_reducer(k: int, alpha: float = 1.0, metric: str = "euclidean", use_core: bool = True) -> NearestReducer:
    """The ``k`` cheapest edges of each flagged row to rows of other components (``_comp``).

    Weight = mutual reachability max(core_a, core_b, d / alpha) (or d / alpha when ``use_core`` is false). For
    the edges of one row, ties by the smaller neighbour are ties by (min id, max id), so the order is one total
    order of all edges and the minimum spanning forest is unique.
    """
    def links(l: pd.DataFrame, r: pd.DataFrame) -> np.ndarray:
        d = pair_matrix(_stack(l["_vec"]), _stack(r["r__vec"]), metric)
        if alpha != 1.0:
            d /= alpha
        if use_core:
            np.maximum(d, l["_core"].to_numpy(np.float64)[:, None], out=d)
            np.maximum(d, r["r__core"].to_numpy(np.float64)[None, :], out=d)
        return d

    screen = Screen(alpha, "_core" if use_core else None) if metric in ("euclidean", "l2") else None
    return NearestReducer(k, links, "_comp", "_need", screen)
