"""Quantile-autocovariance features, Ward clustering, silhouettes, household flags."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlab.functions.moments import percentile
from meterlab.operators.order_stats import attach_stats, null_safe_join, row_numbers
from meterlab.operators.preparation import MOTIVE_MISSING, MOTIVE_OUTLIERS
from meterlab.sources.stages import discard, materialise

OUTLIER = "outlier"
# The two group codes without a class.
DROPPED_GROUPS = ("ACORN-", "ACORN-U")
#: Clusters that one task merges to the end.
BLOCK = 16384
#: Blocks of a Ward round, two of which meet in a task, and the clusters of one from which on there are more blocks.
SIDES, SIDE_ROWS = 24, 50000
#: Copies of a point from which on its rows are spread over tasks.
COPIES = 1000
#: Blocks of a silhouette's points, two of which meet in a task.
BLOCKS = 16


# --- features ---------------------------------------------------------------------

def feature_name(tau: float, tau2: float, lag: int) -> str:
    return f"q{round(tau * 100)}_q{round(tau2 * 100)}_l{lag}"


def qaf_features(df: DataFrame, key: str, ts: str, value: str, taus: Sequence[float] = (.1, .5, .9),
                 lags: int = 1, check_length: bool = False) -> DataFrame:
    """Quantile autocovariances of every key, one DOUBLE column per (tau, tau', lag).

    mean over t of 1[x_t <= q_tau] 1[x_{t+l} <= q_tau'] - tau tau'; NULL counts as
    0 and the divisor is T - l with T including NULLs.  A series not longer than
    the lag gives NULL, or an error with ``check_length``.
    """
    if lags < 1:
        raise ValueError("lags must be at least 1")
    w = Window.partitionBy(key)
    ordered = w.orderBy(ts)
    work = df.select(key, ts, value).withColumns({f"__q{i}": percentile(value, t).over(w) for i, t in enumerate(taus)})
    ahead = {f"__a{h}": F.lead(value, h).over(ordered) for h in range(1, lags + 1)}
    work = work.withColumns(ahead)
    aggs = [F.count(F.lit(1)).alias("__t")]
    for h in range(1, lags + 1):
        for (i, t), (j, u) in product(enumerate(taus), repeat=2):
            both = (F.col(value) <= F.col(f"__q{i}")) & (F.col(f"__a{h}") <= F.col(f"__q{j}"))
            aggs.append(F.sum(F.when(both, 1).otherwise(0)).alias(f"__s{h}_{i}_{j}"))
    sums = work.groupBy(key).agg(*aggs)
    out = [F.col(key)]
    for h in range(1, lags + 1):
        size = F.col("__t") - h
        usable = F.when(size > 0, size)
        if check_length:
            usable = F.when(size > 0, size).otherwise(
                F.raise_error(F.lit("the lag must be smaller than the length of the series")).cast("bigint"))
        for (i, t), (j, u) in product(enumerate(taus), repeat=2):
            out.append((F.col(f"__s{h}_{i}_{j}") / usable - t * u).alias(feature_name(t, u, h)))
    return sums.select(*out)


def feature_columns(df: DataFrame, id_col: str) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType) and f.name != id_col]


def as_vectors(df: DataFrame, id_col: str, features: Sequence[str] | None = None) -> DataFrame:
    """(id, point): complete feature rows as DOUBLE arrays."""
    cols = list(features) if features is not None else feature_columns(df, id_col)
    return df.dropna("any", subset=cols).select(id_col, F.array(*[F.col(c).cast("double") for c in cols]).alias("point"))


# --- distances ---------------------------------------------------------------------

def _dealt(sent: DataFrame, tasks: int) -> DataFrame:
    """Rows of task ``__task`` in a partition of its own: no two tasks share one, and small ones aren't put together."""
    return sent.repartitionById(tasks, F.col("__task"))


def pairs_within(vectors: DataFrame, id_col: str, radius: float) -> DataFrame:
    """All pairs (i, j, distance) with i < j and Euclidean distance <= ``radius``.

    Points are hashed into blocks; every two blocks meet in a task, which compares only rows near enough to each
    other's leaves, and hands on its pairs a piece at a time.
    """
    known = F.col(id_col).isNotNull() & F.col("point").isNotNull() & ~F.exists("point", lambda v: v.isNull())
    points = materialise(vectors.where(known).select(F.col(id_col).alias("__id"), "point"))
    count = points.count()
    blocks = max(min(SIDES, math.ceil(8 * count / BLOCK)), math.ceil(count / SIDE_ROWS), 1)
    i, j = F.least("__block", "__at"), F.greatest("__block", "__at")
    sent = points.withColumn("__block", F.pmod(F.xxhash64("__id"), F.lit(blocks)).cast("int")).withColumn(
        "__at", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "__id", "point", (F.col("__block") == i).alias("__left"), (F.col("__block") == j).alias("__right"),
        (i * blocks + j - F.floor(i * (i + 1) / 2)).cast("int").alias("__task"))
    kind = points.schema["__id"].dataType
    pair = T.StructType([T.StructField("i", kind), T.StructField("j", kind), T.StructField("distance", T.DoubleType())])

    def near(batches):
        found = [pdf for pdf in batches if len(pdf)]
        rows = pd.concat(found, ignore_index=True) if found else pd.DataFrame({"point": []})
        for _, rows in rows.groupby(rows["point"].str.len()):  # points of unlike length have no distance
            left, right = (rows[rows[side]] for side in ("__left", "__right"))
            if len(left) and len(right):
                same = bool(rows["__left"].all() and rows["__right"].all())
                yield from _near_pairs(*((x["__id"].to_numpy(), np.stack(x["point"].to_list()).astype(float)) for x in (left, right)), same, float(radius))

    return _dealt(sent, blocks * (blocks + 1) // 2).mapInPandas(near, pair)


def _near_pairs(left: tuple, right: tuple, same: bool, radius: float, rows: int = 1 << 18):
    """Frames (i, j, distance) of the pairs of a row of ``left`` and one of ``right``, both (ids, points), of about ``rows`` each."""
    (ids, a), (names, b) = ((who[np.isfinite(x).all(axis=1)], x[np.isfinite(x).all(axis=1)]) for who, x in (left, right))
    mine = _leaves(a) if len(a) else []
    other = mine if same else _leaves(b) if len(b) else []
    limit, found = radius * radius * (1 + 1e-9), []

    def outside(x, low, high):
        gap = np.maximum(0.0, np.maximum(low - x, x - high))
        return (gap * gap).sum(axis=-1) > limit

    low, high = (np.array([f(b[y], axis=0) for y in other]) for f in (np.min, np.max))
    with np.errstate(all="ignore"):
        for x, at in enumerate(mine):
            box = a[at].min(axis=0), a[at].max(axis=0)
            gap = np.maximum(0.0, np.maximum(low - box[1], box[0] - high)) if len(other) else np.empty((0, 1))
            for y in np.flatnonzero((gap * gap).sum(axis=1) <= limit).tolist():
                if same and y < x:
                    continue
                here, there = at[~outside(a[at], low[y], high[y])], other[y][~outside(b[other[y]], *box)]
                if not len(here) or not len(there):
                    continue
                i, j, distance = _near_rows(a, b, here, there, radius, limit)
                if same and x == y:
                    i, j, distance = i[i < j], j[i < j], distance[i < j]
                i, j = ids[i], names[j]
                found.append(pd.DataFrame({"i": np.where(i < j, i, j), "j": np.where(i < j, j, i), "distance": distance})[i != j])
                if sum(map(len, found)) >= rows:
                    yield pd.concat(found)
                    found = []
    if found:
        yield pd.concat(found)


def _near_rows(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray, radius: float, limit: float) -> tuple:
    """(i, j, distance) of the places within the radius.  Products bound the distances; those that may do are computed by differences."""
    p, q = a[rows], b[cols]
    middle = p.mean(axis=0)
    cp, cq = p - middle, q - middle
    sp, sq = (cp * cp).sum(axis=1), (cq * cq).sum(axis=1)
    square = np.hstack([cp, sp[:, None], np.ones((len(p), 1))]) @ np.hstack([-2.0 * cq, np.ones((len(q), 1)), sq[:, None]]).T
    i, j = np.nonzero(~(square > limit + 1e-12 * (sp.max() + sq.max())))
    total = np.zeros(len(i))
    for axis in range(a.shape[1]):
        step = p[i, axis] - q[j, axis]
        total += step * step
    distance = np.sqrt(total)
    close = distance <= radius
    return rows[i[close]], cols[j[close]], distance[close]


# --- Ward ---------------------------------------------------------------------------

def _nearest_partners(state: DataFrame, count: int, reach: float) -> DataFrame:
    """Nearest partner ``(cid, e = (h2, keep, gone))`` of every cluster that has one at Ward height ``reach`` or less.

    Clusters that search are hashed into parts, clusters that are searched into stacks; a task searches one stack for
    one part's partners and returns the least edge of each: pairs are never rows.  The numbers of parts and stacks have
    a ceiling until they would hold more than ``SIDE_ROWS`` clusters, or eight times as many in a stack.
    """
    parts = max(min(SIDES, math.ceil(8 * count / BLOCK)), math.ceil(count / SIDE_ROWS), 1)
    stacks = max(1, math.ceil(count / (8 * SIDE_ROWS)))
    rows = state.where(F.col("cid").isNotNull()).select(
        "cid", "size", "centre", F.pmod(F.xxhash64("cid"), F.lit(parts)).cast("int").alias("__part"),
        F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(stacks)).cast("int").alias("__stack"))
    # A cluster goes to every part's task on its stack, and to those of its own part on the other stacks.
    tasks = [F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: i * stacks + F.col("__stack"))]
    tasks += [F.transform(F.sequence(F.lit(0), F.lit(stacks - 1)), lambda j: F.col("__part") * stacks + j)]
    sent = rows.withColumn("__task", F.explode(F.array_union(*tasks))).select(
        "cid", "size", "centre", "__task", (F.floor(F.col("__task") / stacks) == F.col("__part")).alias("__seeks"),
        (F.col("__task") % stacks == F.col("__stack")).alias("__found"))
    cid = T.StructField("cid", state.schema["cid"].dataType)
    fields = [cid, T.StructField("h2", T.DoubleType()), T.StructField("keep", cid.dataType), T.StructField("gone", cid.dataType)]

    def least_edges(batches):
        found = [pdf for pdf in batches if len(pdf)]
        if found:
            rows = pd.concat(found).sort_values("cid")
            seek, among = (np.flatnonzero(rows[c].to_numpy()) for c in ("__seeks", "__found"))
            h2, at = _sought(rows["size"].to_numpy(dtype=float), np.stack(rows["centre"].to_list()), seek, among, reach * reach)
            ids = rows["cid"].to_numpy()
            yield _edges(ids[seek], ids, h2, at)

    ends = _dealt(sent, parts * stacks).mapInPandas(least_edges, T.StructType(fields))
    return ends.groupBy("cid").agg(F.min(F.struct("h2", "keep", "gone")).alias("e"))


def _sought(n: np.ndarray, c: np.ndarray, seek: np.ndarray, among: np.ndarray, limit: float, rows: int = 512) -> tuple:
    """(h2, at) of the places ``seek``: least squared height up to ``limit`` to one of the places ``among`` but itself and
    that place, of equal ones the first; inf and -1 without any.

    Leaves hold clusters of like size.  A leaf is compared with those only whose height to its box is less than what they
    have found so far.
    """
    best = np.full(len(n), np.inf), np.full(len(n), -1)
    kind = np.frexp(n[among])[1] // 2
    leaves = [x[y] for x in (among[kind == k] for k in np.unique(kind)) for y in _leaves(c[x], rows)]
    with np.errstate(all="ignore"):
        low, high, least = (np.array([f(x[y], axis=0) for y in leaves]) for f, x in ((np.min, c), (np.max, c), (np.min, n)))
        for part in _leaves(c[seek], 4 * rows) if len(leaves) else []:
            here = seek[part]
            bound = np.zeros((len(leaves), len(here)))
            for axis in range(c.shape[1]):
                x = c[here, axis]
                gap = np.maximum(0.0, np.maximum(low[:, axis, None] - x, x - high[:, axis, None]))
                bound += gap * gap
            # A little to spare; what counts is the height of each pair.
            bound *= 2.0 * (1 - 1e-9) * least[:, None] * n[here] / (least[:, None] + n[here])
            np.nan_to_num(bound, copy=False, nan=0.0)
            for y in np.argsort(bound.mean(axis=1), kind="stable").tolist():
                near = here[bound[y] <= np.minimum(best[0][here], limit)]
                if len(near):
                    _compare(n, c, n, c, near, leaves[y], False, limit, best)
    return best[0][seek], best[1][seek]


def _leaves(points: np.ndarray, rows: int = 512) -> list[np.ndarray]:
    """Places of the points in leaves of at most ``rows``, halved along the widest coordinate."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        at = stack.pop()
        if len(at) <= rows:
            out.append(np.sort(at))
            continue
        axis = int(np.argmax(np.ptp(points[at], axis=0)))
        order = np.argpartition(points[at, axis], len(at) // 2)
        stack += [at[order[:len(at) // 2]], at[order[len(at) // 2:]]]
    return out


def _nearest(na: np.ndarray, ca: np.ndarray, nb: np.ndarray, cb: np.ndarray, same: bool, limit: float) -> tuple[tuple, tuple]:
    """(h2, at) of the rows of a, then of b: least squared height up to ``limit`` to a row of the other side and that
    row's place, of equal ones the first; inf and -1 without any.

    Two leaves are compared only if their boxes allow a height less than what their rows have found.
    """
    a = np.full(len(na), np.inf), np.full(len(na), -1)
    b = a if same else (np.full(len(nb), np.inf), np.full(len(nb), -1))
    mine = _leaves(ca)
    _meet(na, ca, nb, cb, mine, mine if same else _leaves(cb), same, limit, a, b)
    return a, b


def _meet(na, ca, nb, cb, mine: list[np.ndarray], other: list[np.ndarray], same: bool, limit: float, a: tuple, b: tuple) -> None:
    """Bring the pairs of leaves of a with leaves of b into ``a`` and ``b``; with ``same`` both are one table, and ``other``
    begins with ``mine``."""
    with np.errstate(all="ignore"):
        low, high, least = (np.array([f(x[y], axis=0) for y in other]) for f, x in ((np.min, cb), (np.max, cb), (np.min, nb)))
        for x, rows in enumerate(mine):
            gap = np.maximum(0.0, np.maximum(low - ca[rows].max(axis=0), ca[rows].min(axis=0) - high))
            few = na[rows].min()
            # The boxes are compared with a little to spare; what counts is the height of each pair.
            bound = np.nan_to_num(2.0 * few * least / (few + least) * (gap * gap).sum(axis=1) * (1 - 1e-9), nan=0.0)
            for y in np.argsort(bound, kind="stable").tolist():
                if bound[y] > limit:
                    break
                if (same and y < x) or bound[y] > max(a[0][rows].max(), b[0][other[y]].max()):
                    continue
                _compare(na, ca, nb, cb, rows, other[y], same and x == y, limit, a, b)


def _compare(na, ca, nb, cb, rows: np.ndarray, cols: np.ndarray, diagonal: bool, limit: float, a: tuple, b: tuple | None = None) -> None:
    """Bring the pairs of two leaves into ``a`` and ``b``.  Products bound all heights from below; the few pairs that can
    be the least of a row or column are computed by differences.  Without ``b`` only the rows, of one table with the
    columns, look for a partner other than themselves."""
    p, q, n, m = ca[rows], cb[cols], na[rows], nb[cols]
    middle = np.nan_to_num(p.mean(axis=0), posinf=0.0, neginf=0.0)
    cp, cq = p - middle, q - middle
    sp, sq = (cp * cp).sum(axis=1), (cq * cq).sum(axis=1)
    spare = 1e-12
    one_p, one_q = np.ones((len(p), 1)), np.ones((len(q), 1))
    low = np.hstack([cp, (1 - spare) * sp[:, None], one_p]) @ np.hstack([-2.0 * cq, one_q, (1 - spare) * sq[:, None]]).T
    low /= (0.5 / n)[:, None] + 0.5 / m if n.min() < n.max() or m.min() < m.max() else 0.5 / n[0] + 0.5 / m[0]
    if b is None:
        self_i = np.searchsorted(cols, rows)
        self_i[self_i == len(cols)] = 0
        low[cols[self_i] == rows, self_i[cols[self_i] == rows]] = np.inf
    elif diagonal:
        np.fill_diagonal(low, np.inf)
    slack = 2 * spare / (0.5 / n.max() + 0.5 / m.max()) * (sp.max() + sq.max())
    least_p = np.fmin.reduce(low, axis=1)
    by_row = np.fmin(np.minimum(a[0][rows], limit), least_p + slack)
    some_p = np.flatnonzero(least_p <= by_row)
    if b is None:
        if not np.isfinite(slack):  # NaN may stand for a small height
            some_p, by_row = np.arange(len(p)), np.full(len(p), np.inf)
        i, j = np.nonzero(~(low[some_p] > by_row[some_p, None]))
        i = some_p[i]
        _bring(n, m, p, q, rows, cols, *(x[rows[i] != cols[j]] for x in (i, j)), limit, a)
        return
    least_q = np.fmin.reduce(low, axis=0)
    by_col = np.fmin(np.minimum(b[0][cols], limit), least_q + slack)
    some_q = np.flatnonzero(least_q <= by_col)
    if 2 * (len(some_p) + len(some_q)) < len(p) + len(q) and np.isfinite(slack):  # else NaN may stand for a small height
        (i, j), (k, l) = np.nonzero(low[some_p] <= by_row[some_p, None]), np.nonzero(low[:, some_q] <= by_col[some_q])
        i, j = np.concatenate([some_p[i], k]), np.concatenate([j, some_q[l]])
    else:
        i, j = np.nonzero(~(low > np.maximum(by_row[:, None], by_col)))
    if diagonal:
        i, j = i[i != j], j[i != j]
    _bring(n, m, p, q, rows, cols, i, j, limit, a, b)


def _bring(n, m, p, q, rows, cols, i: np.ndarray, j: np.ndarray, limit: float, a: tuple, b: tuple | None = None) -> None:
    """Heights of the pairs ``i``, ``j`` of two leaves by differences, brought into ``a`` and ``b``."""
    h2 = np.zeros(len(i))
    for axis in range(p.shape[1]):
        step = p[i, axis] - q[j, axis]
        h2 += step * step
    h2 *= 2.0 * n[i] * m[j] / (n[i] + m[j])
    i, j, h2 = rows[i[h2 <= limit]], cols[j[h2 <= limit]], h2[h2 <= limit]
    for (best, at), here, there in ((a, i, j), (b, j, i)) if b is not None else ((a, i, j),):
        order = np.lexsort((there, h2, here))
        order = order[np.diff(here[order], prepend=-1) != 0]
        here, there, least = here[order], there[order], h2[order]
        nearer = (least < best[here]) | ((least == best[here]) & (there < at[here]))
        best[here[nearer]], at[here[nearer]] = least[nearer], there[nearer]


def _heights(na: np.ndarray, ca: np.ndarray, nb: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """Squared Ward heights of all pairs; NaN counts as infinitely far."""
    gap = np.zeros((len(na), len(nb)))
    for axis in range(ca.shape[1]):
        step = ca[:, axis, None] - cb[None, :, axis]
        gap += step * step
    out = 2.0 * na[:, None] * nb[None, :] / (na[:, None] + nb[None, :]) * gap
    out[np.isnan(out)] = np.inf
    return out


def _edges(cid: np.ndarray, partners: np.ndarray, h2: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    near = at >= 0
    near[near] &= partners[at[near]] != cid[near]
    mine, other = cid[near], partners[at[near]]
    first = mine < other
    return pd.DataFrame({"cid": mine, "h2": h2[near], "keep": np.where(first, mine, other), "gone": np.where(first, other, mine)})


def _merge_round(state: DataFrame, count: int, reach: float) -> DataFrame:
    """Reciprocal nearest pairs (keep, gone) whose Ward height is at most ``reach``."""
    best = _nearest_partners(state, count, reach)
    both = best.groupBy(F.col("e.keep").alias("keep"), F.col("e.gone").alias("gone")).agg(F.count(F.lit(1)).alias("c"))
    return both.where(F.col("c") == 2).select("keep", "gone")


def _merge_block(block: DataFrame, height: float) -> DataFrame:
    """(keep, gone) of all merges up to ``height`` among the clusters of one block that has no others around it; ``keep`` stays."""
    cid = block.schema["cid"].dataType

    def merges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        ids = pdf["cid"].to_numpy()
        last = _last_places(pdf["size"].to_numpy(dtype=float), np.stack(pdf["centre"].to_list()), height)
        gone = last != np.arange(len(ids))
        return pd.DataFrame({"keep": ids[last[gone]], "gone": ids[gone]})

    rows = block.where(F.col("cid").isNotNull())
    return rows.groupBy("__block").applyInPandas(merges, T.StructType([T.StructField("keep", cid), T.StructField("gone", cid)]))


def _last_places(size: np.ndarray, centre: np.ndarray, height: float) -> np.ndarray:
    """Place of the cluster that each cluster belongs to after all merges up to ``height``.

    After a round the merged clusters, and those that lost their partner, search anew among leaves;
    clusters that kept theirs take a nearer one that such a search meets.
    """
    alive, last, steps = np.arange(len(size)), np.arange(len(size)), []
    (h2, at), _ = _nearest(size, centre, size, centre, True, math.inf)
    while True:
        here = np.arange(len(alive))
        k = here[(at[at] == here) & (here < at) & (h2 <= height * height)]
        if not len(k):
            break
        g = at[k]
        total = size[k] + size[g]
        centre[k] = centre[k] * (size[k] / total)[:, None] + centre[g] * (size[g] / total)[:, None]
        size[k] = total
        steps.append((alive[k], alive[g]))
        left, moved = np.ones(len(alive), dtype=bool), np.zeros(len(alive), dtype=bool)
        left[g], moved[k], moved[g] = False, True, True
        lost = (moved | moved[at])[left]
        place = np.cumsum(left) - 1
        alive, size, centre, h2, at = alive[left], size[left], centre[left], h2[left], place[at[left]]
        search, still = np.flatnonzero(lost), np.flatnonzero(~lost)
        h2[search], at[search] = np.inf, -1
        near = [search[x] for x in _leaves(centre[search])]
        rest = [still[x] for x in _leaves(centre[still])] if len(still) else []
        _meet(size, centre, size, centre, near, near + rest, True, math.inf, (h2, at), (h2, at))
    for k, g in reversed(steps):
        last[g] = last[k]
    return last


def ward_clusters(vectors: DataFrame, id_col: str, height: float, start: float | None = None) -> DataFrame:
    """Ward (minimum variance) clusters cut at ``height``: ``(id, cluster)``.

    ``cluster`` is the smallest member id.  Ward linkage is reducible, so every
    reciprocal-nearest pair may be merged at once.  Distributed rounds run at ``height``, or at
    merge heights that grow from ``start``, until no pair is left below the cut.
    Clusters that fit one block (``BLOCK``) are merged to the end by its task.
    Exact copies collapse first.  Rounds leave their merges; labels follow them at the end.
    """
    copies = vectors.groupBy("point").agg(F.min(id_col).alias("cid"), F.count(F.lit(1)).alias("size"))
    points = materialise(copies.select("cid", "size", F.col("point").alias("centre")))
    state, count, done = points, points.count(), []
    reach = min(height, start if start is not None else height)
    while count > BLOCK:
        merges = materialise(_merge_round(state, count, reach))
        merged = merges.count()
        if merged:
            new_state = materialise(_merged(state, merges))
            if state is not points:
                discard(state)
            state = new_state
            done.append(merges)
        if not merged and reach >= height:
            break
        if merged * 20 < count:
            reach = min(height, reach * 4)  # few pairs left this close; any reciprocal pair may merge
        count -= merged
    if count <= BLOCK:
        done.append(_merge_block(state.withColumn("__block", F.lit(0)), height))
    ends = _last_names(done, copies.select(F.col("cid").alias("keep"), F.col("cid").alias("gone")).limit(0))
    named = points.join(ends.withColumnRenamed("gone", "cid"), "cid", "left").select(
        F.col("centre").alias("point"), "size", F.coalesce("keep", "cid").alias("cluster"))
    out = materialise(_of_points(vectors, id_col, named).select(id_col, "cluster"))
    discard(points, state, ends, *done)
    return out


def _of_points(vectors: DataFrame, id_col: str, named: DataFrame) -> DataFrame:
    """Every row of ``vectors`` with the cluster of its point; ``named`` has one row (point, size, cluster) per point.

    A point with many copies may hold a large share of the rows: these few points are attached by salts first.  The
    others may be as many as the rows, so they are never broadcast nor multiplied by salts.
    """
    hot = named.where(F.col("size") > COPIES).select("point", "cluster", F.lit(True).alias("__hot"))
    tried = attach_stats(vectors.select(id_col, "point"), hot, ["point"])
    rest = tried.where(F.col("__hot").isNull()).drop("cluster", "__hot")
    return tried.where("__hot").drop("__hot").unionByName(
        null_safe_join(rest, named.select("point", "cluster").hint("merge"), ["point"], "left"))


def _merged(state: DataFrame, merges: DataFrame) -> DataFrame:
    target = merges.select(F.col("gone").alias("cid"), F.col("keep").alias("__to"))
    moved = state.join(target, "cid", "left").withColumn("cid", F.coalesce("__to", "cid"))
    total = F.sum("size").over(Window.partitionBy("cid"))  # pairs only: at most two rows per cid
    weighted = moved.withColumn("__share", F.col("size") / total)
    halves = weighted.groupBy("cid").agg(
        F.sum("size").alias("size"),
        F.collect_list(F.struct("__share", "centre")).alias("__parts"))
    blend = F.aggregate(
        F.slice("__parts", 2, 1),
        F.transform(F.get("__parts", F.lit(0))["centre"], lambda v: v * F.get(F.col("__parts"), F.lit(0))["__share"]),
        lambda acc, p: F.zip_with(acc, p["centre"], lambda u, v: u + v * p["__share"]))
    return halves.select("cid", "size", blend.alias("centre"))


def _last_names(rounds: Sequence[DataFrame], none: DataFrame) -> DataFrame:
    """(gone, keep) with ``keep`` the name after all rounds: chains of names are halved until none is left."""
    links = materialise(reduce(DataFrame.unionByName, rounds, none))
    while len(rounds) > 1:  # names of one round are the last ones
        after = links.select(F.col("gone").alias("keep"), F.col("keep").alias("__to"))
        if links.join(after, "keep", "left_semi").isEmpty():
            return links
        longer = materialise(links.join(after, "keep", "left").select("gone", F.coalesce("__to", "keep").alias("keep")))
        discard(links)
        links = longer
    return links


def ward_certificate(vectors: DataFrame, id_col: str, clusters: DataFrame, height: float, cluster: str = "cluster",
                     tolerance: float = 1e-9) -> DataFrame:
    """One row that tells whether ``clusters`` can be the Ward partition of ``vectors`` cut at ``height``.

    n             points with a cluster
    missing       points without one, and ids in ``clusters`` that are no points or come twice
    misnamed      clusters not called by their smallest member
    too_close     clusters with another one at a Ward height of ``height`` or less (the cut stopped early)
    too_loose     clusters whose sum of squares exceeds what merges of at most ``height`` can add up to
                  (each adds at most height^2 / 2; copies of a point merge for nothing)
    split_copies  points whose copies lie in several clusters

    Nothing here looks at how the clusters came about: sizes, centres and sums of squares are recomputed.
    """
    named = clusters.select(F.col(id_col), F.col(cluster).alias("__c"))
    sides = vectors.select(id_col, "point", F.lit(1).alias("__p")).unionByName(
        named.withColumns({"point": F.lit(None).cast(vectors.schema["point"].dataType), "__p": F.lit(0)}).select(
            id_col, "point", "__p", "__c"), allowMissingColumns=True)
    ids = materialise(sides.groupBy(id_col).agg(
        F.max("point").alias("point"), F.sum("__p").alias("__points"), F.sum(1 - F.col("__p")).alias("__names"),
        F.max("__c").alias("__c")))
    whole = (F.col("__points") == 1) & (F.col("__names") == 1) & F.col("__c").isNotNull()
    missing = ids.agg(F.count(F.when(whole, 1)).alias("n"), F.count(F.when(~whole, 1)).alias("missing"))
    members = ids.where(whole)
    copies = members.groupBy("point").agg(F.count_distinct("__c").alias("__k"))
    split = copies.agg(F.count(F.when(F.col("__k") > 1, 1)).alias("split_copies"))
    # Distinct points first: a cluster of many copies is one row with a weight.
    heavy = members.groupBy("__c", "point").agg(F.count(F.lit(1)).alias("__w"), F.min(id_col).alias("__first"))
    axis = heavy.select("__c", "__w", F.posexplode("point").alias("axis", "v"))
    sums = axis.groupBy("__c", "axis").agg((F.sum(F.col("v") * F.col("__w")) / F.sum("__w")).alias("mean"))
    spread = attach_stats(axis, sums, ["__c", "axis"]).groupBy("__c").agg(
        F.sum(F.col("__w") * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))).alias("__ss"))
    centre = sums.groupBy("__c").agg(F.array_sort(F.collect_list(F.struct("axis", "mean"))).alias("__m"))
    sizes = heavy.groupBy("__c").agg(F.sum("__w").alias("size"), F.count(F.lit(1)).alias("__d"), F.min("__first").alias("__first"))
    state = materialise(sizes.join(centre, "__c").join(spread, "__c").select(
        F.col("__c").alias("cid"), "size", F.col("__m.mean").alias("centre"), "__d", "__ss", "__first"))
    limit = (F.col("__d") - 1) * (height * height / 2)
    shape = state.agg(F.count(F.lit(1)).alias("n_clusters"), F.count(F.when(F.col("cid") != F.col("__first"), 1)).alias("misnamed"),
                      F.count(F.when(F.col("__ss") > limit + tolerance, 1)).alias("too_loose"))
    near = _nearest_partners(state, state.count(), height * (1 - tolerance))
    close = near.agg(F.count(F.lit(1)).alias("too_close"))
    return missing.select("n", "missing", *[part.scalar().alias(name) for part, name in (
        (shape.select("n_clusters"), "n_clusters"), (shape.select("misnamed"), "misnamed"), (close, "too_close"),
        (shape.select("too_loose"), "too_loose"), (split, "split_copies"))])


# --- after the cut ---------------------------------------------------------------------

def small_clusters(df: DataFrame, id_col: str, cluster: str, min_size: int = 100) -> DataFrame:
    """Label clusters below ``min_size`` as outlier, number the others by first appearance.

    Works on one row per cluster; members are only touched by the final join.
    """
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("__n"), F.min(id_col).alias("__first"))
    kept = sizes.where(F.col("__n") >= min_size)
    names = row_numbers(kept, ["__first"], "__name").select(cluster, (F.col("__name") + 1).cast("string").alias("__name"))
    named = attach_stats(df.select(id_col, cluster), names, [cluster])
    return named.select(id_col, cluster, F.coalesce("__name", F.lit(OUTLIER)).alias("label"))


def silhouette(vectors: DataFrame, id_col: str, cluster: str, block_rows: int = 50000) -> DataFrame:
    """Silhouette of every point: (b - a) / max(a, b) with mean Euclidean distances.

    The definition needs every distance, but no pair is ever emitted: points are
    hashed into blocks, one task gets two blocks and returns distance sums per
    (point, cluster), of both blocks' points.  The number of blocks is ``BLOCKS`` until
    they would hold more than ``block_rows`` points, so up to there a point is sent
    equally often however many there are.  Points alone in their cluster get 0.
    """
    rows = _tiles(vectors.select(id_col, cluster, "point"), id_col, block_rows)
    fields = [vectors.schema[id_col], T.StructField("__other", vectors.schema[cluster].dataType),
              T.StructField("__sum", T.DoubleType())]

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        # Clusters one after the other; codes, as a label may be null.
        pdf = pdf.assign(__code=pd.factorize(pdf[cluster], use_na_sentinel=False)[0]).sort_values("__code")
        own, other = pdf[pdf["__block"] == i], pdf[pdf["__block"] == j]
        if own.empty or other.empty:
            return pd.DataFrame({id_col: own[id_col].iloc[:0], "__other": other[cluster].iloc[:0], "__sum": []})
        a, b = (np.stack(side["point"].to_list()).astype(float) for side in (own, other))
        by_other, by_own = _distance_sums(a, b, own["__code"].to_numpy(), other["__code"].to_numpy())
        sides = [(own, other, by_other)] if i == j else [(own, other, by_other), (other, own, by_own)]
        return pd.concat([pd.DataFrame({
            id_col: np.repeat(x[id_col].to_numpy(), total.shape[1]),
            "__other": np.tile(y[cluster].to_numpy()[_firsts(y["__code"].to_numpy())], len(x)), "__sum": total.ravel()})
            for x, y, total in sides])

    partial = rows.groupBy("__i", "__j").applyInPandas(sums, T.StructType(fields))
    partial = partial.where(F.col("__other").isNotNull())  # points without a cluster are nobody's neighbours
    per = partial.groupBy(id_col, "__other").agg(F.sum("__sum").alias("__sum"))
    sizes = vectors.groupBy(F.col(cluster).alias("__other")).agg(F.count(F.lit(1)).alias("__n"))
    per = attach_stats(per, sizes, ["__other"])
    own = null_safe_join(per, vectors.select(id_col, F.col(cluster).alias("__mine")), [id_col])
    same = F.col("__other").eqNullSafe(F.col("__mine"))
    out = own.groupBy(id_col).agg(
        F.first("__mine").alias(cluster),
        F.max(F.when(same, F.col("__n"))).alias("__size"),
        F.max(F.when(same & (F.col("__n") > 1), F.col("__sum") / F.greatest(F.col("__n") - 1, F.lit(1)))).alias("a"),
        F.min(F.when(~same, F.col("__sum") / F.col("__n"))).alias("b"))
    s = F.when(F.col("__size") == 1, 0.0).otherwise(
        F.try_divide(F.col("b") - F.col("a"), F.nullif(F.greatest("a", "b"), F.lit(0.0))))
    return out.select(id_col, cluster, s.alias("silhouette"))


def _tiles(vectors: DataFrame, id_col: str, block_rows: int) -> DataFrame:
    """Every point with the pairs of blocks (__i, __j), __i <= __j, that its own block is in."""
    n = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    blocks = F.greatest(F.lit(BLOCKS), F.ceil(n / F.lit(float(block_rows))).cast("int"))
    base = vectors.withColumn("__nb", blocks).withColumn("__block", F.pmod(F.xxhash64(id_col), F.col("__nb")).cast("int"))
    return base.withColumn("__at", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1))).select(
        *vectors.columns, "__block", F.least("__block", "__at").alias("__i"), F.greatest("__block", "__at").alias("__j"))


def _firsts(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(codes, prepend=-1))


def _distance_sums(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Sums of distances (row of a, code in b) and (row of b, code in a); codes ascend.  A few rows at a time bound memory.

    Squared distances come from products.  Where these would cancel (close points far out), and where they
    aren't finite, the coordinates are subtracted.
    """
    middle = np.nan_to_num(b.mean(axis=0), posinf=0.0, neginf=0.0)
    ca, cb = a - middle, b - middle
    na, nb = (ca * ca).sum(axis=1), (cb * cb).sum(axis=1)
    at_a, at_b = _firsts(of_a), _firsts(of_b)
    code_a = np.repeat(np.arange(len(at_a)), np.diff(np.append(at_a, len(a))))
    by_b, by_a = np.empty((len(a), len(at_b))), np.zeros((len(b), len(at_a)))
    rows = max(1, cells // len(b))
    for i in range(0, len(a), rows):
        norms = na[i:i + rows, None] + nb[None, :]
        gap = norms - 2.0 * (ca[i:i + rows] @ cb.T)
        x, y = np.nonzero(~(gap > 1e-6 * norms) | ~np.isfinite(gap))
        for k in range(0, len(x), 1 << 16):
            step = a[i + x[k:k + (1 << 16)]] - b[y[k:k + (1 << 16)]]
            gap[x[k:k + (1 << 16)], y[k:k + (1 << 16)]] = (step * step).sum(axis=1)
        np.sqrt(gap, out=gap)
        by_b[i:i + rows] = np.add.reduceat(gap, at_b, axis=1)
        codes = code_a[i:i + rows]
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        by_a[:, codes[starts]] += np.add.reduceat(gap, starts, axis=0).T
    return by_b, by_a


def mean_silhouette(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("silhouette").alias("mean_silhouette"))


def cluster_twice(series: DataFrame, key: str, ts: str, value: str, first_height: float = 0.7,
                  second_height: float = 0.5, min_size: int = 100, **ward) -> tuple[DataFrame, DataFrame]:
    """Cluster, drop households of small clusters, cluster the rest again.

    Features belong to one household each, so the second pass reuses them.
    Returns ``(id, cluster)`` of the second pass and the ids dropped after the first.
    """
    vectors = materialise(as_vectors(qaf_features(series, key, ts, value), key))
    labels = small_clusters(ward_clusters(vectors, key, first_height, **ward), key, "cluster", min_size)
    dropped = labels.where(F.col("label") == OUTLIER).select(key)
    kept = vectors.join(dropped, key, "left_anti")
    second = small_clusters(ward_clusters(kept, key, second_height, **ward), key, "cluster", 1)
    return second.select(key, F.col("label").alias("cluster")), dropped


def household_flags(households: DataFrame, id_col: str, removed: DataFrame, heavily_imputed: DataFrame,
                    cluster_outliers: DataFrame, clusters: DataFrame, group: str,
                    dropped_groups: Sequence[str] = DROPPED_GROUPS) -> DataFrame:
    """Household table with the four removal reasons, ``remove`` and ``cluster``.

    ``removed`` has (id_removed, motive); the other inputs carry ``id_col``.
    """
    reasons = removed.groupBy(F.col("id_removed").alias(id_col)).agg(
        F.max((F.col("motive") == MOTIVE_OUTLIERS).cast("int")).alias("__o"),
        F.max((F.col("motive") == MOTIVE_MISSING).cast("int")).alias("__n"))
    out = households.join(reasons, id_col, "left")
    for name, ids in (("__i", heavily_imputed), ("__c", cluster_outliers)):
        out = out.join(ids.select(id_col).distinct().withColumn(name, F.lit(1)), id_col, "left")
    out = out.join(clusters.select(id_col, "cluster"), id_col, "left")
    flags = {"outlier_datacleaning": "__o", "NA_datacleaning": "__n", "outlier_preprocessing": "__i",
             "outlier_clustering": "__c"}
    out = out.withColumns({name: F.coalesce(F.col(c), F.lit(0)) == 1 for name, c in flags.items()})
    any_reason = F.greatest(*[F.col(n).cast("int") for n in flags]) == 1
    unusable = F.coalesce(F.col(group).isin(*dropped_groups), F.lit(False))
    return out.select(*households.columns, *flags, (any_reason | unusable).alias("remove"), "cluster")
