import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlab.operators import association as assoc, cluster as cl


def naive_ward(points, height):
    groups = [[i] for i in range(len(points))]
    while len(groups) > 1:
        best = min(((2 * len(a) * len(b) / (len(a) + len(b))) ** .5
                    * np.linalg.norm(points[a].mean(0) - points[b].mean(0)), i, j)
                   for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best[0] > height:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def partition(rows):
    out = {}
    for r in rows:
        out.setdefault(r["cluster"], set()).add(r["id"])
    assert all(c == min(m) for c, m in out.items())
    return {frozenset(m) for m in out.values()}


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    blobs = [rng.normal(c, .05, size=(14, 4)) for c in (0, .6)]
    stray = rng.uniform(-1, 2, size=(3, 4))
    pts = np.concatenate([*blobs, stray])
    return np.concatenate([pts, pts[:4]])  # exact copies


def vectors(spark, pts):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id long, point array<double>")


@pytest.mark.parametrize("height", [.15, .7])
@pytest.mark.parametrize("start", [None, .1])
def test_ward_equals_greedy_merges(spark, points, height, start):
    out = cl.ward_clusters(vectors(spark, points), "id", height, start=start)
    assert partition(out.collect()) == naive_ward(points, height)


@pytest.mark.parametrize("block", [6, 1024])
def test_ward_rounds_end_where_one_block_is_left(spark, points, monkeypatch, block):
    left = []
    round_of = cl._merge_round
    monkeypatch.setattr(cl, "BLOCK", block)
    monkeypatch.setattr(cl, "_merge_round", lambda state, *a: left.append(state.count()) or round_of(state, *a))
    rows = [*points[5:20], *points[28:31], points[10]]
    out = cl.ward_clusters(vectors(spark, rows), "id", .7, start=.2)
    assert partition(out.collect()) == naive_ward(np.array(rows), .7)
    assert all(n > block for n in left) and bool(left) == (block == 6)


@pytest.mark.parametrize("step", [None, .25])
def test_nearest_by_leaves_equals_all_heights(step):
    rng = np.random.default_rng(6)
    a, b = (rng.normal(size=(n, 3)) for n in (1300, 700))
    if step:  # ties and copies
        a, b = (np.round(x / step) * step for x in (a, b))
    a[:4], b[:2] = [[np.nan] * 3, [np.inf] * 3, [1e200] * 3, [1e8] * 3], [[1e200] * 3, [1e8 + 1] * 3]
    na, nb = (rng.integers(1, 4, len(x)).astype(float) for x in (a, b))
    with np.errstate(all="ignore"):
        full, own = cl._heights(na, a, nb, b), cl._heights(na, a, na, a)
    np.fill_diagonal(own, np.inf)
    for limit in (.01, 1e9):
        for (h2, at), want in zip((*cl._nearest(na, a, nb, b, False, limit), cl._nearest(na, a, na, a, True, limit)[0]), (full, full.T, own)):
            near = want.min(axis=1) <= limit
            assert (h2 == np.where(near, want.min(axis=1), np.inf)).all() and (at == np.where(near, want.argmin(axis=1), -1)).all()


@pytest.mark.parametrize("step", [None, .25])
def test_sought_partners_equal_all_heights(step):
    rng = np.random.default_rng(6)
    c = rng.normal(size=(1500, 3))
    if step:  # ties and copies
        c = np.round(c / step) * step
    c[:5] = [[np.nan] * 3, [np.inf] * 3, [1e200] * 3, [1e8] * 3, [1e8 + 1] * 3]
    n = rng.integers(1, 40, len(c)).astype(float)
    seek, among = np.arange(0, 1500, 2), np.flatnonzero(np.arange(1500) % 3)
    with np.errstate(all="ignore"):
        want = cl._heights(n[seek], c[seek], n[among], c[among])
    want[seek[:, None] == among] = np.inf
    for limit in (.01, 1e9):
        h2, at = cl._sought(n, c, seek, among, limit, 32)
        near = want.min(axis=1) <= limit
        assert (h2 == np.where(near, want.min(axis=1), np.inf)).all() and (at == np.where(near, among[want.argmin(axis=1)], -1)).all()


def test_sought_partners_are_looked_for_in_near_leaves(monkeypatch):
    met = []
    compare = cl._compare
    monkeypatch.setattr(cl, "_compare", lambda na, ca, nb, cb, rows, cols, *rest: met.append(len(rows) * len(cols)) or compare(na, ca, nb, cb, rows, cols, *rest))
    c, every = np.random.default_rng(1).normal(size=(4000, 4)), np.arange(4000)
    cl._sought(np.ones(4000), c, every, every, 1e9, 64)
    assert sum(met) < 4000 * 4000 / 8


def test_rounds_search_every_stack(spark, monkeypatch):
    monkeypatch.setattr(cl, "SIDE_ROWS", 8)  # three stacks
    pts = np.random.default_rng(3).normal(size=(150, 4))
    state = spark.createDataFrame([(i, 1, [float(v) for v in p]) for i, p in enumerate(pts)], "cid long, size long, centre array<double>")
    got = {r["cid"]: r["e"] for r in cl._nearest_partners(state, 150, 2.0).collect()}
    gap = ((pts[:, None] - pts[None]) ** 2).sum(axis=2)
    np.fill_diagonal(gap, np.inf)
    for i in range(150):
        j = int(gap[i].argmin())
        assert (i in got) == (gap[i, j] <= 4.0) and (i not in got or got[i][:] == (pytest.approx(gap[i, j]), min(i, j), max(i, j)))


@pytest.mark.parametrize("step", [None, .25])
def test_last_task_equals_greedy_merges(monkeypatch, step):
    leaves = cl._leaves
    monkeypatch.setattr(cl, "_leaves", lambda points: leaves(points, 8))
    pts = np.random.default_rng(11).normal(size=(120, 3))
    if step:
        pts = np.unique(np.round(pts / step) * step, axis=0)  # ties
    for height in (.8, 2.0):
        last = cl._last_places(np.ones(len(pts)), pts.copy(), height)
        assert {frozenset(np.flatnonzero(last == k).tolist()) for k in set(last)} == set(naive_ward(pts, height))


def test_last_task_compares_near_leaves_only(monkeypatch):
    leaves, meet, compare, every, met = cl._leaves, cl._meet, cl._compare, [], []

    def rounds(na, ca, nb, cb, mine, other, *rest):
        every.append(sum(map(len, mine)) * sum(map(len, other)))
        met.append(0)
        meet(na, ca, nb, cb, mine, other, *rest)

    def pairs(na, ca, nb, cb, rows, cols, *rest):
        met[-1] += len(rows) * len(cols)
        compare(na, ca, nb, cb, rows, cols, *rest)

    monkeypatch.setattr(cl, "_leaves", lambda points: leaves(points, 16))
    monkeypatch.setattr(cl, "_meet", rounds)
    monkeypatch.setattr(cl, "_compare", pairs)
    monkeypatch.setattr(cl, "_heights", None)  # no table of all heights
    pts = np.concatenate([50.0 * c + np.random.default_rng(c).normal(size=(64, 3)) for c in range(16)])
    cl._last_places(np.ones(len(pts)), pts, 2.0)
    assert len(every) > 5 and 2 * sum(met[1:]) < sum(every[1:])


def test_middling_sizes_need_no_round(spark, monkeypatch):
    monkeypatch.setattr(cl, "_merge_round", None)
    df = spark.range(9000).select("id", F.array((F.col("id") % 3) * 10.0 + F.col("id") * 1e-6).alias("point"))
    got = cl.ward_clusters(df, "id", 5.0).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r[:] for r in got} == {(0, 3000), (1, 3000), (2, 3000)}


def test_ward_step_is_dealt_over_tasks_and_needs_few_rounds(spark, monkeypatch):
    left = []
    round_of = cl._merge_round
    monkeypatch.setattr(cl, "BLOCK", 40)
    monkeypatch.setattr(cl, "_merge_round", lambda state, *a: left.append(state.count()) or round_of(state, *a))
    pts = np.random.default_rng(3).normal(size=(90, 4))
    out = cl.ward_clusters(vectors(spark, pts), "id", 3.0)
    assert partition(out.collect()) == naive_ward(pts, 3.0)
    assert all(b < a for a, b in zip(left, left[1:]))  # every round merges: none is spent on heights without pairs
    edges = cl._nearest_partners(spark.range(160).select(F.col("id").alias("cid"), F.lit(1).alias("size"), F.array(F.rand(1)).alias("centre")), 160, 1.0)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # small partitions aren't put together into one task


def test_only_points_of_many_copies_are_multiplied_by_salts(spark, points, monkeypatch):
    sent = []
    attach = cl.attach_stats
    monkeypatch.setattr(cl, "COPIES", 1, raising=False)
    monkeypatch.setattr(cl, "attach_stats", lambda rows, stats, keys: sent.append(stats.count()) or attach(rows, stats, keys))
    out = cl.ward_clusters(vectors(spark, points), "id", .7)
    assert partition(out.collect()) == naive_ward(points, .7)
    assert sent == [4]  # the driver would hold all others sixteen times


@pytest.mark.parametrize("height", [.15, .7])
def test_ward_certificate(spark, points, height):
    df = vectors(spark, points)
    groups = naive_ward(points, height)

    def certify(groups, name=min):
        rows = [(i, name(g)) for g in groups for i in g]
        return cl.ward_certificate(df, "id", spark.createDataFrame(rows, "id long, cluster long"), height).first().asDict()

    right = certify(groups)
    assert right["n"] == len(points) and right["n_clusters"] == len(groups)
    assert not any(right[c] for c in ("missing", "misnamed", "too_close", "too_loose", "split_copies"))
    large = max(groups, key=len)
    rest = [g for g in groups if g != large]
    assert certify(groups, max)["misnamed"] == sum(len(g) > 1 for g in groups)
    assert certify(rest)["missing"] == len(large)
    assert certify([*rest, *({i} for i in large)])["too_close"] > 1
    assert certify([frozenset(range(len(points)))])["too_loose"] == 1
    pair = next(g for g in groups if 0 in g)  # 0 and its copy, the fourth row from the end
    assert certify([*(g for g in groups if g != pair), pair - {0}, {0}])["split_copies"] == 1


def test_ward_certificate_of_nothing(spark):
    none = spark.createDataFrame([], "id long, point array<double>")
    got = cl.ward_certificate(none, "id", spark.createDataFrame([], "id long, cluster long"), .5).first()
    assert got["n"] == got["missing"] == got["n_clusters"] == got["too_close"] == 0


def test_pairs_within(spark, points):
    got = {(r["i"], r["j"]) for r in cl.pairs_within(vectors(spark, points), "id", .2).collect()}
    want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points))
            if np.linalg.norm(points[i] - points[j]) <= .2}
    assert got == want


def test_pairs_within_meet_in_blocks_not_as_rows(spark, monkeypatch):
    monkeypatch.setattr(cl, "BLOCK", 2000)  # six blocks
    monkeypatch.setattr(cl, "_leaves", lambda points, rows=64, leaves=cl._leaves: leaves(points, rows))
    pts = np.round(np.random.default_rng(7).normal(scale=.5, size=(1500, 2)), 2)  # crowded, with copies
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(pts)]
    rows += [(None, [0.0, 0.0]), (3, rows[3][1]), (1500, [0.0]), (1501, [0.01]), (1502, [float("nan"), 0.0]), (1503, [None, 0.0]), (1504, None)]
    found = cl.pairs_within(spark.createDataFrame(rows, "id long, point array<double>"), "id", .05)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in found.collect())
    gap = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(axis=2))
    want = [(i, j, gap[i, j]) for i, j in zip(*np.nonzero(gap <= .05)) if i < j]
    want += [x for x in want if 3 in x[:2]]  # the id that comes twice
    assert got == sorted([*want, (1500, 1501, pytest.approx(.01))])


def test_pairs_of_many_copies_come_a_piece_at_a_time():
    ids, points = np.arange(2000), np.zeros((2000, 3))
    sizes = [len(x) for x in cl._near_pairs((ids, points), (ids, points), True, .1, 1000)]
    assert sum(sizes) == 2000 * 1999 // 2 and max(sizes) <= 1000 + 512 ** 2


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_silhouette(spark, points, block_rows):
    labels = ["a"] * 14 + ["b"] * 14 + ["c", "c", "lonely"] + ["a"] * 4
    df = vectors(spark, points).join(spark.createDataFrame(list(enumerate(labels)), "id long, c string"), "id")
    got = {r["id"]: r["silhouette"] for r in cl.silhouette(df, "id", "c", block_rows).collect()}
    gap = np.linalg.norm(points[:, None] - points[None], axis=2)
    lab = np.array(labels)
    for i in range(len(points)):
        own = lab == lab[i]
        if own.sum() == 1:
            assert got[i] == 0
            continue
        a = gap[i][own].sum() / (own.sum() - 1)
        b = min(gap[i][lab == c].mean() for c in set(labels) if c != lab[i])
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_silhouette_sends_points_equally_often(spark):
    for n in (500, 40000):
        df = spark.range(n).select("id", F.array(F.rand(1)).alias("point"))
        sent = cl._tiles(df, "id", 50000).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("__i", "__j").alias("tiles"))
        assert sent.agg(F.count(F.lit(1)), F.min("n"), F.max("n"), F.min("tiles")).first()[:] == (n, 16, 16, 16)


def test_silhouette_without_labels_as_before(spark):
    df = spark.createDataFrame([(1, "a", [0.0]), (2, "a", [1.0]), (3, "b", [5.0]), (4, None, [2.0]), (5, None, [2.5])],
                               "id long, c string, point array<double>")
    got = {r["id"]: r["silhouette"] for r in cl.silhouette(df, "id", "c").collect()}
    assert got == {1: pytest.approx(.8), 2: pytest.approx(.75), 3: 0, 4: None, 5: None}


def test_distance_sums_of_close_points_far_out():
    rng = np.random.default_rng(5)
    a = np.concatenate([1e6 + rng.normal(scale=1e-4, size=(30, 8)), rng.normal(size=(30, 8)), np.full((4, 8), 1e6)])
    of = np.repeat([0, 2, 5], [30, 30, 4])
    gap = np.sqrt(((a[:, None] - a[None]) ** 2).sum(axis=2))
    want = np.stack([gap[:, of == c].sum(axis=1) for c in (0, 2, 5)], axis=1)
    for cells in (1, 640, 1 << 20):
        for got in cl._distance_sums(a, a, of, of, cells):
            assert got == pytest.approx(want, rel=1e-9, abs=0) and (got[-4:, 2] == 0).all()


def test_quantile_autocovariance(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=60)
    x[[3, 30]] = np.nan
    rows = [("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)] + [("short", 0, 1.0)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = {r["k"]: r.asDict() for r in cl.qaf_features(df, "k", "t", "v", lags=2).collect()}
    for lag in (1, 2):
        for a in (.1, .5, .9):
            for b in (.1, .5, .9):
                qa, qb = np.nanquantile(x, a), np.nanquantile(x, b)
                s = sum((x[t] <= qa) and (x[t + lag] <= qb) for t in range(60 - lag))
                assert got["a"][cl.feature_name(a, b, lag)] == pytest.approx(s / (60 - lag) - a * b)
    assert got["short"][cl.feature_name(.1, .1, 1)] is None
    with pytest.raises(Exception, match="lag must be smaller"):
        cl.qaf_features(df, "k", "t", "v", check_length=True).collect()
    with pytest.raises(ValueError):
        cl.qaf_features(df, "k", "t", "v", lags=0)


def test_small_clusters_are_renumbered(spark):
    rows = [(i, c) for i, c in enumerate("zzayyyzq")]
    df = spark.createDataFrame(rows, "id long, c string")
    got = {r["id"]: r["label"] for r in cl.small_clusters(df, "id", "c", 2).collect()}
    assert [got[i] for i in range(8)] == ["1", "1", "outlier", "2", "2", "2", "1", "outlier"]


def test_cluster_twice_drops_strays(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(12):
        v = np.cumsum(rng.normal(size=80)) if k < 6 else rng.normal(size=80)
        rows += [(f"h{k:02d}", t, float(u)) for t, u in enumerate(v)]
    rows += [("odd", t, float(t % 2)) for t in range(80)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    second, dropped = cl.cluster_twice(df, "k", "t", "v", min_size=2)
    assert {r[0] for r in dropped.collect()}.isdisjoint({r["k"] for r in second.collect()})
    assert second.count() + dropped.count() == 13


def test_both_passes_are_ward_partitions_with_rounds(spark, monkeypatch):
    rounds = []
    round_of = cl._merge_round
    monkeypatch.setattr(cl, "BLOCK", 12)
    monkeypatch.setattr(cl, "_merge_round", lambda *a: rounds.append(a) or round_of(*a))
    rng = np.random.default_rng(9)
    pts = np.concatenate([rng.normal(c, .05, size=(8, 2)) for c in (0, 1)] + [[[5.0, 5.0]]])
    first = cl.ward_clusters(vectors(spark, pts), "id", .7)
    kept = vectors(spark, pts).join(first.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(first, "cluster"), "id", "left_semi")
    for points, clusters, height in ((vectors(spark, pts), first, .7), (kept, cl.ward_clusters(kept, "id", .2), .2)):
        got = cl.ward_certificate(points, "id", clusters, height).first().asDict()
        assert not any(got[c] for c in ("missing", "misnamed", "too_close", "too_loose", "split_copies"))
    assert 0 < len(rounds) <= 6  # 17 and 16 points; rounds at low heights found nothing to merge


def test_household_flags(spark):
    hh = spark.createDataFrame([("a", "Affluent"), ("b", "ACORN-"), ("c", "Adversity"), ("d", None)], "id string, g string")
    removed = spark.createDataFrame([("a", "NA excess")], "id_removed string, motive string")
    none = hh.where("false").select("id")
    clusters = spark.createDataFrame([("c", "1"), ("d", "2")], "id string, cluster string")
    got = {r["id"]: r for r in cl.household_flags(hh, "id", removed, none, none, clusters, "g").collect()}
    assert {k: r["remove"] for k, r in got.items()} == {"a": True, "b": True, "c": False, "d": False}
    assert got["a"]["NA_datacleaning"] and got["c"]["cluster"] == "1" and got["a"]["cluster"] is None


def test_association_by_hand(spark):
    def rows(table):
        return [(f"r{i}", f"c{j}") for i, row in enumerate(table) for j, n in enumerate(row) for _ in range(n)]

    two = spark.createDataFrame(rows([[12, 5], [3, 10]]), "a string, b string")
    got = assoc.chi_square(two, "a", "b").first()
    n, d = 30, abs(12 * 10 - 5 * 3)
    assert got["chi2"] == pytest.approx(n * (d - n / 2) ** 2 / (17 * 13 * 15 * 15))
    assert assoc.chi_square(two, "a", "b", yates=False).first()["chi2"] == pytest.approx(n * d ** 2 / (17 * 13 * 15 * 15))

    table = np.array([[9, 0, 4, 7, 2], [1, 8, 3, 3, 6], [5, 5, 5, 5, 5]])
    df = spark.createDataFrame(rows(table), "a string, b string")
    expect = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    chi2 = ((table - expect) ** 2 / expect).sum()
    row = assoc.chi_square(df, "a", "b").first()
    assert row["chi2"] == pytest.approx(chi2) and row["dof"] == 8
    assert assoc.chi_square_p_value(df, "a", "b").first()["chi2"] == pytest.approx(chi2)
    n = table.sum()
    phi = max(0, chi2 / n - 8 / (n - 1))
    v = np.sqrt(phi / min(3 - 4 / (n - 1) - 1, 5 - 16 / (n - 1) - 1))
    assert assoc.cramers_v(df, "a", "b").first()["cramers_v"] == pytest.approx(v)
    plain = assoc.cramers_v(df, "a", "b", bias_correct=False).first()["cramers_v"]
    assert plain == pytest.approx(np.sqrt(chi2 / n / 2))
