"""The blocked (large-pool) physical paths equal the single-block paths."""

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from dualspace.operators import metrics as M
from dualspace.operators import decay, search, walk
from dualspace.session import cut_lineage
from dualspace.sources.fixtures import chunk_vectors, query_vectors, z_standin


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_scan_multi_block_equals_single_block(spark):
    c, q = chunk_vectors(spark, SF_SMALL), query_vectors(spark, SF_SMALL)
    one = search.anchors(c, q, 0.85, 3, scanned=search.scan(c, q, 3, 0.85))
    many = search.anchors(c, q, 0.85, 3, scanned=search.scan(c, q, 3, 0.85, chunk_block=7, query_block=1))
    assert _rows(one, "qid", "chunk_idx") == _rows(many, "qid", "chunk_idx")
    top1 = search.naive_topk(c, q, 5)
    top2 = search.naive_topk(c, q, 5, scanned=search.scan(c, q, 5, -1.0, chunk_block=5, query_block=1))
    assert _rows(top1, "qid", "chunk_idx", "rank") == _rows(top2, "qid", "chunk_idx", "rank")


def test_knn_multi_block_equals_single_block(spark):
    z, _ = z_standin(chunk_vectors(spark, SF_SMALL), 2)
    a = M.knn_graph(z, 10)
    b = M.knn_graph(z, 10, block=9)
    assert _rows(a, "i", "j", "rank") == _rows(b, "i", "j", "rank")


def _dense_walk(points, state, metric, seeds, qids, alpha=0.85, iterations=10):
    """The walk of one pool as plain matrices."""
    points = sorted(points, key=lambda r: r.chunk_idx)
    V = np.array([r.v for r in points])
    extra = (None,) * 4
    if metric == "bhattacharyya":
        C, L = np.array([r.cov for r in points]).reshape(len(V), V.shape[1], -1), np.array([r.logdet for r in points])
        extra = (C, C, L, L)
    K = np.exp(-M.block_distance(metric, V, V, state, *extra))
    P = K / K.sum(axis=1, keepdims=True)
    out = {}
    for q in qids:
        own = np.array([(q, r.chunk_idx) in seeds for r in points], float)
        v = own / own.sum() if own.sum() else np.full(len(V), 1 / len(V))
        pi = v
        for _ in range(iterations):
            pi = (1 - alpha) * v + alpha * pi @ P
        out.update({(q, r.chunk_idx): m for r, m in zip(points, pi)})
    return out


def test_walk_equals_dense_matrices_whatever_the_blocks(spark):
    c, q = chunk_vectors(spark, SF_SMALL), query_vectors(spark, SF_SMALL)
    z, lam = z_standin(c, 4)
    for metric, blocks in (("mahalanobis", ((4096, 256), (13, 1))), ("dot", ((20, 256),)), ("bhattacharyya", ((4096, 1), (30, 2)))):
        space = M.build_space(metric, z, lam, 4)
        seeds = search.anchors(c, q, 0.85, 3).select("pool_id", "qid", "chunk_idx")
        have = {(r.qid, r.chunk_idx) for r in seeds.collect()}
        state = {r.pool_id: r.s for r in space.state.collect()}
        pools, want = {}, {}
        for r in space.points.collect():
            pools.setdefault(r.pool_id, []).append(r)
        for r in q.select("pool_id", F.collect_list("qid").over(__import__("pyspark").sql.Window.partitionBy("pool_id")).alias("qids")).distinct().collect():
            want.update(_dense_walk(pools[r.pool_id], state[r.pool_id], metric, have, r.qids))
        for block, query_block in blocks:
            rows = walk.random_walk(space.points, space.state, metric, seeds, q.select("pool_id", "qid"),
                                    block=block, query_block=query_block).collect()
            got = {(r.qid, r.chunk_idx): r.mass for r in rows}
            assert len(rows) == len(got) and got.keys() == want.keys()
            assert max(abs(got[k] - want[k]) for k in want) < 1e-12, (metric, block)


def test_walk_with_string_ids(spark):
    c, q = chunk_vectors(spark, SF_SMALL), query_vectors(spark, SF_SMALL)
    z, lam = z_standin(c, 4)
    text = lambda df, *cols: df.withColumns({k: F.concat(F.lit("k"), F.lpad(F.col(k).cast("string"), 6, "0")) for k in cols})
    space = M.build_space("euclidean", z, lam, 4)
    seeds = search.strict_start_set(c, q, 0.8).select("pool_id", "qid", "chunk_idx")
    a = walk.random_walk(space.points, space.state, "euclidean", seeds, q.select("pool_id", "qid"))
    b = walk.random_walk(text(space.points, "chunk_idx"), space.state, "euclidean", text(seeds, "qid", "chunk_idx"),
                         text(q.select("pool_id", "qid"), "qid"))
    want = {("k%06d" % r.qid, "k%06d" % r.chunk_idx): r.mass for r in a.collect()}
    got = {(r.qid, r.chunk_idx): r.mass for r in b.collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_walk_uniform_restart_when_no_seed(spark):
    c, q = chunk_vectors(spark, SF_SMALL), query_vectors(spark, SF_SMALL)
    z, lam = z_standin(c, 4)
    space = M.build_space("euclidean", z, lam, 4)
    seeds = search.strict_start_set(c, q, 0.0).select("pool_id", "qid", "chunk_idx")  # empty
    m = walk.random_walk(space.points, space.state, "euclidean", seeds, q.select("pool_id", "qid"))
    n = c.count()
    assert m.count() == q.count() * (n // q.select("pool_id").distinct().count())


def test_walk_top_k_equals_the_masses_whatever_the_blocks(spark):
    c, q = chunk_vectors(spark, SF_SMALL), query_vectors(spark, SF_SMALL)
    z, lam = z_standin(c, 4)
    space = M.build_space("mahalanobis", z, lam, 4)
    seeds = search.anchors(c, q, 0.85, 3).select("pool_id", "qid", "chunk_idx")
    given = (space.points, space.state, "mahalanobis", seeds, q.select("pool_id", "qid"))
    want = _rows(walk.topk_roles(walk.random_walk(*given), seeds, 5), "qid", "role", "rank", "chunk_idx")
    for block, query_block in ((4096, 256), (4096, 1), (13, 1)):
        top = walk.walk_top_k(*given, k=5, block=block, query_block=query_block)
        assert _rows(walk.roles_of_top(top, seeds, 5), "qid", "role", "rank", "chunk_idx") == want, block
    assert walk.walk_top_k(*given, k=99).count() == walk.random_walk(*given).count()  # k beyond the pool


def test_settled_queries_leave_the_walk_with_the_right_ranks():
    rng = np.random.default_rng(5)
    less = 0
    for _ in range(40):
        n = int(rng.integers(2, 60))
        K = np.exp(-8 * rng.random((n, n)))
        W = K / K.sum(axis=1, keepdims=True)
        v = np.zeros((9, n))
        for r in v:
            r[rng.choice(n, int(rng.integers(1, min(n, 4) + 1)), replace=False)] = 1
        v /= v.sum(axis=1, keepdims=True)
        whole, work = walk.walk_matrix(W, v, 0.85, 10)
        early, done = walk.walk_matrix(W, v, 0.85, 10, k=3)
        assert (walk.best_positions(whole, 3) == walk.best_positions(early, 3)).all()
        less += work - done
    assert less > 0
    W = np.full((4, 4), 0.25)  # ties are never settled
    assert walk.walk_matrix(W, W[:2], 0.85, 10, k=2)[1] == 20


def test_walk_steps_leave_the_cells_where_they_lie(spark):
    """The plan of a step exchanges masses; the bucketed cells are neither shuffled nor broadcast."""
    c, q = chunk_vectors(spark, SF_SMALL), query_vectors(spark, SF_SMALL)
    z, lam = z_standin(c, 4)
    space = M.build_space("euclidean", z, lam, 4)
    seeds = search.anchors(c, q, 0.85, 3).select("pool_id", "qid", "chunk_idx")
    w = walk._Walk(space.points, space.state, "euclidean", seeds, q.select("pool_id", "qid"), 0.85, 1.0, 10, 13, 2)
    name, start = w.cells(), w.start()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        step = w.step(spark.table(name), start, start)
        plan = step._jdf.queryExecution().executedPlan()
        text = plan.toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = text.split("\n")
    scan = next(n for n, x in enumerate(lines) if "FileScan" in x and "flat_i" in x)
    depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
    above = []
    for x in reversed(lines[:scan]):  # the nodes above the scan, up to the join
        d = len(x) - len(x.lstrip(" :+-"))
        if d < depth:
            above.append(x.strip(" :+-"))
            depth = d
    join = next(n for n, x in enumerate(above) if "SortMergeJoin" in x)
    assert not any("Exchange" in x for x in above[:join]), text
    assert step.count() == start.count()
    spark.sql(f"drop table {name}")


def _one_pool(df):
    return df.withColumn("pool_id", F.lit(0).cast("bigint"))


def test_hops_are_the_same_in_one_block_in_many_and_without_pivots(spark):
    c, q = _one_pool(chunk_vectors(spark, SF_SMALL)), _one_pool(query_vectors(spark, SF_SMALL))
    scanned = cut_lineage(search.scan(c, q, 3, 0.85))
    for metric, dims in (("mahalanobis", 4), ("cosine", 4), ("bhattacharyya", 2)):
        z, lam = z_standin(c, dims)
        space = M.build_space(metric, z, lam, dims)
        space = M.MetricSpace(metric, cut_lineage(space.points), cut_lineage(space.state), dims)
        eps = cut_lineage(M.calibrate_epsilon(space))
        hops = lambda **kw: _rows(decay.decay_traversal(c, q, space, eps, 0.85, 1.1, 2, scanned=scanned, **kw), "qid", "hop", "chunk_idx")  # noqa: E731, B023
        want = hops()
        assert {h for _, h, _ in want} == {0, 1, 2}
        assert hops(block=90, query_block=6) == want, metric
        if metric == "mahalanobis":
            assert hops(pivots=0) == want and hops(block=90, query_block=100, pivots=3) == want


def test_pivots_save_distances_and_lose_no_pair():
    rng = np.random.default_rng(1)
    A, B = (np.repeat(rng.random((12, 3)) * 20, 25, axis=0) + rng.random((300, 3)) for _ in range(2))
    B[:100] = A[:100] + 0.1
    pivots = A[rng.choice(300, 8, replace=False)]
    far = lambda X: M.block_distance("euclidean", X, pivots, 0.0)
    whole, every = decay.near_matrix("euclidean", 0.0, 1.0, (A, None, None), (B, None, None))
    some, done = decay.near_matrix("euclidean", 0.0, 1.0, (A, None, None), (B, None, None), far(A), far(B))
    assert (whole == some).all() and whole.any() and every == 90000 and done < every / 5


def test_cells_that_pivots_rule_out_are_never_made(spark):
    """Two clouds far apart in one pool: no cell joins them; bitmaps number one per query block and block."""
    rng = np.random.default_rng(2)
    rows = [(0, i, [float(x) for x in rng.random(3) + (100 if i % 2 else 0)], 1.0) for i in range(400)]
    pts = spark.createDataFrame(rows, "pool_id long, chunk_idx long, v array<double>, epsilon double")
    space = M.MetricSpace("euclidean", pts.select("pool_id", "chunk_idx", "v"), spark.createDataFrame([(0, 0.0)], "pool_id long, s double"))
    pd_ = {r.chunk_idx: np.array(r.pd) for r in decay.pivot_distances(space, 8).collect()}
    near = {i: int(np.argmin(d)) for i, d in pd_.items()}
    blocks = [(0, str(b), 1.0, [float(x) for i in near if near[i] == b for x in pd_[i]], [i for i in near if near[i] == b]) for b in set(near.values())]
    df = spark.createDataFrame(blocks, "pool_id long, b string, epsilon double, pd array<double>, ids array<long>")
    side = {b[1]: b[4][0] % 2 for b in blocks}
    pairs = [(r.i, r.j) for r in decay.block_pairs(df, True).collect()]
    assert all(side[i] == side[j] for i, j in pairs) and len(pairs) <= len(blocks) ** 2 - 2 * sum(side.values()) * (len(side) - sum(side.values()))
    assert decay.block_pairs(df, False).count() == len(blocks) ** 2
    m = rng.random((7, 13)) > 0.5
    assert (decay._unbits(decay._bits(m), 7, 13) == m).all() and len(decay._bits(m)) == 12


def test_knn_skips_blocks_that_cannot_hold_a_neighbour(spark):
    rng = np.random.default_rng(7)
    centres = rng.random((12, 3)) * 100
    X = [centres[i % 12] + rng.random(3) for i in range(480)]
    X[5] = X[17]  # a tie
    z = spark.createDataFrame([(0, i, [float(v) for v in x]) for i, x in enumerate(X)], "pool_id long, chunk_idx long, z array<double>")
    X = np.array(X)
    d2 = M.sq_dists(X, X)
    want = sorted((i, int(j), r + 1) for i in range(len(X)) for r, j in enumerate(np.lexsort((np.arange(len(X)), d2[i]))[:7]))
    for block in (60, 7, 4096):
        assert sorted((r.i, r.j, r["rank"]) for r in M.knn_graph(z, 7, block).collect()) == want, block
    pts = M.ball_blocks(z, 60)
    n = pts.select("b").distinct().count()
    own = pts.select("pool_id", "b", F.lit(2.0).alias("kth"))  # no 7th neighbour lies farther than sqrt(2)
    assert n > 7 and M.knn_cells(own, pts).count() < n * (n - 1) / 2


def test_knn_kernel_screens_in_single_precision_and_keeps_k_of_many_ties():
    import pandas as pd
    rng = np.random.default_rng(5)
    A = 100 + rng.normal(size=(300, 9)) * 1e-3            # far from the origin: single precision alone would rank them wrongly
    A[100:200] = A[7]                                      # copies: ties go to the smaller ids
    A[250] = np.nan
    for P in (A[:250], A):
        g = pd.DataFrame({"chunk_idx": np.arange(len(P))[::-1], "z": list(P), "pd": list(np.sqrt(M.sq_dists(P, P[:2])))})
        d2 = M.sq_dists(P, P)
        got = M._k_nearest(g, g, 6)
        want = {(len(P) - 1 - i, len(P) - 1 - j) for i in range(len(P)) if not np.isnan(P[i]).any()
                for j in np.lexsort((np.arange(len(P))[::-1], d2[i]))[:6]}
        assert len(got) == len(want) and set(zip(got["i"], got["j"])) == want
        bound = np.nan_to_num(np.sort(d2, axis=1)[:, 20])
        assert set(zip(*(M._k_nearest(g, g, 6, bound, 64)[c] for c in "ij"))) == want


def test_knn_cells_of_several_blocks(spark, monkeypatch):
    """Cells of one block and of several give the rows of one block."""
    rng = np.random.default_rng(8)
    Z = rng.normal(size=(400, 5))
    Z[50:90] = Z[3]
    z = spark.createDataFrame([(0, i, [float(v) for v in x]) for i, x in enumerate(Z)], "pool_id long, chunk_idx long, z array<double>")
    rows = lambda: sorted((r.i, r.j, r["rank"], r.d2) for r in M.knn_graph(z, 7, block=40).collect())
    want = sorted((r.i, r.j, r["rank"], r.d2) for r in M.knn_graph(z, 7).collect())
    assert rows() == want
    monkeypatch.setattr(M, "KNN_CELL", 40)
    assert rows() == want


def test_cells_of_a_large_pool_are_few_and_hold_bitmaps(spark, monkeypatch):
    """Blocks grow with the pool, so cells do not; a cell holds a bit per pair, no points."""
    c, q = _one_pool(chunk_vectors(spark, SF_SMALL)), _one_pool(query_vectors(spark, SF_SMALL))
    z, lam = z_standin(c, 4)
    space = M.build_space("mahalanobis", z, lam, 4)
    eps, seen, write = cut_lineage(M.calibrate_epsilon(space)), [], decay.bucketed_table

    def kept(df, keys, name):
        table = write(df, keys, name)
        rows = spark.table(table)
        seen.append((rows.columns, rows.count(), rows.agg(F.max(F.length("near"))).first()[0] if "near" in rows.columns else None))
        return table
    monkeypatch.setattr(decay, "bucketed_table", kept)
    decay.decay_traversal(c, q, space, eps, 0.85, 1.1, 2, block=4, query_block=1).count()
    (columns, cells, widest), = seen
    assert "flat_j" not in columns and "near" in columns and cells <= 32 ** 2 and widest <= 60 * 8


def test_nearness_by_products_and_united_rows():
    rng = np.random.default_rng(4)
    A = rng.integers(0, 4, (80, 6)).astype(float) + 1e6   # many distances equal epsilon exactly
    B = np.vstack([rng.integers(0, 4, (70, 6)) + 1e6, np.full((1, 6), np.nan)])
    for eps in (2.0, 3.0, 0.0):
        assert (decay._within(A, B, eps, 500) == (np.sqrt(M.sq_dists(A, B)) <= eps)).all()
    near, frontier = rng.random((80, 21)) < 0.02, rng.random((9, 80)) < 0.3
    frontier[4] = False
    got = decay._united_rows(frontier, np.packbits(near, axis=1), 7)
    assert (np.unpackbits(got, axis=1, count=21) == (frontier.astype(int) @ near > 0)).all()


def test_a_large_pool_finds_its_cutoff_set_as_bits(spark, monkeypatch):
    """No row per pair within tau: the scan is asked for the nearest chunks only; the old way where keys repeat."""
    c, q = _one_pool(chunk_vectors(spark, SF_SMALL)), _one_pool(query_vectors(spark, SF_SMALL))
    c, q = cut_lineage(c), cut_lineage(q)
    z, lam = z_standin(c)
    space = M.build_space("euclidean", z, lam, 64)
    eps = M.calibrate_epsilon(space, 0.10, 50, 42)
    bounds, scan = [], search.scan

    def noted(chunks, queries, k, bound, **more):
        bounds.append(bound)
        return scan(chunks, queries, k, bound, **more)
    monkeypatch.setattr(search, "scan", noted)
    for start in ("anchors", "strict"):
        hops = lambda qs, **more: _rows(decay.decay_traversal(c, qs, space, eps, 0.85, 1.1, 2, start=start, block=60, query_block=3, **more), "qid", "hop", "chunk_idx")  # noqa: E731, B023
        want = hops(q, scanned=cut_lineage(scan(c, q, 3, 0.85)))
        assert want and hops(q) == want and bounds == [None]
        bounds.clear()
    twice, null = q.select("qid").union(q.select("qid").limit(1)), q.select("qid").union(spark.createDataFrame([(None,)], "qid long"))
    assert decay._single(q, "qid") and not decay._single(twice, "qid") and not decay._single(null, "qid")


def test_cells_hold_a_strip_of_distances_at_a_time():
    import tracemalloc

    def peak(fn) -> float:
        tracemalloc.start()
        fn()
        most = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return most
    rng = np.random.default_rng(3)
    A = rng.normal(size=(2048, 8))
    P, far = (A, None, None), M.block_distance("euclidean", A, A[:4], 0.0)
    whole = 2048 * 2048 * 8 / 1e6
    assert peak(lambda: decay.near_matrix("euclidean", 0.0, 2.0, P, P, far, far)) < 1.5 * whole
    assert peak(lambda: walk._kernel("euclidean", 1.0, 0.0, P, P)) < 2.2 * whole
    assert peak(lambda: walk._kernel("euclidean", 1.0, 0.0, P, P, sums=True)) < 1.2 * whole
    K = walk._kernel("euclidean", 1.0, 0.0, P, P)
    assert np.allclose(K, np.exp(-M.block_distance("euclidean", A, A, 0.0)), rtol=1e-14)
    assert np.allclose(walk._kernel("euclidean", 1.0, 0.0, P, P, sums=True), K.sum(axis=1), rtol=1e-14)
    assert peak(lambda: walk._row_normal(K, K.sum(axis=1))) < 0.2 * whole and np.allclose(K.sum(axis=1), 1.0)
