import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from clientele.errors import DataProblem
from clientele.operators import diagnostics as D
from clientele.operators.fits import FitSettings, smallest_draws, subsample_size, with_subsamples
from clientele.operators import kmeans, line, spectral
from clientele.operators.kmeans import fit_kmeans, fit_partitions, points_table
from clientele.operators.solution import describe_solution
from clientele.operators.eigen import Graph, affinity, leading_eigenvectors
from clientele.operators.spectral import SpectralEmbedding
from clientele.operators.ward import WardHierarchy, build_trees, hierarchy_views
from clientele.plans.compare import compare_solutions, fit_candidate, fit_solution, plan_grid, ready

QUICK = FitSettings(gmm_starts=1)


def prepared(spark, matrix, partitions=4):
    rows = [(i, Vectors.dense(row)) for i, row in enumerate(np.asarray(matrix, float))]
    return ready(spark.createDataFrame(rows, ["id", "features"]).repartition(partitions, "id"))


def blobs(centres, size, spread, columns=3, seed=1):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, spread, (size, columns)) for c in centres])


def ari(a, b):
    table = np.array([[np.sum((a == x) & (b == y)) for y in np.unique(b)] for x in np.unique(a)], float)
    pairs = lambda v: (v * (v - 1) / 2).sum()
    s, r, c = pairs(table), pairs(table.sum(1)), pairs(table.sum(0))
    e = r * c / pairs(np.array([table.sum()]))
    return (s - e) / ((r + c) / 2 - e)


def labels_of(frame, fit):
    return np.array([row["g"] for row in fit.label(frame, "g").orderBy("id").collect()])


def test_two_blobs_score_high_and_noise_does_not(spark):
    found = compare_solutions(prepared(spark, blobs([-3, 3], 80, 0.3)), ("kmeans", "hierarchical"), (2,), 4, settings=QUICK)
    for row in found.diagnostics.collect():
        assert row["silhouette"] > 0.8 and row["smallest_segment_%"] == 50.0
        assert row["stability"] > 0.99 and row["cross_method_agreement"] == 1.0
        assert row["quality"] == "Promising"
    assert found.diagnostics.filter("recommended").count() == 1
    assert found.long_labels().groupBy("algorithm", "k").count().filter("count != 160").count() == 0
    noise = np.random.default_rng(5).normal(size=(300, 7))
    found = compare_solutions(prepared(spark, noise), ("kmeans",), (3, 4), 4, settings=QUICK)
    assert not {r["quality"] for r in found.diagnostics.collect()} & {"Strong", "Promising"}
    assert D.verdict(found.diagnostics).first()["outcome"] in {"no reliable segmentation", "exploratory"}


def test_tiny_groups_are_never_strong(spark):
    found = compare_solutions(prepared(spark, blobs(np.arange(8) * 6.0, 4, 0.1)), ("kmeans",), (8,), 4, settings=QUICK)
    assert found.diagnostics.first()["quality"] in {"Exploratory", "Weak"}


def test_identical_rows_cannot_form_three_groups(spark):
    frame = prepared(spark, np.zeros((40, 2)))
    with pytest.raises(DataProblem, match="instead of the requested 3"):
        fit_kmeans(frame, 40, 3, 42, QUICK)
    with pytest.raises(DataProblem, match="instead of the requested 3"):
        WardHierarchy(frame, 42, QUICK).fit(3, 40)
    with pytest.raises(DataProblem, match="at least two"):
        fit_kmeans(frame, 40, 1, 42, QUICK)


def test_small_mixture_is_a_failure_row(spark):
    matrix = np.random.default_rng(2).normal(size=(100, 20))
    found = compare_solutions(prepared(spark, matrix), ("kmeans", "gmm"), (4,), 2, settings=QUICK)
    assert [r["method"] for r in found.failures.collect()] == ["Gaussian mixture"]
    assert {r["algorithm_key"] for r in found.diagnostics.collect()} == {"kmeans"}
    with pytest.raises(DataProblem, match="30 prepared"):
        compare_solutions(prepared(spark, matrix[:20]), ("kmeans",), (2,), settings=QUICK)
    with pytest.raises(DataProblem, match="Unknown method"):
        compare_solutions(prepared(spark, matrix), ("magic",), (2,), settings=QUICK)


@pytest.mark.parametrize("method", ["kmeans", "gmm", "hierarchical", "spectral"])
def test_every_method_recovers_three_blobs(spark, method):
    matrix = blobs([-4, 0, 4], 120, 0.6, columns=2)
    truth = np.repeat([0, 1, 2], 120)
    frame = prepared(spark, matrix)
    found = compare_solutions(frame, (method,), (3,), 2, settings=QUICK)
    fit = found.fits[(method, 3)]
    assert ari(truth, labels_of(frame, fit)) > 0.9
    row = found.diagnostics.first()
    assert row["stability"] > 0.9 and (row["bic"] is not None) == (method == "gmm")
    solution = describe_solution(found.labels, found.label_columns[(method, 3)], fit)
    rows = solution.assignments.collect()
    assert len({r["id"] for r in rows}) == len(rows) == 360
    assert all(0.0 <= r["confidence"] <= 1.0 for r in rows)
    assert {r["segment"] for r in rows} == {"Segment 1", "Segment 2", "Segment 3"}
    assert 0.9 < solution.explained_variance <= 1.0 + 1e-9
    assert abs(np.mean([r["PC1"] for r in rows])) < 1e-8


def test_approximate_ward_and_spectral_recover_blobs(spark):
    matrix = blobs([-4, 0, 4], 120, 0.6, columns=2)
    truth = np.repeat([0, 1, 2], 120)
    frame = prepared(spark, matrix)
    rough = FitSettings(ward_exact=100, ward_cells=30, spectral_exact=100, landmarks=60)
    tree = WardHierarchy(frame, 42, rough)
    assert not tree.cells.exact and "cells" in tree.detail
    assert ari(truth, labels_of(frame, tree.fit(3, 360))) > 0.95
    assert ari(truth, labels_of(frame, fit_candidate(frame, "spectral", 3, settings=rough))) > 0.95
    assert fit_solution(frame, "kmeans", 3).assignments.filter("confidence < 0.5").count() == 0


def test_ward_tree_matches_exhaustive_merging(spark):
    rng = np.random.default_rng(9)
    points, weights = rng.normal(size=(40, 3)), rng.integers(1, 6, 40).astype(float)
    tree, twin = build_trees(spark, [(weights, points), (weights, points)])
    assert (tree.left == twin.left).all() and (tree.height == twin.height).all()
    groups = {i: (weights[i], points[i]) for i in range(40)}
    heights = []
    while len(groups) > 1:
        cost, a, b = min(
            (wa * wb / (wa + wb) * ((pa - pb) ** 2).sum(), a, b)
            for a, (wa, pa) in groups.items() for b, (wb, pb) in groups.items() if a < b
        )
        (wa, pa), (wb, pb) = groups.pop(a), groups.pop(b)
        groups[a] = (wa + wb, (wa * pa + wb * pb) / (wa + wb))
        heights.append(np.sqrt(2 * cost))
    assert np.allclose(tree.height, heights)
    assert len(set(tree.cut(5))) == 5


def cheapest_heights(points):
    """Merge heights of the cheapest pair over and over, by updates of a full matrix of costs."""
    n = len(points)
    size = np.ones(n)
    cost = ((points[:, None] - points[None]) ** 2).sum(2) / 2
    np.fill_diagonal(cost, np.inf)
    near = cost.argmin(axis=1)
    least = cost[np.arange(n), near]
    heights = []
    for _ in range(n - 1):
        a = int(least.argmin())
        b = int(near[a])
        heights.append(np.sqrt(2 * least[a]))
        new = ((size[a] + size) * cost[a] + (size[b] + size) * cost[b] - size * least[a]) / (size[a] + size[b] + size)
        size[a] += size[b]
        size[b] = 0
        new[[a, b]] = np.inf
        new[size == 0] = np.inf
        cost[a], cost[:, a] = new, new
        cost[b] = cost[:, b] = np.inf
        near[a], least[a], least[b] = new.argmin(), new.min(), np.inf
        better = new < least
        near[better], least[better] = a, new[better]
        for i in np.flatnonzero(((near == a) | (near == b)) & (size > 0) & ~better):
            near[i] = cost[i].argmin()
            least[i] = cost[i, near[i]]
    return np.array(heights)


def test_ward_is_exact_at_five_thousand_rows(spark):
    points = np.random.default_rng(4).normal(size=(5000, 3))
    tree = WardHierarchy(prepared(spark, points), 42, FitSettings())
    assert tree.detail == "exact" and tree.tree.leaves == 5000
    assert np.allclose(tree.tree.height, cheapest_heights(points), rtol=1e-9)
    assert (np.diff(tree.tree.height) >= 0).all() and tree.tree.size[-1] == 5000
    small = tree.subsampled(2)
    assert all(t.detail == "exact" and 3900 < t.tree.leaves < 4100 for t in small)
    assert [t.tree.size[-1] for t in small] == [t.tree.leaves for t in small]


def test_repeated_rows_are_one_leaf(spark):
    points = np.random.default_rng(4).normal(size=(60, 2))
    tree = WardHierarchy(prepared(spark, np.vstack([points, points[:20], points[:5]])), 42, FitSettings())
    assert tree.tree.leaves == 60 and sorted(tree.tree.weights)[-5:] == [3] * 5 and tree.tree.size[-1] == 85


def test_spectral_is_exact_at_two_and_a_half_thousand_rows(spark):
    points = np.random.default_rng(5).normal(size=(2500, 4))
    found = SpectralEmbedding(prepared(spark, points), 2500, 42, FitSettings(), repeats=1)
    assert found.detail == "exact"
    own = found.eigen(6)[None]
    rows = found._points[None]
    dense = affinity(rows, rows, 0.25)
    root = 1 / np.sqrt(dense.sum(axis=1))
    dense = dense * np.outer(root, root)
    assert (np.linalg.norm(dense @ own.vectors - own.vectors * own.values, axis=0) < 1e-8).all()
    assert np.allclose(own.values, np.linalg.eigvalsh(dense)[::-1][:6], atol=1e-10)
    assert 1900 < len(found.eigen(6)[0].vectors) < 2100


def test_eigenvectors_of_small_and_weighted_graphs(spark):
    rng = np.random.default_rng(6)
    graphs = [Graph(rng.normal(size=(n, 2)), rng.integers(1, 5, n).astype(float)) for n in (2, 5, 40)]
    for graph, own in zip(graphs, leading_eigenvectors(spark, graphs, 4)):
        dense = affinity(graph.rows, graph.rows, graph.gamma)
        root = np.sqrt(graph.weights / (dense @ graph.weights))
        values = np.linalg.eigvalsh(dense * np.outer(root, root))[::-1][:4]
        assert np.allclose(own.values, values, atol=1e-10) and (own.residuals < 1e-9).all()


def test_hierarchy_views_add_up(spark):
    icicle, merges = hierarchy_views(prepared(spark, blobs([-4, 0, 4], 50, 0.5)), max_segments=5, leaves=10)
    rows = icicle.collect()
    assert len(rows) == 9 and sum(r["parent"] == "" for r in rows) == 1
    size = {r["id"]: r["customers"] for r in rows}
    children = {}
    for r in rows:
        if r["parent"]:
            children[r["parent"]] = children.get(r["parent"], 0) + r["customers"]
    assert all(size[parent] == total for parent, total in children.items())
    assert merges.count() == 9
    assert rows[0]["label"] == "150 customers · 100%"


def test_metrics_match_numpy(spark):
    matrix = blobs([-1, 0.5, 2], 30, 1.0, columns=4, seed=6)
    truth = np.repeat([0, 1, 2], 30)
    truth[[3, 40, 77]] = [1, 2, 0]
    frame = prepared(spark, matrix)
    frame = frame.withColumn("g", F.get(F.lit(truth.tolist()), F.col("id").cast("int")))
    distances = np.sqrt(((matrix[:, None] - matrix[None]) ** 2).sum(2))
    scores = []
    for i in range(90):
        mean = [distances[i, truth == g].sum() / ((truth == g).sum() - (truth[i] == g)) for g in range(3)]
        a, b = mean[truth[i]], min(m for g, m in enumerate(mean) if g != truth[i])
        scores.append((b - a) / max(a, b))
    assert np.isclose(D.silhouettes(frame, ["g"])["g"], np.mean(scores))
    stats = D.segment_statistics(frame, "g")
    centres = np.array([matrix[truth == g].mean(0) for g in range(3)])
    within = sum(((matrix[truth == g] - centres[g]) ** 2).sum() for g in range(3))
    between = ((matrix - matrix.mean(0)) ** 2).sum() - within
    assert np.isclose(D.calinski_harabasz(stats), (between / 2) / (within / 87))
    spread = D.mean_spread(frame, "g", stats)
    assert np.allclose(spread, [np.sqrt(((matrix[truth == g] - centres[g]) ** 2).sum(1)).mean() for g in range(3)])
    gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
    worst = [max((spread[i] + spread[j]) / gaps[i, j] for j in range(3) if j != i) for i in range(3)]
    assert np.isclose(D.davies_bouldin(stats, spread), np.mean(worst))
    other = np.roll(truth, 7)
    both = frame.withColumn("h", F.get(F.lit(other.tolist()), F.col("id").cast("int")))
    assert np.isclose(D.pair_agreement(both, {"x": ("g", "h")}).first()["ari"], ari(truth, other))


def test_many_columns_use_batches_for_distances(spark):
    from clientele.functions.geometry import with_distances

    rng = np.random.default_rng(3)
    matrix, centres = rng.normal(size=(50, 120)), rng.normal(size=(6, 120))
    rows = with_distances(prepared(spark, matrix), centres, "d").orderBy("id").collect()
    expected = np.sqrt(((matrix[:, None] - centres[None]) ** 2).sum(2))
    assert np.allclose([r["d"] for r in rows], expected)


def test_same_seed_same_labels(spark):
    frame = prepared(spark, np.random.default_rng(1).normal(size=(200, 3)))
    first, second = (labels_of(frame, fit_kmeans(frame, 200, 4, 7, QUICK)) for _ in range(2))
    assert (first == second).all()


def test_default_grid():
    assert plan_grid(600).algorithms == ("kmeans", "gmm", "hierarchical")
    assert plan_grid(5000, categorical=True).algorithms == ("kmeans", "hierarchical")
    assert plan_grid(5000, categorical=True, ward_up_to=1500).algorithms == ("kmeans",)
    assert plan_grid(600).k_values == (3, 4, 5, 6) and not plan_grid(600).warnings
    assert plan_grid(600, k_values=[9]).warnings
    with pytest.raises(DataProblem):
        plan_grid(600, k_values=[51])


def test_subsamples_hold_exactly_their_share(spark):
    frame = prepared(spark, np.random.default_rng(2).normal(size=(997, 2)))
    drawn = with_subsamples(frame, 3, 42)
    assert [drawn.filter(f"in_{r}").count() for r in range(3)] == [798] * 3
    again = with_subsamples(frame.repartition(5), 3, 42)
    for r in range(3):
        own = {x["id"] for x in drawn.filter(f"in_{r}").select("id").collect()}
        assert own == {x["id"] for x in again.filter(f"in_{r}").select("id").collect()}
    ids = frame.select("id")
    draws = sorted(x[0] for x in ids.select(F.xxhash64(F.col("id").cast("string"), F.lit(42), F.lit(1))).collect())
    assert smallest_draws(frame, 2, 42, 500, few=4)[1] == draws[499]
    assert [r for r in (subsample_size(2), subsample_size(30), subsample_size(1))] == [1, 24, 0]


def test_starts_that_meet_go_on_as_one(spark):
    from clientele.operators.kmeans import _Start, met

    one, other = np.array([[0.0, 0], [5, 5]]), np.array([[5.0, 5], [0, 1e-9]])
    starts = [_Start(("a",), None, c) for c in (one, other, one + 1)] + [_Start(("b",), None, one)]
    left = met(starts, 1e-4)
    assert left == [starts[0], starts[2], starts[3]] and starts[1].ahead is starts[0]


def test_one_column_gets_the_partition_of_least_cost(spark):
    def cheapest(x, k):
        x = np.sort(x)
        s, q = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))
        cost = lambda i, j: q[j] - q[i] - (s[j] - s[i]) ** 2 / (j - i)
        known = [0.0] + [cost(0, j) for j in range(1, len(x) + 1)]
        for _ in range(k - 1):
            known = [np.inf] + [min([known[i] + cost(i, j) for i in range(1, j)], default=np.inf) for j in range(1, len(x) + 1)]
        return known[-1]

    values = np.repeat(np.round(np.random.default_rng(8).normal(size=40), 2), 6)
    frame = prepared(spark, values[:, None])
    found = fit_partitions(frame, [(k, None) for k in (2, 3, 5)], 42, FitSettings(kmeans_starts=1))
    for (k, _), partitions in found.items():
        assert abs(partitions[0].cost - cheapest(values, k)) < 1e-9 and partitions[0].counts.sum() == 240
    few = fit_partitions(prepared(spark, [[1.0], [2.0], [2.0], [1.0]]), [(3, None), (2, None)], 42, FitSettings(), every=False)
    assert isinstance(few[(3, None)], DataProblem) and few[(2, None)][0].cost == 0


def test_many_buckets_are_narrowed_to_the_same_cuts(spark, monkeypatch):
    frame = prepared(spark, np.random.default_rng(4).exponential(size=(900, 1)) ** 3)
    whole = line.least_cost(points_table(frame), None, [2, 4])
    monkeypatch.setattr(line, "BUCKETS", 16)
    for k, (centres, cost, sizes) in line.least_cost(points_table(frame), None, [2, 4]).items():
        assert np.allclose(centres, whole[k][0]) and abs(cost - whole[k][1]) < 1e-6 and (sizes == whole[k][2]).all()


def test_sample_by_hash_sorts_little_more_than_it_keeps(spark):
    ids = [*range(6000), *range(500), *[None] * 3, *[7] * 300]
    frame = spark.createDataFrame([(i,) for i in ids], "id int").repartition(16)
    for size in (1, 40, 700, 6803, 9000):
        kept = D.first_by_hash(frame, "id", 42, size)
        assert [r["id"] for r in kept.collect()] == [r["id"] for r in frame.orderBy(D.hash_order("id", 42), "id").limit(size).collect()]
    text = D.first_by_hash(frame, "id", 42, 40)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in text  # rows beyond the counted range do not reach the sort
    assert D.first_by_hash(frame.limit(0), "id", 42, 5).count() == 0


def test_batch_functions_hold_a_block_at_a_time(spark):
    rng = np.random.default_rng(0)
    points = pd.Series(list(rng.normal(size=(10_000, 3))))
    basis = spectral._Basis(rng.normal(size=(1000, 3)), np.ones(1000), rng.normal(size=(1000, 4)), 1 / 3)
    for function in (spectral._embedding(basis).func, kmeans._nearest_in_batches(rng.normal(size=(2000, 3))).func):
        tracemalloc.start()
        whole = function(points)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 30_000_000 and len(whole) == 10_000 and not len(function(points[:0]))
        assert np.allclose(np.vstack(whole[:40]), np.vstack(function(points[:40])))


def test_ties_between_centres_count_once(spark):
    points = points_table(prepared(spark, [[0.0], [1.0], [2.0], [1.0]]))
    starts = [kmeans._Start((2, None), None, np.array([[0.0], [2.0]])), kmeans._Start((3, None), None, np.array([[1.0], [1.0], [5.0]]))]
    (cost, counts, sums, _), (_, same, _, _) = kmeans._step(points, starts)
    assert cost == 2 and counts.tolist() == [3, 1] and sums.tolist() == [[2], [2]] and same.tolist() == [4, 0, 0]


def test_ready_table_has_no_more_partitions_than_cores_or_its_size_ask_for(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    from clientele.plans import compare

    rows = spark.range(500).select("id", array_to_vector(F.array(F.col("id").cast("double"), F.lit(1.0))).alias("features"))
    cores = spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        small = compare.ready(rows)
        assert small.rdd.getNumPartitions() == cores and compare.ready(small) is small
        monkeypatch.setattr(compare, "PART_NUMBERS", 50)
        large = compare.ready(rows)
        assert large.rdd.getNumPartitions() == 20
        for table in (small, large):
            assert sorted(r["id"] for r in table.select("id").collect()) == list(range(500))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rows_are_compared_with_centres_near_their_leaf_only(spark):
    from clientele.functions.nearest import Leaves

    rng = np.random.default_rng(3)
    rows = np.vstack([rng.normal(size=(6000, 3)), np.round(rng.normal(size=(2000, 3)), 1), np.ones((500, 3))])
    centres = np.vstack([rows[rng.choice(8000, 600, replace=False)], np.ones((2, 3))])  # two that tie
    gaps = (centres**2).sum(axis=1) - 2 * rows @ centres.T
    leaves = Leaves(rows)
    label, near = leaves.nearest(centres)
    assert label.tolist() == gaps.argmin(axis=1)[leaves.order].tolist() and np.allclose(near, gaps.min(axis=1)[leaves.order])
    assert leaves._kept(0, len(leaves.cuts), centres, (centres**2).sum(axis=1)).mean() < 0.35
    assert sorted(leaves.order.tolist()) == list(range(len(rows))) and len(Leaves(rows[:0]).nearest(centres)[0]) == 0

    points = points_table(prepared(spark, rows), 2)
    inside = [np.array([r[c] for r in points.orderBy("id").select("in_0", "in_1").collect()]) for c in ("in_0", "in_1")]
    found = kmeans._step(points, [kmeans._Start((602, s), s, centres) for s in (None, 0, 1)])
    for (cost, counts, sums, far), held in zip(found, [np.ones(len(rows), bool), *inside]):
        own = gaps[held].argmin(axis=1)
        away = gaps[held].min(axis=1) + (rows[held] ** 2).sum(axis=1)
        assert counts.tolist() == np.bincount(own, minlength=602).tolist() and np.isclose(cost, away.sum())
        assert np.allclose(sums[:, 1], np.bincount(own, weights=rows[held][:, 1], minlength=602))
        assert np.isclose(far[0], away.max()) and np.allclose(far[1:], rows[held][away.argmax()])
