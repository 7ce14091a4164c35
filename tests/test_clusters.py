import numpy as np
import pytest

from settlegrid.checks import ContractError
from settlegrid.operators import clusters as C


def exact_groups(weight, z, k):
    """Plain agglomeration: the pair whose union adds least to the sum of squares, again and again."""
    groups = [[i] for i in range(len(z))]

    def growth(a, b):
        na, nb = weight[a].sum(), weight[b].sum()
        ca, cb = (np.average(z[g], axis=0, weights=weight[g]) for g in (a, b))
        return na * nb / (na + nb) * ((ca - cb) ** 2).sum()
    while len(groups) > k:
        _, i, j = min((growth(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] = groups[i] + groups.pop(j)
    return {frozenset(g) for g in groups}


def partition(label):
    return {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label.tolist())}


@pytest.mark.parametrize("k", [1, 2, 5, 12])
def test_labels_equal_plain_agglomeration(k):
    r = np.random.default_rng(k)
    z, weight = r.normal(size=(40, 3)), r.integers(1, 9, 40).astype(float)
    assert partition(C.ward_labels(weight, z, k)) == exact_groups(weight, z, k)


def test_heights_rise_and_add_up_to_the_sum_of_squares():
    z, weight = np.random.default_rng(3).normal(size=(200, 2)) + 1e4, np.ones(200)
    heights = [h for h, _, _ in C.ward_merges(weight, z)]
    assert heights == sorted(heights) and len(heights) == 199
    assert sum(heights) == pytest.approx(((z - z.mean(0)) ** 2).sum(), rel=1e-9)


def points_of(spark, z, weight=None):
    rows = [(i, [float(v) for v in x], float(w)) for i, (x, w) in enumerate(zip(z, np.ones(len(z)) if weight is None else weight))]
    return spark.createDataFrame(rows, "id long, z array<double>, w double").repartition(6)


@pytest.mark.parametrize("weighted", [False, True])
def test_points_equal_plain_agglomeration(spark, weighted):
    r = np.random.default_rng(8)
    z, weight = np.round(r.normal(size=(36, 2)), 3), r.integers(1, 6, 36)
    z[7] = z[8]
    got = C.agglomerate(points_of(spark, z, weight), 3, "w" if weighted else None).toPandas().sort_values("id")
    want = exact_groups(weight.astype(float) if weighted else np.ones(36), z, 3)
    assert partition(got.cluster.to_numpy()) == want
    sizes = got.w.groupby(got.cluster).sum() if weighted else got.cluster.value_counts().sort_index()
    assert list(sizes) == sorted(sizes, reverse=True) and list(sizes.index) == [0, 1, 2]


def test_condensed_leaves_keep_weight_and_far_groups(spark):
    r = np.random.default_rng(2)
    z = np.vstack([r.normal(c, 0.5, size=(n, 2)) for c, n in (((0, 0), 900), ((9, 0), 500), ((0, 9), 200))])
    points = points_of(spark, z)
    leaves = C.leaf_features(points.selectExpr("w AS weight", "z"), leaves=20, fan=2).toPandas()
    assert len(leaves) <= 20 and leaves.n.sum() == 1600
    assert np.average(np.array(leaves.z.tolist()), axis=0, weights=leaves.n) == pytest.approx(z.mean(0))
    got = C.agglomerate(points, 3, leaves=20).toPandas().sort_values("id").cluster.to_numpy()
    assert (got == np.repeat([0, 1, 2], [900, 500, 200])).all()
    assert [(x.cluster, x.n) for x in C.cluster_sizes(C.agglomerate(points, 3, leaves=20)).orderBy("cluster").collect()] == [(0, 900), (1, 500), (2, 200)]


def test_odd_rows_and_refusals(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [5.0, 5.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0])]
    points = spark.createDataFrame(rows, "id long, z array<double>")
    got = {x.id: x.cluster for x in C.agglomerate(points, 3).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: None, 5: None, 6: None, 7: None}
    assert {x.cluster for x in C.agglomerate(points.where("id > 3"), 2).collect()} == {None}
    assert C.agglomerate(points.limit(0), 2).count() == 0
    for bad, options in ((points.union(spark.createDataFrame([(9, [1.0])], points.schema)), {}), (points.withColumn("cluster", points.id), {}),
                         (points, {"k": 0}), (points, {"leaves": 1}), (points.selectExpr("*", "id - 1 AS w"), {"weight": "w"}),
                         (points, {"leaves": C.LEAF_VALUES})):
        with pytest.raises(ContractError):
            C.agglomerate(bad, options.pop("k", 2), **options)
