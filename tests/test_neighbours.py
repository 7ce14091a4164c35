"""The metric index against brute force, and the pairs of blocks it leaves out."""
import numpy as np
import pytest

from settlegrid.operators.neighbours import _ringed, nearest_neighbours


def points(spark, z, labels):
    return spark.createDataFrame([(i, [float(v) for v in r], int(lab)) for i, (r, lab) in enumerate(zip(z, labels))],
                                 "id int, z array<double>, label int")


def brute(z, k):
    out = {}
    for i, row in enumerate(z):
        d = np.sqrt(((z - row) ** 2).sum(1))
        out[str(i)] = [(str(j), d[j]) for j in sorted((j for j in range(len(z)) if j != i), key=lambda j: (d[j], str(j)))[:k]]
    return out


@pytest.mark.parametrize("case", ["clusters", "uniform", "equal", "line", "few"])
def test_neighbours_equal_brute_force(spark, case):
    r = np.random.default_rng(3)
    z = {"clusters": lambda: r.normal(size=(12, 5)).repeat(30, 0) * 20 + r.normal(size=(360, 5)),
         "uniform": lambda: r.random((200, 3)), "equal": lambda: np.r_[np.zeros((120, 2)), r.normal(size=(40, 2))],
         "line": lambda: np.arange(90.0)[:, None], "few": lambda: r.random((4, 2))}[case]()
    rows, visits = nearest_neighbours(points(spark, z, np.arange(len(z)) % 3), 5, 16)
    got = {}
    for x in rows.collect():
        got.setdefault(x["id"], {})[x["rank"]] = (x["other"], x["distance"])
        assert x["label"] == int(x["id"]) % 3 and x["other_label"] == int(x["other"]) % 3
    want = brute(z, 5)
    assert got.keys() == want.keys()
    for i, near in want.items():
        assert [got[i][k + 1][0] for k in range(len(near))] == [o for o, _ in near]
    v = visits.first()
    assert v["blocks"] <= v["visited_pairs"] <= v["all_pairs"]
    if case == "clusters":
        assert v["visited_pairs"] < 0.5 * v["all_pairs"]


@pytest.mark.parametrize("case", ["uniform", "copies", "far"])
def test_few_blocks_are_shipped_and_hold_many_rings(spark, case):
    r = np.random.default_rng(6)
    z = {"uniform": lambda: r.normal(size=(1200, 8)), "copies": lambda: np.r_[np.ones((700, 3)), r.normal(size=(500, 3)).round(1)],
         "far": lambda: 1e5 + r.normal(size=(1100, 3))}[case]()
    rows, visits = nearest_neighbours(points(spark, z, np.arange(len(z)) % 3), 5, 16)
    _, blocks, _, number = _ringed(points(spark, z, np.zeros(len(z))), 16, 5)
    assert blocks.count() == number == 3 and visits.first()["blocks"] >= len(z) / 16
    got = {(x["id"], x["rank"]): (x["other"], x["distance"]) for x in rows.collect()}
    want = {(i, n + 1): near for i, found in brute(z, 5).items() for n, near in enumerate(found)}
    assert got == want
