"""All-pairs scores by blocks: how often a point is shipped, copies, points far from the origin."""
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from settlegrid.operators import latent as L, neighbours as N
from settlegrid.operators.blocks import BLOCKS, block_count, from_bytes, paired, to_bytes


def cloud(spark, z, labels):
    return spark.createDataFrame([(i, [float(v) for v in r], lab) for i, (r, lab) in enumerate(zip(z, labels))], "id int, z array<double>, label int")


def test_shipped_blocks_do_not_grow_with_the_points(spark):
    sizes = [spark.range(n).select("id", F.array(F.lit(0.0)).alias("z")) for n in (40, 1000, 4000)]
    assert [block_count(s, 8) for s in sizes] == [(40, 5), (1000, BLOCKS), (4000, BLOCKS)]
    blocks = spark.range(BLOCKS).select(F.col("id").cast("int").alias("block"))
    met = paired(blocks, 300, F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    assert met.count() == BLOCKS ** 2 and met.select("i", "j").distinct().count() == BLOCKS * (BLOCKS + 1) // 2


def test_silhouette_of_copies_far_from_the_origin(spark):
    r = np.random.default_rng(5)
    z = np.r_[np.repeat(r.normal(size=(3, 4)), 25, 0), r.normal(size=(60, 4)) * 1e-3] + 1e4
    lab = np.r_[np.arange(75) % 2, np.full(59, 3), [4]]
    d = np.sqrt(((z[:, None] - z) ** 2).sum(-1))
    s = []
    for i in range(len(z)):
        own = lab == lab[i]
        b = min(d[i, lab == x].mean() for x in set(lab) - {lab[i]})
        a = d[i, own].sum() / (own.sum() - 1) if own.sum() > 1 else None
        s.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    assert math.isclose(L.silhouette(cloud(spark, z, lab.tolist()), 10).first()[0], np.mean(s), rel_tol=1e-9)
    unlabelled = [None if i % 7 == 0 else int(x) for i, x in enumerate(lab)]
    rows = L.distances_by_label(cloud(spark, z, unlabelled), 10).collect()
    known = np.array([-1 if x is None else x for x in unlabelled])
    assert len(rows) == len(z) * len(set(known) - {-1})
    for x in rows:
        hit = known == x["other"]
        assert x["n"] == hit.sum() and math.isclose(x["total"], d[int(x["id"]), hit].sum(), rel_tol=1e-7, abs_tol=1e-9)


def test_ranks_of_all_distances_come_from_packed_buckets(spark, monkeypatch):
    """Copies make a third of all distances one value; several blocks, several buckets, no row per pair."""
    monkeypatch.setattr(L, "PAIR_ROWS", 40)
    r = np.random.default_rng(8)
    z = np.r_[np.ones((110, 4)), r.normal(size=(80, 4)).round(1)]
    first, second = (cloud(spark, part, [0] * len(z)) for part in (z[:, :2], z[:, 2:] + r.normal(size=(len(z), 1)).round()))
    p, q = (np.array([x["z"] for x in part.orderBy("id").collect()]) for part in (first, second))
    at = np.triu_indices(len(z), 1)
    x, y = (np.sqrt(((v[at[0]] - v[at[1]]) ** 2).sum(1)) for v in (p, q))
    rank = lambda v: (lambda u, i, n: (np.cumsum(n) - (n - 1) / 2)[i])(*np.unique(v, return_inverse=True, return_counts=True))
    got = L.distance_stability(first, second, 16).first()
    assert got["n_paired"] == len(x) and math.isclose(got["distance_rank_stability"], np.corrcoef(rank(x), rank(y))[0, 1], rel_tol=1e-9)
    alone = L.distance_stability(first.limit(1), second.limit(1)).first()
    assert alone["n_paired"] == 0 and alone["distance_rank_stability"] is None


def scored(spark, monkeypatch, score):
    """(the score, blocks shipped in each step, points, labels) of 1,400 points with tile 9."""
    r = np.random.default_rng(9)
    lab = r.integers(0, 4, 1400)
    z = r.normal(size=(1400, 5)) + lab[:, None] * 0.7
    shipped = []
    for module in (L, N):
        real = module.paired
        monkeypatch.setattr(module, "paired", lambda blocks, *a, real=real: shipped.append(blocks.count()) or real(blocks, *a))
    return score(cloud(spark, z, lab.tolist())).first(), shipped, z, lab


def brute_scores(z, lab):
    d = np.sqrt(((z[:, None] - z) ** 2).sum(-1))
    mean = np.stack([d[:, lab == x].sum(1) / ((lab == x).sum() - (lab == x)) for x in range(4)], 1)
    a, rest = mean[np.arange(len(z)), lab], mean.copy()
    rest[np.arange(len(z)), lab] = np.inf
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1)[:, :5]
    return ((rest.min(1) - a) / np.maximum(a, rest.min(1))).mean(), (lab[near] == lab[:, None]).mean()


def test_label_agreement_ships_few_blocks(spark, monkeypatch):
    got, shipped, z, lab = scored(spark, monkeypatch, lambda p: L.nearest_label_agreement(p, tile=9))
    assert math.isclose(got[0], brute_scores(z, lab)[1], rel_tol=1e-9) and shipped and max(shipped) <= BLOCKS


def test_latent_metrics_ship_few_blocks(spark, monkeypatch):
    got, shipped, z, lab = scored(spark, monkeypatch, L.latent_metrics)
    silhouette, agreement = brute_scores(z, lab)
    assert math.isclose(got["silhouette"], silhouette, rel_tol=1e-9) and math.isclose(got["knn_label_agreement"], agreement, rel_tol=1e-9)
    assert len(shipped) == 2 and max(shipped) <= BLOCKS


def shipped_bytes(monkeypatch):
    """What each step ships, in bytes of packed columns; filled when the step is planned."""
    found = []
    for module in (L, N):
        real = module.paired

        def watched(blocks, *a, real=real):
            met = real(blocks, *a)
            cells = [c for c, kind in met.dtypes if kind == "binary" and c != "ring"]
            found.append(met.agg(sum(F.sum(F.octet_length(c)) for c in cells)).first()[0])
            return met

        monkeypatch.setattr(module, "paired", watched)
    return found


def test_no_more_than_a_dozen_blocks_until_they_outgrow_memory(spark):
    def count(n, width):
        return block_count(spark.range(n).select(F.array_repeat(F.lit(0.0), width).alias("z")), 512)[1]
    assert count(100_000, 64) == count(20_000, 1) == BLOCKS <= 12 and count(1_000_000, 64) > BLOCKS


@pytest.mark.parametrize("single", [True, False])
def test_bytes_of_vectors_lose_nothing(single):
    z = np.random.default_rng(4).normal(size=(7, 3)) * [1.0, 1e-30, 1e30]
    z = z.astype("f4").astype(float) if single else np.r_[z, [[np.inf, np.nan, 1e300]]]
    kept = to_bytes(z)
    assert np.array_equal(from_bytes(pa.scalar(kept), len(z)), z, equal_nan=True) and len(kept) == 1 + z.size * (4 if single else 8)


def test_label_agreement_ships_single_precision_and_reach(spark, monkeypatch):
    r = np.random.default_rng(10)
    lab = r.integers(0, 4, 1400)
    z = (r.normal(size=(1400, 6)) + lab[:, None] * 0.7).astype("f4").astype(float)
    found = shipped_bytes(monkeypatch)
    got = L.nearest_label_agreement(cloud(spark, z, lab.tolist()), tile=9).first()[0]
    assert math.isclose(got, brute_scores(z, lab)[1], rel_tol=1e-9)
    assert len(found) == 1 and found[0] <= 2 * (1400 * (6 * 4 + 8 + 8) + 3)  # three blocks, two partners each; numbers and reach


def test_latent_metrics_ship_single_precision_in_both_steps(spark, monkeypatch):
    r = np.random.default_rng(11)
    lab = r.integers(0, 4, 1400)
    z = (r.normal(size=(1400, 6)) + lab[:, None] * 0.7).astype("f4").astype(float)
    found = shipped_bytes(monkeypatch)
    got = L.latent_metrics(cloud(spark, z, lab.tolist())).first()
    silhouette, agreement = brute_scores(z, lab)
    assert math.isclose(got["silhouette"], silhouette, rel_tol=1e-9) and math.isclose(got["knn_label_agreement"], agreement, rel_tol=1e-9)
    to_all, to_others = 3 * (1400 * 6 * 4 + 3), 2 * (1400 * (6 * 4 + 8 + 8) + 3)  # three blocks; the silhouette meets itself too
    assert len(found) == 2 and found[0] <= to_all and found[1] <= to_others


def brute_ranks(p, q):
    at = np.triu_indices(len(p), 1)
    x, y = (np.sqrt(((v[at[0]] - v[at[1]]) ** 2).sum(1)) for v in (p, q))
    rank = lambda v: (lambda u, i, n: (np.cumsum(n) - (n - 1) / 2)[i])(*np.unique(v, return_inverse=True, return_counts=True))
    return np.corrcoef(rank(x), rank(y))[0, 1]


@pytest.mark.parametrize("kind", ["far and outliers", "few values"])
def test_ranks_of_many_distances_keep_no_pair(spark, monkeypatch, kind):
    """Only blocks of points are shipped; the bounds hold with several blocks, outliers, an offset and ties."""
    from settlegrid.operators import stability as S
    monkeypatch.setattr(L, "PACKED_PAIRS", 10_000)
    monkeypatch.setattr(L, "_packed_stability", lambda *a: pytest.fail("pairs were packed"))
    monkeypatch.setattr(S, "BINS", 400_000)
    monkeypatch.setattr(S, "HELD_BYTES", 2 ** 15)
    found = []
    real = S._bounds
    monkeypatch.setattr(S, "_bounds", lambda *a: found.append(real(*a)) or found[-1])
    r = np.random.default_rng(12)
    z = r.normal(size=(900, 6)) if kind == "far and outliers" else r.integers(0, 3, (900, 6)).astype(float)
    if kind == "far and outliers":
        z[5], z[17] = z[5] * 1e3, z[17] * 1e6
        z += 100
    first, second = (cloud(spark, part, [0] * len(z)) for part in (z[:, :3], z[:, 3:]))
    got = L.distance_stability(first, second, 64, digits=3).first()
    want = brute_ranks(z[:, :3], z[:, 3:])
    assert got["n_paired"] == 900 * 899 // 2 and round(got["distance_rank_stability"], 3) == round(want, 3)
    assert found and all(abs(value - want) <= by < 1e-4 for value, by in found)


def test_ranks_of_many_distances_without_sure_rounding_are_packed(spark, monkeypatch):
    from settlegrid.operators import stability as S
    monkeypatch.setattr(L, "PACKED_PAIRS", 100)
    monkeypatch.setattr(S, "BINS", 8)
    z = np.random.default_rng(13).normal(size=(120, 4))
    first, second = (cloud(spark, part, [0] * len(z)) for part in (z[:, :2], z[:, 2:]))
    got = L.distance_stability(first, second, 16, digits=9).first()[1]
    assert math.isclose(got, brute_ranks(z[:, :2], z[:, 2:]), rel_tol=1e-9)
    flat = cloud(spark, np.ones((120, 2)), [0] * 120)
    assert L.distance_stability(first, flat, 16).first()[1] is None
