"""Temperature, association, ranks and representation operators against brute force."""
import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from settlegrid.functions import ranks as K
from settlegrid.functions.windows import hash_sample, md5_order
from settlegrid.operators import association as A, latent as L, weather as T


def at(h, m=0):
    return datetime(2022, 1, 31, 22, tzinfo=timezone.utc) + timedelta(hours=h, minutes=m)


def test_half_hours_do_not_bridge_a_missing_hour(spark):
    hourly = spark.createDataFrame([(at(0), "A", 2.0), (at(1), "A", 6.0), (at(3), "A", 10.0)], "ts timestamp, region string, temperature_c double")
    got = [r["temperature_c"] for r in T.half_hourly(hourly).orderBy("ts").collect()]
    assert got == [2.0, 4.0, 6.0, None, None, None, 10.0, None]
    with pytest.raises(Exception, match="hourly"):
        T.half_hourly(hourly.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE"))).collect()


def test_weights_are_renormalised(spark):
    w = spark.createDataFrame([("R", 1, 1.0), ("R", 2, 3.0)], "region string, cell int, area double")
    g = spark.createDataFrame([(at(0), 1, 2.0), (at(0), 2, 6.0), (at(1), 1, 2.0), (at(1), 2, float("nan")), (at(2), 1, None)],
                              "ts timestamp, cell int, temperature_c double")
    assert [r["temperature_c"] for r in T.regional_mean(g, w).orderBy("ts").collect()] == [5.0, 2.0, None]


def test_aliases(spark):
    got = {r["region"]: r["source_regions"] for r in T.alias_sources(spark.createDataFrame([("A | B",), ("B",)], "label string")).collect()}
    assert got == {"A | B": "A | B", "A": "A | B", "B": "A | B;B"}


def test_polygons_agree_with_boxes_and_sea_stays_out(spark):
    cells = spark.createDataFrame([(i, 50.0 + 0.5 * (i // 4), -1.0 + 0.5 * (i % 4)) for i in range(16) if i != 5], "cell int, lat double, lon double")
    box = spark.createDataFrame([("R", 50.1, 51.2, -0.9, 0.3)], "region string, lat_min double, lat_max double, lon_min double, lon_max double")
    ring = box.select("region", F.array("lat_min", "lat_min", "lat_max", "lat_max").alias("lats"), F.array("lon_min", "lon_max", "lon_max", "lon_min").alias("lons"))
    spec = (50.0, -1.0, 0.5, 0.5)
    a = {r["cell"]: r["area"] for r in T.box_weights(box, cells, spec).collect()}
    b = {r["cell"]: r["area"] for r in T.polygon_weights(ring, cells, spec).collect()}
    assert a.keys() == b.keys() and 5 not in a and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)
    cover = T.coverage_table(T.box_weights(box, cells, spec), box.select("region", T.box_area().alias("region_area"))).first()
    assert 0.6 < cover["coverage_fraction"] < 1 and cover["grid_cells"] == len(a)


def test_polygon_with_hole_and_parts(spark):
    cells = spark.createDataFrame([(i, 0.5 + i // 4, 0.5 + i % 4) for i in range(16)], "cell int, lat double, lon double")
    rings = [("R", [0.0, 0.0, 3.0, 3.0], [0.0, 3.0, 3.0, 0.0]), ("R", [1.0, 2.0, 2.0, 1.0], [1.0, 1.0, 2.0, 2.0]), ("R", [3.5, 3.5, 4.0], [3.5, 4.0, 4.0])]
    got = {r["cell"]: r["area"] for r in T.polygon_weights(spark.createDataFrame(rings, "region string, lats array<double>, lons array<double>"),
                                                          cells, (0.5, 0.5, 1.0, 1.0)).collect()}
    y = lambda lat: math.sin(math.radians(lat)) * T.EARTH_RADIUS
    width = math.radians(1) * T.EARTH_RADIUS
    want = {i: width * (y(i // 4 + 1) - y(i // 4)) for i in (0, 1, 2, 4, 6, 8, 9, 10)} | {15: width / 2 * (y(4) - y(3.5)) / 2}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def clipped_area(points, x0, x1, y0, y1):
    """Area of a polygon inside a rectangle: cut by its four sides in turn, then the shoelace formula."""
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        kept = []
        for p, q in zip(points, points[1:] + points[:1]):
            dp, dq = sign * (p[axis] - limit), sign * (q[axis] - limit)
            if dp >= 0:
                kept.append(p)
            if dp * dq < 0:
                kept.append(tuple(a + (b - a) * dp / (dp - dq) for a, b in zip(p, q)))
        points = kept
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1]))) / 2 if points else 0.0


def test_star_polygons_against_clipping(spark):
    rng = np.random.default_rng(8)
    lat0, lon0, step = 49.0, -3.0, 0.25
    grid = [(iy * 30 + ix, lat0 + step * iy, lon0 + step * ix) for iy in range(24) for ix in range(30)]
    cells = spark.createDataFrame(grid, "cell int, lat double, lon double")
    rings = []
    for name, points, size in (("small", 5, 0.05), ("star", 41, 2.4), ("large", 400, 2.7), ("flat", 7, 1.5)):
        turn = np.sort(rng.random(points)) * 2 * np.pi
        reach = size * (0.4 + 0.6 * rng.random(points))
        lats, lons = 51.9 + reach * np.sin(turn) * (0.02 if name == "flat" else 1), 0.55 + reach * np.cos(turn)
        rings.append((name, lats.tolist(), lons.tolist()) if name != "star" else (name, lats[::-1].tolist(), lons[::-1].tolist()))
    got = {(r["region"], r["cell"]): r["area"] for r in T.polygon_weights(
        spark.createDataFrame(rings, "region string, lats array<double>, lons array<double>"), cells, (lat0, lon0, step, step)).collect()}
    x = lambda lon: math.radians(lon) * T.EARTH_RADIUS
    y = lambda lat: math.sin(math.radians(lat)) * T.EARTH_RADIUS
    want = {}
    for name, lats, lons in rings:
        points = [(x(b), y(a)) for a, b in zip(lats, lons)]
        for cell, lat, lon in grid:
            area = clipped_area(points, x(lon - step / 2), x(lon + step / 2), y(lat - step / 2), y(lat + step / 2))
            if area > 1e-3:
                want[name, cell] = area
    assert got.keys() >= want.keys() and all(math.isclose(got[k], want.get(k, 0), rel_tol=1e-6, abs_tol=2.0) for k in got)
    assert len(want) > 400


def test_half_hours_fill_the_common_axis_with_gaps(spark):
    rows = [("A", at(1), 1.0), ("A", at(2), 3.0), ("A", at(5), 9.0), ("B", at(0), 4.0), ("B", at(6), 8.0)]
    filled = T.half_hourly(spark.createDataFrame(rows, "region string, ts timestamp, temperature_c double"))
    got = {(r["region"], r["h"], r["m"]): r["temperature_c"] for r in filled.select("region", F.hour("ts").alias("h"), F.minute("ts").alias("m"), "temperature_c").collect()}
    assert len(got) == 2 * 14
    assert {k: v for k, v in got.items() if v is not None} == {
        ("A", 23, 0): 1.0, ("A", 23, 30): 2.0, ("A", 0, 0): 3.0, ("A", 3, 0): 9.0, ("B", 22, 0): 4.0, ("B", 4, 0): 8.0}


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value and one group holds most rows."""
    rng = np.random.default_rng(3)
    rows = [("hot", 0.0, float(v)) for v in rng.normal(size=400)] + [("hot", float(x), float(v)) for x, v in rng.normal(size=(600, 2)).round(1)]
    rows += [("cold", float(x), float(v)) for x, v in rng.normal(size=(30, 2))] + [("cold", None, 1.0)]
    return rows, spark.createDataFrame(rows, "g string, x double, y double")


def test_distributed_quantiles_equal_numpy(skewed):
    rows, df = skewed
    got = {r["g"]: r for r in K.exact_quantiles(df, ["g"], "x", {"a": 0.05, "b": 0.5, "c": 0.975}).collect()}
    for g in ("hot", "cold"):
        want = np.quantile([x for k, x, _ in rows if k == g and x is not None], [0.05, 0.5, 0.975])
        assert np.allclose([got[g][c] for c in "abc"], want)


def average_rank(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_distributed_spearman_equals_brute_force(skewed):
    rows, df = skewed
    got = {r["g"]: r for r in K.spearman(df, ["g"], "x", "y").collect()}
    for g in ("hot", "cold"):
        x, y = zip(*[(a, b) for k, a, b in rows if k == g and a is not None])
        assert math.isclose(got[g]["spearman"], np.corrcoef(average_rank(x), average_rank(y))[0, 1], rel_tol=1e-9)
        assert got[g]["n_paired"] == len(x)


def test_total_order_with_heavy_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(f"id{i:05d}", 0.0 if i % 3 else float(rng.integers(0, 50))) for i in range(3000)]
    got = K.ordered_positions(spark.createDataFrame(rows, "k string, v double"), "v", "k").collect()
    assert {r["k"]: r["position"] for r in got} == {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r["size"] for r in got} == {3000}


def test_hash_sample_is_exact(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 10 == 0, "b").otherwise("a"))
    got = hash_sample(df, ["g"], 300, md5_order("id")).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"a": 300, "b": 300}
    rest = hash_sample(df, ["g"], 10**6, md5_order("id"))
    assert rest.count() == 5000


def test_guarded_correlation(spark):
    df = spark.createDataFrame([("c", 1.0, 2.0)] * 5 + [("two", 1.0, 2.0), ("two", 2.0, 1.0)] + [("ok", float(i), -float(i)) for i in range(4)] + [("ok", None, 9.0)],
                               "series string, temperature_c double, demand double")
    got = {r["series"]: r["pearson"] for r in A.correlate(df, ["series"]).collect()}
    assert got["c"] is None and got["two"] is None and math.isclose(got["ok"], -1.0)


def test_mutual_information_finds_a_parabola():
    rng = np.random.default_rng(5)
    x = rng.uniform(-3, 3, 600)
    assert A.mutual_information(x, x * x) > 1.0 and A.mutual_information(x, rng.permutation(x * x)) < 0.1
    assert A._mi_row(x[:10], x[:10], 1)[1] is None and A._mi_row(np.ones(50), x[:50], 1)[1] is None


def bspline(x, knots, j, degree):
    """Basis by the textbook recursion."""
    if degree == 0:
        return ((knots[j] <= x) & (x < knots[j + 1])).astype(float)
    left = (x - knots[j]) / (knots[j + degree] - knots[j]) * bspline(x, knots, j, degree - 1)
    right = (knots[j + degree + 1] - x) / (knots[j + degree + 1] - knots[j + 1]) * bspline(x, knots, j + 1, degree - 1)
    return left + right


def test_spline_equals_a_direct_ridge_fit(spark):
    rng = np.random.default_rng(6)
    t0 = datetime(2021, 6, 1, 12, tzinfo=timezone.utc)
    x, g = rng.uniform(0, 20, 500), rng.integers(0, 4, 500)
    y = x * x / 50
    rows = [(f"s{k}", t0 + timedelta(days=i), float(a), float(b)) for i, (k, a, b) in enumerate(zip(g, x, y))]
    df = spark.createDataFrame(rows, "series string, ts timestamp, temperature_c double, demand_z double").withColumn("demand", F.col("demand_z"))
    got = A.spline_curves(df).where("scope = 'overall'").orderBy("temperature_c").collect()
    step = (x.max() - x.min()) / 5
    knots = x.min() + step * np.arange(-3, 9)
    basis = lambda v: np.stack([bspline(np.asarray(v), knots, j, 3) for j in range(7)], axis=1)
    w = 1 / np.bincount(g)[g]
    w = w / w.mean()
    b = basis(np.minimum(x, x.max() - 1e-12))
    mean, my = (w[:, None] * b).sum(0) / w.sum(), (w * y).sum() / w.sum()
    coef = np.linalg.solve(((b - mean) * w[:, None]).T @ (b - mean) + np.eye(7), ((b - mean) * w[:, None]).T @ (y - my))
    grid = np.linspace(*np.quantile(x, [0.01, 0.99]), 150)
    assert np.allclose([r["temperature_c"] for r in got], grid)
    assert np.allclose([r["fitted_demand_z"] for r in got], my - mean @ coef + basis(grid) @ coef, atol=1e-6)


def test_derangement(spark):
    t0 = datetime(2022, 1, 1, tzinfo=timezone.utc)
    origins = spark.createDataFrame([(i, t0 + timedelta(days=13 * i)) for i in range(29)], "origin_pos int, origin timestamp")
    rows = A.season_derangement(origins, 3).collect()
    for repeat in range(3):
        mine = [r for r in rows if r["repeat"] == repeat]
        assert {r["origin_pos"] for r in mine} == {r["donor_origin_pos"] for r in mine} == set(range(29))
        assert all(r["origin_pos"] != r["donor_origin_pos"] for r in mine)
        season = {r["origin_pos"]: r["season"] for r in mine}
        assert all(season[r["donor_origin_pos"]] == r["season"] for r in mine)
    with pytest.raises(Exception, match="two origins"):
        A.season_derangement(origins.limit(1), 1).collect()


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    z = np.r_[rng.normal(size=(40, 3)), rng.normal(size=(20, 3)) + 3]
    labels = [0] * 40 + [1] * 20
    df = spark.createDataFrame([(i, [float(v) for v in p], lab) for i, (p, lab) in enumerate(zip(z, labels))], "id int, z array<double>, label int")
    return z, np.array(labels), df


@pytest.mark.parametrize("tile", [512, 9])
def test_block_scores_equal_brute_force(cloud, tile):
    z, lab, df = cloud
    d = np.sqrt(((z[:, None] - z) ** 2).sum(-1))
    s = []
    for i in range(len(z)):
        own = lab == lab[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = d[i, ~own].mean()
        s.append((b - a) / max(a, b))
    assert math.isclose(L.silhouette(df, tile).first()[0], np.mean(s), rel_tol=1e-9)
    np.fill_diagonal(d, np.inf)
    knn = np.mean([np.mean(lab[np.argsort(d[i], kind="stable")[:5]] == lab[i]) for i in range(len(z))])
    assert math.isclose(L.nearest_label_agreement(df, tile=tile).first()[0], knn, rel_tol=1e-9)


def test_distances_survive_a_rotation(cloud, spark):
    z, _, df = cloud
    q, _ = np.linalg.qr(np.random.default_rng(8).normal(size=(3, 3)))
    turned = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(z @ q)], "id int, z array<double>")
    r = L.distance_stability(df, turned, tile=16).first()
    assert r["n_paired"] == 60 * 59 // 2 and r["distance_rank_stability"] > 0.999999
    flat = df.select("id", F.array(F.lit(0.0)).alias("z"))
    assert L.distance_stability(df, flat).first()["distance_rank_stability"] is None


def test_one_class_has_no_separation_scores(cloud):
    m = L.latent_metrics(cloud[2].withColumn("label", F.lit(1))).first()
    assert m["silhouette"] is None and m["davies_bouldin"] is None and m["knn_label_agreement"] == 1.0


def test_withheld_values_never_enter_the_completion(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12, 10))
    rows = lambda m, ids: spark.createDataFrame([(int(i), j, float(m[i, j])) for i in ids for j in range(10)], "id int, pos int, value double")
    changed = x.copy()
    changed[10:, 7:] = 1e6
    get = lambda m: {(r["id"], r["pos"]): r["value"] for r in L.completion(rows(m, range(10)), rows(m, (10, 11)), F.col("pos") < 7)["prediction"].collect()}
    a, b = get(x), get(changed)
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-12) for k in a)
    train = (x[:10] - x[:10].mean(0)) / x[:10].std(0)
    v = np.linalg.svd(train, full_matrices=False)[2][:2]
    t = (x[10:] - x[:10].mean(0)) / x[:10].std(0)
    z = np.linalg.lstsq(v[:, :7].T, t[:, :7].T, rcond=None)[0].T
    assert np.allclose([a[(10 + i, j)] for i in range(2) for j in range(10)], (z @ v).ravel())
