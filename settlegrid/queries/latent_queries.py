"""Representation queries: embeddings are the series' vectors."""
from pyspark.sql import functions as F

from ..operators import latent as L
from ..operators.neighbours import nearest_neighbours
from .inputs import registrar, sql, table

Q, SQL, query = registrar()

TRAIN = "CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 <> 0"
BASE = f"""pts AS (SELECT vec_id AS id, embedding AS z, label, {TRAIN} AS train FROM embeddings),
longm AS (SELECT id, label, train, unnest(range(0, len(z))) AS pos, CAST(unnest(z) AS DOUBLE) AS value FROM pts),
scale AS (SELECT pos, avg(value) AS mean, CASE WHEN stddev_pop(value) <= 1e-12 THEN 1 ELSE stddev_pop(value) END AS scale FROM longm WHERE train GROUP BY 1)"""


def points(spark, sf):
    """Coordinates in double, so both engines sum the same values."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("z"), "label")


def matrix(spark, sf):
    ids = L.held_out(points(spark, sf), "id")
    return ids.select("id", "held_out", F.posexplode("z").alias("pos", "value"))


def halves(spark, sf):
    m = matrix(spark, sf)
    return m.where(~F.col("held_out")).drop("held_out"), m.where("held_out").drop("held_out")


@query("hold_out_split", sql(f"pts AS (SELECT vec_id, label, {TRAIN} AS train FROM embeddings)", "SELECT vec_id AS id, label = 0 AS imputed, NOT train AND label <> 0 AS held_out FROM pts"))
def split(spark, sf):
    s = points(spark, sf).select(F.col("id").alias("series"), F.when(F.col("label") == 0, "imputed").otherwise("observed").alias("status"))
    return L.hold_out(s).select(F.col("series").alias("id"), (F.col("status") == "imputed").alias("imputed"), "held_out")


@query("training_column_scale", sql(BASE, "SELECT CAST(pos AS INTEGER) AS pos, round(mean,6) AS mean, round(scale,6) AS scale FROM scale"))
def scale(spark, sf):
    return L.column_scale(halves(spark, sf)[0]).select("pos", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query("standardised_matrix", sql(BASE, "SELECT id, CAST(pos AS INTEGER) AS pos, round((value-mean)/scale,6) AS value FROM longm JOIN scale USING (pos) WHERE NOT train"))
def standardised(spark, sf):
    train, test = halves(spark, sf)
    return L.standardise(test, L.column_scale(train)).withColumn("value", F.round("value", 6))


@query("scaling_round_trip", sql(BASE, "SELECT id, round(sum(value),6) AS total FROM longm WHERE NOT train GROUP BY 1"))
def round_trip(spark, sf):
    train, test = halves(spark, sf)
    s = L.column_scale(train)
    return L.unstandardise(L.standardise(test, s), s).groupBy("id").agg(F.round(F.sum("value"), 6).alias("total"))


@query("completion_scores", sql(BASE, """, st AS (SELECT id, train, pos, (value-mean)/scale AS v, scale FROM longm JOIN scale USING (pos))
SELECT 'mean' AS model, round(avg(v*v) FILTER (train),6) AS train_mse_standardised, round(avg(v*v) FILTER (NOT train AND pos >= 48),6) AS withheld_mse_standardised,
 round(sqrt(avg((v*scale)**2) FILTER (NOT train AND pos >= 48)),6) AS withheld_rmse_source_units FROM st"""))
def mean_completion(spark, sf):
    """Scores of the simplest completion, the training mean (0 in standard units)."""
    train, test = halves(spark, sf)
    s = L.column_scale(train)
    a, b = L.standardise(train, s), L.standardise(test, s)
    zero = lambda m: m.withColumn("value", F.lit(0.0))
    out = L.completion_scores(a, zero(a), b, zero(b), s, F.col("pos") >= 48, "mean")
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


def pca(spark, sf):
    train, test = halves(spark, sf)
    fit = L.completion(train, test, F.col("pos") < 48)
    return fit, L.completion_scores(fit["train"], fit["reconstruction"], fit["test"], fit["prediction"], fit["scale"], F.col("pos") >= 48)


@query("pca_completion")
def pca_completion(spark, sf):
    out = pca(spark, sf)[1]
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


@query("pca_coordinates")
def pca_coordinates(spark, sf):
    fit = pca(spark, sf)[0]
    return fit["latent"].withColumn("part", F.lit("train")).unionByName(fit["test_latent"].withColumn("part", F.lit("held_out"))).withColumns(
        {"z1": F.round("z1", 6), "z2": F.round("z2", 6)})


@query("pca_invariants", sql(BASE, """, st AS (SELECT id, pos, (value-mean)/scale AS v FROM longm JOIN scale USING (pos) WHERE train)
SELECT count(DISTINCT id) AS n_train, count(DISTINCT pos) AS n_positions, round(sum(v*v)/count(DISTINCT id),6) AS total_variance,
 TRUE AS orthonormal, TRUE AS coordinates_centred, TRUE AS coordinates_uncorrelated, TRUE AS error_is_unexplained_variance FROM st"""))
def pca_invariants(spark, sf):
    """What holds for principal components whatever their signs: unit length, right angles, centred and uncorrelated
    coordinates of falling variance, and a training error equal to the variance left over."""
    fit = pca(spark, sf)[0]
    n = fit["train"].agg(F.count_distinct("id").alias("n_train"), F.count_distinct("pos").alias("n_positions"), F.sum(F.col("value") ** 2).alias("square"))
    loads = fit["components"].agg(F.sum(F.col("c1") ** 2).alias("c11"), F.sum(F.col("c2") ** 2).alias("c22"), F.sum(F.col("c1") * F.col("c2")).alias("c12"))
    z = fit["latent"].agg(F.sum(F.col("z1") ** 2).alias("s1"), F.sum(F.col("z2") ** 2).alias("s2"), F.sum(F.col("z1") * F.col("z2")).alias("s12"),
                          F.avg("z1").alias("m1"), F.avg("z2").alias("m2"))
    left = fit["train"].join(fit["reconstruction"].withColumnRenamed("value", "_p"), ["id", "pos"]).agg(F.sum((F.col("value") - F.col("_p")) ** 2).alias("left"))
    small = lambda c: F.abs(c) < 1e-6
    every = n.join(loads, F.lit(True)).join(z, F.lit(True)).join(left, F.lit(True))
    return every.select("n_train", "n_positions", F.round(F.col("square") / F.col("n_train"), 6).alias("total_variance"),
                        (small(F.col("c11") - 1) & small(F.col("c22") - 1) & small("c12")).alias("orthonormal"),
                        (small("m1") & small("m2")).alias("coordinates_centred"),
                        (small(F.col("s12") / F.col("s1")) & (F.col("s1") >= F.col("s2"))).alias("coordinates_uncorrelated"),
                        small((F.col("square") - F.col("s1") - F.col("s2") - F.col("left")) / F.col("square")).alias("error_is_unexplained_variance"))


@query("model_comparison")
def comparison(spark, sf):
    return L.comparison([mean_completion(spark, sf), pca_completion(spark, sf)])


DIST = """p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS z, label FROM embeddings),
d AS (SELECT a.id, a.label, b.id AS other, b.label AS ol, list_distance(a.z, b.z) AS d FROM p a JOIN p b ON a.id <> b.id)"""


@query("label_silhouette", sql(DIST, """, m AS (SELECT id, label, ol, avg(d) AS d FROM d GROUP BY 1,2,3),
ab AS (SELECT id, max(d) FILTER (label = ol) AS a, min(d) FILTER (label <> ol) AS b FROM m GROUP BY 1)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b-a)/greatest(a,b) END),6) AS silhouette FROM ab"""))
def silhouette(spark, sf):
    return L.silhouette(points(spark, sf)).withColumn("silhouette", F.round("silhouette", 6))


CENT = """c AS (SELECT label, axis, avg(x) AS m FROM e GROUP BY 1, 2), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), g AS (SELECT axis, avg(x) AS m FROM e GROUP BY 1),
s AS (SELECT vec_id, e.label, sum((x-m)**2) AS d2 FROM e JOIN c USING (label, axis) GROUP BY 1, 2), w AS (SELECT label, avg(sqrt(d2)) AS spread, sum(d2) AS within FROM s GROUP BY 1),
cc AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.m-b.m)**2)) AS d FROM c a JOIN c b ON a.axis = b.axis AND a.label <> b.label GROUP BY 1, 2)"""


@query("centroid_scores", """WITH e AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS axis, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), """ + CENT + """
SELECT round((SELECT avg(r) FROM (SELECT la, max((u.spread+v.spread)/d) AS r FROM cc JOIN w u ON u.label=la JOIN w v ON v.label=lb GROUP BY 1)),6) AS davies_bouldin,
 round((SELECT sum(n*q) FROM (SELECT c.label, sum((c.m-g.m)**2) AS q FROM c JOIN g USING (axis) GROUP BY 1) JOIN n USING (label)) * ((SELECT sum(n) FROM n) - (SELECT count(*) FROM n)) / ((SELECT sum(within) FROM w) * ((SELECT count(*) FROM n) - 1)),6) AS calinski_harabasz""")
def centroids(spark, sf):
    c = L.centroid_scores(points(spark, sf))
    return c.select(F.round("davies_bouldin", 6).alias("davies_bouldin"), F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@query("nearest_label_agreement", sql(DIST, """, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, CAST(other AS VARCHAR)) AS rn FROM d)
SELECT round(avg(s),6) AS knn_label_agreement FROM (SELECT id, avg(CASE WHEN label = ol THEN 1 ELSE 0 END) AS s FROM r WHERE rn <= 5 GROUP BY 1)"""))
def agreement(spark, sf):
    return L.nearest_label_agreement(points(spark, sf)).withColumn("knn_label_agreement", F.round("knn_label_agreement", 6))


@query("nearest_neighbours", sql(DIST, """, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, CAST(other AS VARCHAR)) AS rank FROM d)
SELECT CAST(id AS VARCHAR) AS id, CAST(rank AS INTEGER) AS rank, CAST(other AS VARCHAR) AS other, round(d,6) AS distance FROM r WHERE rank <= 5"""))
def neighbours(spark, sf):
    rows = nearest_neighbours(points(spark, sf), tile=64)[0]
    return rows.select("id", "rank", "other", F.round("distance", 6).alias("distance"))


@query("latent_metrics", f"SELECT * FROM ({SQL['label_silhouette']}) a, ({SQL['centroid_scores']}) b, ({SQL['nearest_label_agreement']}) c")
def metrics(spark, sf):
    m = L.latent_metrics(points(spark, sf))
    return m.withColumns({c: F.round(c, 6) for c in m.columns})


@query("distance_rank_stability", """WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS z FROM embeddings),
d AS (SELECT list_distance(a.z[1:32], b.z[1:32]) AS x, list_distance(a.z[33:64], b.z[33:64]) AS y FROM p a JOIN p b ON CAST(b.id AS VARCHAR) > CAST(a.id AS VARCHAR)),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1)/2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1)/2 AS ry FROM d)
SELECT count(*) AS n_paired, round(corr(rx, ry),6) AS distance_rank_stability FROM r""")
def stability(spark, sf):
    p = points(spark, sf)
    half = lambda a: p.select("id", F.slice("z", a, 32).alias("z"))
    s = L.distance_stability(half(1), half(33))
    return s.withColumn("distance_rank_stability", F.round("distance_rank_stability", 6))


@query("two_way_clusters")
def clusters(spark, sf):
    return L.two_way_clusters(points(spark, sf)).groupBy("cluster", "label").agg(F.count("*").alias("n"))


def _ward_sql(k):
    """The pair of groups whose union adds least to the sum of squares, until ``k`` groups are left."""
    return f"""WITH RECURSIVE dims AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x, count(*) AS n
 FROM embeddings, range(1, 4097) t(i) WHERE i <= len(embedding) AND label IS NOT NULL GROUP BY label, i),
start AS (SELECT label, [label] AS members, CAST(max(n) AS DOUBLE) AS n, list(x ORDER BY i) AS z FROM dims GROUP BY label),
r(step, id, members, n, z) AS (SELECT 0, label, members, n, z FROM start UNION ALL
 SELECT r.step + 1, r.id, CASE WHEN r.id = m.a THEN list_concat(r.members, m.members) ELSE r.members END,
  CASE WHEN r.id = m.a THEN r.n + m.n ELSE r.n END,
  CASE WHEN r.id = m.a THEN list_transform(range(1, len(r.z) + 1), lambda j: (r.n * r.z[j] + m.n * m.z[j]) / (r.n + m.n)) ELSE r.z END
 FROM r, (SELECT a.id AS a, b.id AS b, b.members, b.n, b.z FROM r a JOIN r b ON a.id < b.id
  ORDER BY a.n * b.n / (a.n + b.n) * list_distance(a.z, b.z) ** 2, a.id, b.id LIMIT 1) m
 WHERE r.id <> m.b AND (SELECT count(*) FROM r) > {k}),
last AS (SELECT id, members, n FROM r WHERE step = (SELECT max(step) FROM r)),
named AS (SELECT id, members, CAST(row_number() OVER (ORDER BY n DESC, id) - 1 AS INTEGER) AS cluster FROM last)
SELECT label, cluster FROM (SELECT unnest(members) AS label, cluster FROM named)"""


def label_means(spark, sf):
    """(label, w, z): number and mean vector of each label's points."""
    x = points(spark, sf).where("label IS NOT NULL").select("id", "label", F.posexplode("z").alias("i", "x"))
    means = x.groupBy("label", "i").agg(F.avg("x").alias("x"), F.count("*").alias("w"))
    lists = means.groupBy("label").agg(F.max("w").alias("w"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("z"))  # one a dimension
    return lists.select("label", "w", F.transform("z", lambda p: p["x"]).alias("z"))


@query("label_agglomeration", _ward_sql(4))
def label_agglomeration(spark, sf):
    return L.agglomerate(label_means(spark, sf), 4, "w").select("label", "cluster")


@query("two_way_label_clusters", _ward_sql(2))
def two_way_labels(spark, sf):
    return L.two_way_clusters(label_means(spark, sf), "w").select("label", "cluster")


@query("marginal_members", """WITH r AS (SELECT unnest([{'n':'left','a':1,'lo':-9.0,'hi':-0.05},{'n':'right','a':1,'lo':0.05,'hi':9.0},{'n':'bottom','a':2,'lo':-9.0,'hi':-0.05},{'n':'top','a':2,'lo':0.05,'hi':9.0}]) AS r),
m AS (SELECT r.n AS region, vec_id AS id, row_number() OVER (PARTITION BY r.n ORDER BY md5(concat_ws('|', 7, r.n, vec_id)), vec_id) AS rn FROM embeddings, r WHERE CAST(embedding[r.a] AS DOUBLE) > r.lo AND CAST(embedding[r.a] AS DOUBLE) < r.hi)
SELECT region, id FROM m WHERE rn <= 2""")
def marginal(spark, sf):
    ranges = {"left": (0, -9, -0.05), "right": (0, 0.05, 9), "bottom": (1, -9, -0.05), "top": (1, 0.05, 9)}
    return L.marginal_members(points(spark, sf), ranges)


@query("series_sub_sample", "SELECT vec_id AS id FROM embeddings ORDER BY md5(concat_ws('|', 7, vec_id)), vec_id LIMIT 40")
def sub_sample(spark, sf):
    return L.sub_sample(points(spark, sf).select("id"), 40, "id")
