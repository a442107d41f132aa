"""Feature vectors: grids, sampling, clustering, classification."""

from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import features as ft, nearest
from ..operators.stats import top_per_group
from ..session import cut_lineage
from . import fixtures as fx
from .registry import query, r6

_CENTERS = "cm AS (SELECT label AS cid, pos, avg(v) AS c FROM flat GROUP BY ALL)"
_DIST = "ds AS (SELECT vec_id, cid, sum((v - c) * (v - c)) AS d FROM flat JOIN cm USING (pos) GROUP BY ALL)"
_ASSIGN = "asg AS (SELECT vec_id, arg_min(cid, {cid: cid, d: d}.d) AS cluster FROM ds GROUP BY vec_id)".replace("{cid: cid, d: d}.d", "d")


def _centers(e):
    return ft.label_means(e, "label", "feature")


@query("tokens_to_grid", fx.with_(fx.EMB, fx.FLAT) + """SELECT vec_id, CAST((pos - 1 - 5) // 8 AS INT) AS gy, CAST((pos - 1 - 5) % 8 AS INT) AS gx, round(v, 6) AS v
  FROM flat WHERE pos > 5""")
def _(spark, sf):
    """Each vector read as a sequence of 64 one-value tokens, class and four
    register tokens first."""
    e = fx.embeddings(spark, sf).select("vec_id", F.lit(8).alias("wp"), F.transform("feature", lambda v: F.array(v)).alias("tokens"))
    return ft.tokens_to_grid(e, "tokens", 4).select("vec_id", "gy", "gx", r6(F.col("feature")[0], "v"))


@query("labels_to_grid", "SELECT vec_id, CAST(label AS INT) AS label, CAST(vec_id // 25 AS INT) AS gy, CAST(vec_id % 25 AS INT) AS gx FROM embeddings")
def _(spark, sf):
    return ft.labels_to_grid(fx.embeddings(spark, sf).drop("feature"), "vec_id", 25)


@query("mean_layers", fx.with_(fx.EMB, fx.FLAT) + """SELECT vec_id, CAST((pos - 1) % 16 AS INT) AS pos, round(avg(v), 6) AS v
  FROM flat GROUP BY vec_id, (pos - 1) % 16""")
def _(spark, sf):
    """Each vector read as four layers of 16 values."""
    layers = F.transform(F.array(*[F.lit(16 * i + 1) for i in range(4)]), lambda s: F.slice("feature", s, F.lit(16)))
    e = fx.embeddings(spark, sf).select("vec_id", layers.alias("layers"))
    return e.select("vec_id", F.posexplode(vec.mean_layers(F.col("layers"))).alias("pos", "v")).select("vec_id", "pos", r6("v"))


@query("sample_rows", f"""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY {fx.hash_sql('o_orderkey')}, o_orderkey) AS r FROM orders) WHERE r <= 1000""")
def _(spark, sf):
    return ft.sample_rows(fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000)


@query("split_80_20", f"SELECT o_orderkey, CASE WHEN {fx.hash_sql('o_orderkey')} % 100 < 80 THEN 'train' ELSE 'val' END AS part FROM orders")
def _(spark, sf):
    return ft.split_80_20(fx.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("assign_clusters", fx.with_(fx.EMB, fx.FLAT, _CENTERS, _DIST, _ASSIGN) + "SELECT vec_id, CAST(cluster AS INT) AS cluster FROM asg")
def _(spark, sf):
    e = fx.embeddings(spark, sf)
    return ft.assign_clusters(e, "feature", _centers(e)).select("vec_id", "cluster")


@query("kmeans_step", fx.with_(fx.EMB, fx.FLAT, _CENTERS, _DIST, _ASSIGN) + """SELECT CAST(cluster AS INT) AS cluster, CAST(pos - 1 AS INT) AS pos, count(*) AS n, round(avg(v), 6) AS v
  FROM asg JOIN flat USING (vec_id) GROUP BY cluster, pos""")
def _(spark, sf):
    e = fx.embeddings(spark, sf)
    s = ft.kmeans_step(e, "feature", _centers(e), "vec_id")
    return s.select("cluster", "n", F.posexplode("center").alias("pos", "v")).select("cluster", "pos", "n", r6("v"))


def _lloyd(start: str, key: str, steps: int) -> list[str]:
    """Unrolled updates: s{i}(key, cid, pos, c) from s{i-1}; rows are f(key, vec_id, pos, v)."""
    out = [f"s0 AS MATERIALIZED ({start})"]
    for i in range(1, steps + 1):
        out += [f"d{i} AS (SELECT f.{key}, vec_id, cid, sum((v - c) * (v - c)) AS d FROM f JOIN s{i - 1} s ON s.{key} = f.{key} AND s.pos = f.pos GROUP BY ALL)",
                f"a{i} AS MATERIALIZED (SELECT {key}, vec_id, cid FROM (SELECT *, row_number() OVER (PARTITION BY {key}, vec_id ORDER BY d, cid) AS r FROM d{i}) WHERE r = 1)"]
        if i < steps:
            out.append(f"s{i} AS MATERIALIZED (SELECT f.{key}, cid, pos, avg(v) AS c FROM a{i} JOIN f ON f.{key} = a{i}.{key} AND f.vec_id = a{i}.vec_id GROUP BY ALL)")
    return out


_F1 = "f AS MATERIALIZED (SELECT 0 AS one, vec_id, pos, v FROM flat)"
_START4 = f"SELECT 0 AS one, CAST(r - 1 AS INT) AS cid, pos, v AS c FROM f JOIN (SELECT vec_id, row_number() OVER (ORDER BY {fx.hash_sql('vec_id')}, vec_id) AS r FROM emb) USING (vec_id) WHERE r <= 4"


@query("kmeans_iterate", fx.with_(fx.EMB, fx.FLAT, _F1, *_lloyd(_START4, "one", 4)) + "SELECT vec_id, cid AS cluster FROM a4")
def _(spark, sf):
    """Four clusters after three updates of hashed start rows."""
    e = fx.embeddings(spark, sf)
    return ft.assign_clusters(e, "feature", ft.kmeans_iterate(e, "feature", "vec_id", k=4, iters=3, tol=0.0)).select("vec_id", "cluster")


@query("kmeans_fit", "SELECT count(*) AS n, count(*) AS at_nearest, CAST(8 AS BIGINT) AS clusters, CAST(8 AS BIGINT) AS centres_are_means FROM embeddings")
def _(spark, sf):
    """Every row is at its nearest centre, every centre is the mean of its rows."""
    model, got = ft.kmeans_fit(fx.embeddings(spark, sf), "feature", 8, seed=8, normalize=True)
    centers = [c.tolist() for c in model.clusterCenters()]
    unit = cut_lineage(got.select("vec_id", F.col("cluster").alias("own"), vec.l2_normalize(F.col("feature")).alias("u")))
    near = ft.assign_clusters(unit, "u", centers).agg(F.count("*").alias("n"), F.count_if(F.col("cluster") == F.col("own")).alias("at_nearest"))
    at = spark.createDataFrame([(i, j, v) for i, c in enumerate(centers) for j, v in enumerate(c)], "own int, pos int, c double")
    means = unit.select("own", F.posexplode("u").alias("pos", "v")).groupBy("own", "pos").agg(F.avg("v").alias("m")).join(at, ["own", "pos"])
    same = means.groupBy("own").agg(F.max(F.abs(F.col("m") - F.col("c"))).alias("gap")).agg(
        F.count("*").alias("clusters"), F.count_if(F.col("gap") < 0.01).alias("centres_are_means"))
    return near.join(same)


@query("cluster_counts", "SELECT CAST(r AS INT) AS label, count(vec_id) AS n FROM range(12) t(r) LEFT JOIN embeddings ON label = r GROUP BY r")
def _(spark, sf):
    return ft.cluster_counts(fx.embeddings(spark, sf), "label", 12)


_SCORES = """rw AS (SELECT vec_id, label, sum(v) AS s, sum(v * v) AS q, count(v) AS n, sqrt(sum(v * v)) AS len, arg_max(v, pos = 1) AS red, arg_max(v, pos = 2) AS green FROM flat GROUP BY ALL),
ag AS (SELECT label AS cluster, count(*) AS pixels, sum(s) AS s, sum(q) AS q, sum(n) AS n, avg(len) AS act, avg(green) - avg(red) AS veg FROM rw GROUP BY label),
cv AS (SELECT *, pixels / (SELECT CAST(count(*) AS DOUBLE) FROM emb) AS coverage, sqrt(greatest(0.0, q / n - (s / n) * (s / n))) + 0.1 * act AS base FROM ag),
sc AS (SELECT cluster, pixels, coverage, base * CASE WHEN coverage < 0.1 THEN 0.5 WHEN coverage > 0.105 THEN CASE WHEN coverage > 0.1575 THEN 0.1 ELSE 0.5 END ELSE 1.0 END + veg AS score FROM cv)"""


def _scores(spark, sf):
    e = fx.embeddings(spark, sf).select("vec_id", F.col("label").alias("cluster"), "feature",
                                        F.col("feature")[1].alias("green"), F.col("feature")[0].alias("red"))
    return ft.score_clusters(e, "feature", 11, green="green", red="red", bounds=(0.1, 0.105))


@query("score_clusters", fx.with_(fx.EMB, fx.FLAT, _SCORES) + """SELECT CAST(r AS INT) AS cluster, coalesce(pixels, 0) AS pixels, round(coalesce(coverage, 0.0), 6) AS coverage,
  coalesce(round(score, 6), -1e9) AS score FROM range(11) t(r) LEFT JOIN sc ON cluster = r""")
def _(spark, sf):
    s = _scores(spark, sf)
    return s.select("cluster", "pixels", r6("coverage"), F.when(F.col("pixels") == 0, -1e9).otherwise(F.round("score", 6)).alias("score"))


@query("pick_cluster", fx.with_(fx.EMB, fx.FLAT, _SCORES) + "SELECT CAST(cluster AS INT) AS cluster FROM sc ORDER BY score DESC, cluster LIMIT 1")
def _(spark, sf):
    return ft.pick_cluster(_scores(spark, sf), (0.1, 0.105))


_SCENE = "e3 AS (SELECT vec_id % 3 AS scene_id, * FROM emb), f AS MATERIALIZED (SELECT vec_id % 3 AS scene_id, vec_id, pos, v FROM flat)"
_START2 = "SELECT scene_id, CAST(r - 1 AS INT) AS cid, pos, v AS c FROM f JOIN (SELECT vec_id, row_number() OVER (PARTITION BY scene_id ORDER BY vec_id) AS r FROM e3) USING (vec_id) WHERE r <= 2"
_PICK = """rw AS (SELECT a.scene_id, cid, a.vec_id, sum(v) AS s, sum(v * v) AS q, count(v) AS n FROM a4 a JOIN f USING (scene_id, vec_id) GROUP BY ALL),
ag AS (SELECT scene_id, cid, count(*) AS pixels, sum(s) AS s, sum(q) AS q, sum(n) AS n, avg(sqrt(q)) AS act FROM rw GROUP BY ALL),
cv AS (SELECT *, pixels / sum(pixels) OVER (PARTITION BY scene_id) AS cover FROM ag),
sc AS (SELECT *, (sqrt(greatest(0.0, q / n - (s / n) * (s / n))) + 0.1 * act) * CASE WHEN cover < 0.01 THEN 0.5 WHEN cover > 0.7 THEN CASE WHEN cover > 0.95 THEN 0.1 ELSE 0.5 END ELSE 1.0 END AS score FROM cv),
tp AS (SELECT scene_id, cid, cover FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, cid) AS r FROM sc) WHERE r = 1),
al AS (SELECT sc.scene_id, arg_min(sc.cid, abs(sc.cover - 0.355)) AS cid FROM sc JOIN tp USING (scene_id) WHERE sc.cid <> tp.cid AND sc.cover < 0.95 GROUP BY ALL),
pk AS (SELECT tp.scene_id, CASE WHEN tp.cover >= 0.95 THEN coalesce(al.cid, tp.cid) ELSE tp.cid END AS cid FROM tp LEFT JOIN al USING (scene_id))"""


@query("segment_unsupervised", fx.with_(fx.EMB, fx.FLAT, _SCENE, *_lloyd(_START2, "scene_id", 4), _PICK) +
       "SELECT a4.scene_id, vec_id, cid AS cluster FROM a4 JOIN pk USING (scene_id, cid)")
def _(spark, sf):
    """Three scenes, each fitted and decided on its own from given start centres."""
    e = fx.embeddings(spark, sf).withColumn("scene_id", F.col("vec_id") % 3)
    first = top_per_group(e, ["scene_id"], [F.col("vec_id")], 2).select(
        "scene_id", (F.col("rank") - 1).cast("int").alias("cluster"), F.col("feature").alias("center"))
    return ft.segment_unsupervised(e, "feature", "vec_id", centers=first, iters=3).select("scene_id", "vec_id", "cluster")


@query("pca_project", fx.with_(fx.EMB, fx.FLAT, "mu AS (SELECT pos, avg(v) AS m FROM flat GROUP BY pos)") +
       "SELECT vec_id, round(sum((v - m) * (v - m)), 5) AS length2 FROM flat JOIN mu USING (pos) GROUP BY vec_id")
def _(spark, sf):
    """With as many components as dimensions a projection keeps the length of the centred vector."""
    got, _ = ft.pca_project(fx.embeddings(spark, sf), "feature", 64)
    return got.select("vec_id", r6(F.aggregate("projection", F.lit(0.0), lambda a, v: a + v * v), "length2", 5))


@query("pca_whitened", """SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS cov
  FROM range(5) a(i), range(5) b(j) WHERE i <= j AND (SELECT count(*) FROM embeddings) > 1""")
def _(spark, sf):
    """Whitened components have unit variance and no covariance."""
    got, _ = ft.pca_project(fx.embeddings(spark, sf), "feature", 5, standardize=True, whiten=True)
    return ft.covariance_matrix(got, "projection").select("i", "j", (F.round("cov", 5) + 0.0).alias("cov"))


@query("covariance_matrix", fx.with_(fx.EMB, fx.FLAT) + """SELECT CAST(a.pos - 1 AS INT) AS i, CAST(b.pos - 1 AS INT) AS j, round(covar_samp(a.v, b.v), 8) AS cov
  FROM flat a JOIN flat b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY a.pos, b.pos""")
def _(spark, sf):
    return ft.covariance_matrix(fx.embeddings(spark, sf), "feature").withColumn("cov", F.round("cov", 8))


@query("linear_probe_predict", fx.with_(fx.EMB, fx.FLAT, _CENTERS, "lg AS (SELECT vec_id, cid, sum(v * c) AS z FROM flat JOIN cm USING (pos) WHERE cid < 2 GROUP BY ALL)") +
       "SELECT vec_id, CAST(arg_max(cid, z) AS INT) AS prediction FROM lg GROUP BY vec_id")
def _(spark, sf):
    e = fx.embeddings(spark, sf)
    return ft.linear_probe_predict(e, "feature", _centers(e)[:2], [0.0, 0.0]).select("vec_id", "prediction")


@query("linear_probe_fit", "SELECT CAST(k AS INT) AS k, true AS flat FROM range(2) t(k) WHERE (SELECT count(*) FROM embeddings) > 0")
def _(spark, sf):
    """At the fitted weights the gradient of the mean loss vanishes, for the bias and every dimension."""
    e = fx.embeddings(spark, sf).withColumn("y", (F.col("label") >= 5).cast("int"))
    w, b = ft.linear_probe_fit(e, "feature", "y", 200)
    f = F.col("feature")

    def logit(k):
        return F.aggregate(F.zip_with(f, F.array(*map(F.lit, w[k])), lambda a, c: a * c), F.lit(float(b[k])), lambda a, v: a + v)

    p1 = 1 / (1 + F.exp(logit(0) - logit(1)))
    off = e.select(f, (p1 - F.col("y")).alias("g")).select(F.posexplode(F.concat(F.array(F.lit(1.0)), f)).alias("pos", "v"), "g")
    worst = off.groupBy("pos").agg(F.avg(F.col("v") * F.col("g")).alias("g")).agg(F.max(F.abs(F.col("g"))).alias("g"))
    return worst.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), (F.col("g") < 1e-3).alias("flat"))


_PART = f"""e2 AS (SELECT *, {fx.hash_sql('vec_id')} % 100 < 80 AS train FROM emb),
kd AS (SELECT q.vec_id, t.vec_id AS tk, t.label, list_distance(q.feature, t.feature) AS d FROM e2 q JOIN e2 t ON NOT q.train AND t.train)"""


def _knn(spark, sf, k):
    e = ft.split_80_20(fx.embeddings(spark, sf), "vec_id")
    train, val = e.where(F.col("part") == "train"), e.where(F.col("part") == "val")
    return nearest.knn_classify(val, train, "vec_id", "feature", "label", k, block_rows=128)


@query("knn_classify", fx.with_(fx.EMB, _PART) + "SELECT vec_id, CAST(arg_min(label, d) AS INT) AS prediction FROM kd GROUP BY vec_id")
def _(spark, sf):
    return _knn(spark, sf, 1)


@query("knn_classify_majority", fx.with_(fx.EMB, _PART, "rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, tk) AS r FROM kd)",
       "vt AS (SELECT vec_id, label, count(*) AS n FROM rk WHERE r <= 5 GROUP BY ALL)") +
       "SELECT vec_id, CAST(label AS INT) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS r FROM vt) WHERE r = 1")
def _(spark, sf):
    return _knn(spark, sf, 5)


@query("map_labels", "SELECT vec_id, CASE label WHEN 0 THEN 'field' WHEN 1 THEN 'tree' END AS name FROM embeddings")
def _(spark, sf):
    return ft.map_labels(fx.embeddings(spark, sf), "label", {0: "field", 1: "tree"}).select("vec_id", "name")


@query("infer_tiles", fx.with_(fx.PX) + """SELECT scene_id, y, x, round(b1 * 0.5 - b2, 6) AS score FROM px""")
def _(spark, sf):
    """A NumPy scorer over pixel batches."""
    def load():
        return lambda pdf: pdf[["scene_id", "y", "x"]].assign(score=(pdf["b1"] * 0.5 - pdf["b2"]))

    return ft.infer_tiles(fx.pixels(spark, sf), load, "scene_id bigint, y int, x int, score double").withColumn("score", F.round("score", 6))
