"""Queries on points: filters, distance joins, clustering, images, regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctaria.functions import scalar
from punctaria.operators import clustering, evaluate, features, filters, image, phase, spatial, stats
from punctaria.sources.points import name_parts, with_pid

from .catalog import query
from .views import LABELLED, POINTS, labelled, points, table

R = F.round
EPS, MIN_SAMPLES = 4.0, 20
W = f"WITH {POINTS} "
PAIRS = f"{POINTS}, cells AS (SELECT pid, x, y, floor(x / 4e0) AS cx, floor(y / 4e0) AS cy FROM points), pairs AS (SELECT p.pid AS p, q.pid AS q, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS d2 FROM (SELECT pid, x, y, cx + a.o AS cx, cy + b.o AS cy FROM cells, (VALUES (-1), (0), (1)) a(o), (VALUES (-1), (0), (1)) b(o)) p JOIN cells q ON p.cx = q.cx AND p.cy = q.cy WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 16e0)"
CORE = f"{PAIRS}, core AS (SELECT p AS pid FROM pairs GROUP BY p HAVING count(*) >= 20)"
REACH = f"{CORE}, edges AS (SELECT p, q FROM pairs WHERE p <> q AND p IN (SELECT pid FROM core) AND q IN (SELECT pid FROM core)), reach(pid, seen) AS (SELECT pid, pid FROM core UNION SELECT e.q, r.seen FROM reach r JOIN edges e ON e.p = r.pid AND r.seen < e.q), reps AS (SELECT pid, min(seen) AS rep FROM reach GROUP BY pid), numbers AS (SELECT pid, dense_rank() OVER (ORDER BY rep) - 1 AS label FROM reps), dbscan AS (SELECT p.pid, CAST(coalesce(n.label, (SELECT min(m.label) FROM pairs e JOIN numbers m ON m.pid = e.q WHERE e.p = p.pid), -1) AS INTEGER) AS label, n.label IS NOT NULL AS is_core FROM points p LEFT JOIN numbers n USING (pid))"


@query(W + "SELECT row_number() OVER (ORDER BY x, y) - 1 AS pid, x, y FROM (SELECT DISTINCT x, y FROM points)")
def points_distinct_numbered(spark, sf_dir):
    return with_pid(points(spark, sf_dir).select("x", "y")).select("pid", "x", "y")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_parameters(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("SELECT page_id, string_split_regex(url, '[/.:?#=&_-]+')[2] AS part2, CAST(nullif(regexp_extract(url, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) AS number FROM pages")
def name_to_columns(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", name_parts(F.col("url"), "[/.:?#=&_-]+")[1].alias("part2"), F.expr("try_cast(nullif(regexp_extract(url, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT)").alias("number"))


@query("SELECT doc_id, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS natural, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS padded FROM documents WHERE contains(source, 'src') ")
def natural_sort_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("source").contains("src"))
    return d.select("doc_id", F.regexp_extract("source", "([0-9]+)$", 1).cast("int").alias("natural"), scalar.padded_id(F.col("doc_id"), 9).alias("padded"))


@query(W + "SELECT pid, x, y FROM points WHERE x > 5 AND x < 60 AND y > 10 AND y < 300")
def filter_open_box(spark, sf_dir):
    return filters.open_box(points(spark, sf_dir), 5, 60, 10, 300).select("pid", "x", "y")


@query(W + "SELECT pid, x, y FROM points WHERE x >= 5 AND x < 60 AND y >= 9.6e0 AND y < 300")
def filter_half_open_tile(spark, sf_dir):
    return filters.half_open_box(points(spark, sf_dir), 5, 60, 9.6, 300).select("pid", "x", "y")


@query("SELECT event_id AS pid FROM events WHERE value > 1 AND value < 50 AND user_id > 3 AND user_id < 90 AND event_id > 100 AND event_id < 9000")
def filter_crop_three_columns(spark, sf_dir):
    return filters.crop(table(spark, sf_dir, "events"), [(1, 50), (3, 90), (100, 9000)], ["value", "user_id", "event_id"]).select(F.col("event_id").alias("pid"))


@query(W + ", b AS (SELECT (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM points) SELECT pid, round(x - (cx - 100), 6) AS x, round(y - (cy - 60), 6) AS y FROM points, b WHERE x BETWEEN cx - 100 AND cx + 100 AND y BETWEEN cy - 60 AND cy + 60")
def filter_centre_crop(spark, sf_dir):
    return filters.centre_crop(points(spark, sf_dir), 200, 120).select("pid", R("x", 6).alias("x"), R("y", 6).alias("y"))


@query(W + "SELECT DISTINCT x, y FROM points WHERE x > 1 AND x < 20 AND y > 1 AND y < 100")
def filter_window_distinct(spark, sf_dir):
    return filters.open_box(points(spark, sf_dir), 1, 20, 1, 100).select("x", "y").distinct()


@query(W + "SELECT pid, least(x, 50e0) AS x FROM points")
def clip_top_values(spark, sf_dir):
    return points(spark, sf_dir).select("pid", filters.clip_top("x", 50.0))


@query(W + "SELECT floor(min(x) / 25) * 25 AS x_min, ceil(max(x) / 25) * 25 AS x_max, floor(min(y) / 25) * 25 AS y_min, ceil(max(y) / 25) * 25 AS y_max FROM points")
def rounded_axes(spark, sf_dir):
    return filters.rounded_axes(points(spark, sf_dir), 25.0).select(*(F.col(c).cast("double").alias(c) for c in ("x_min", "x_max", "y_min", "y_max")))


@query(W + ", m AS (SELECT event_type, avg(x) AS mx, avg(y) AS my FROM points GROUP BY event_type) SELECT pid, round((x - mx) * 158, 6) AS x, round((y - my) * 158, 6) AS y FROM points JOIN m USING (event_type)")
def centre_and_scale(spark, sf_dir):
    return filters.centred(points(spark, sf_dir), "event_type", 158.0).select("pid", R("x", 6).alias("x"), R("y", 6).alias("y"))


@query(W + ", d AS (SELECT pid, sqrt((x - 30e0) * (x - 30e0) + (y - 100e0) * (y - 100e0)) AS d FROM points), r AS (SELECT max(d) AS r FROM (SELECT d FROM d ORDER BY d LIMIT 501)) SELECT pid, round(d, 6) AS d FROM d, r WHERE d < r")
def nearest_to_centre(spark, sf_dir):
    return filters.n_nearest(points(spark, sf_dir), 30.0, 100.0, 500).select("pid", R("d", 6).alias("d"))


@query(W + "SELECT min(pid) AS pid, x, y FROM points GROUP BY x, y")
def first_occurrences(spark, sf_dir):
    return filters.first_occurrence(points(spark, sf_dir)).select("pid", "x", "y")


@query(W + "SELECT pid, x FROM points ORDER BY pid LIMIT 200")
def first_rows(spark, sf_dir):
    return points(spark, sf_dir).orderBy("pid").limit(200).select("pid", "x")


@query(f"WITH {PAIRS} SELECT p AS pid, count(*) AS degree, round(max(d2), 6) AS farthest FROM pairs GROUP BY p")
def eps_neighbourhoods(spark, sf_dir):
    return spatial.eps_pairs(points(spark, sf_dir), EPS).groupBy(F.col("p").alias("pid")).agg(F.count("*").alias("degree"), R(F.max("d2"), 6).alias("farthest"))


@query(f"WITH {CORE} SELECT p.pid, CASE WHEN c.pid IS NULL THEN -1 ELSE 0 END AS label FROM points p LEFT JOIN core c USING (pid)")
def core_points(spark, sf_dir):
    p = points(spark, sf_dir)
    core = clustering.core_points(spatial.eps_pairs(p, EPS), MIN_SAMPLES).withColumn("c", F.lit(0))
    return p.select("pid").join(core, "pid", "left").select("pid", F.coalesce("c", F.lit(-1)).alias("label"))


@query(f"WITH RECURSIVE {REACH} SELECT pid, label, is_core FROM dbscan")
def dbscan_labels(spark, sf_dir):
    return clustering.dbscan(points(spark, sf_dir), EPS, MIN_SAMPLES)


@query(f"WITH RECURSIVE {REACH} SELECT label, count(*) AS \"clusterSize\" FROM dbscan WHERE label >= 0 GROUP BY label")
def dbscan_cluster_sizes(spark, sf_dir):
    return stats.cluster_sizes(clustering.dbscan(points(spark, sf_dir), EPS, MIN_SAMPLES))


@query(f"WITH RECURSIVE {REACH}, s AS (SELECT label, count(*) AS n FROM dbscan WHERE label >= 0 GROUP BY label) SELECT 20 AS threshold, count(*) AS n, round(avg(n), 6) AS mean, round(median(n), 6) AS median, round(quantile_cont(n, 0.9), 6) AS q90, round(quantile_cont(n, 0.1), 6) AS q10, round(stddev_pop(n) / avg(n), 6) AS cv, round(var_pop(n) / avg(n), 6) AS fano, round((avg(CAST(n AS DOUBLE) * n * n) - 3 * avg(n) * avg(CAST(n AS DOUBLE) * n) + 2 * avg(n) * avg(n) * avg(n)) / pow(var_pop(n), 1.5), 4) AS skewness, count(*) FILTER (n < 21) AS \"firstBin\" FROM s")
def dbscan_size_statistics(spark, sf_dir):
    sizes = stats.cluster_sizes(clustering.dbscan(points(spark, sf_dir), EPS, MIN_SAMPLES)).withColumn("threshold", F.lit(MIN_SAMPLES))
    s = stats.size_statistics(sizes)
    return s.select("threshold", "n", *(R(c, 6).alias(c) for c in ("mean", "median", "q90", "q10", "cv", "fano")), R("skewness", 4).alias("skewness"), "firstBin")


@query(f"WITH RECURSIVE {REACH}, s AS (SELECT label, count(*) AS n FROM dbscan GROUP BY label) SELECT round(coalesce(sum(n) FILTER (label < 0), 0) / sum(n), 6) AS noise_share, round(coalesce(sum(n) FILTER (label >= 0 AND n > 50), 0) / sum(n), 6) AS large_share FROM s")
def dbscan_noise_shares(spark, sf_dir):
    s = stats.noise_shares(clustering.dbscan(points(spark, sf_dir), EPS, MIN_SAMPLES), 50)
    return s.select(R("noise_share", 6).alias("noise_share"), R("large_share", 6).alias("large_share"))


@query(f"WITH RECURSIVE {REACH}".replace("HAVING count(*) >= 20", "HAVING sum(CAST(q % 3 AS DOUBLE) - 0.5e0) >= 8") + " SELECT pid, label, is_core FROM dbscan")
def dbscan_weighted(spark, sf_dir):
    p = points(spark, sf_dir)
    return clustering.dbscan(p, EPS, 8.0, weights=p.select("pid", ((F.col("pid") % 3) - 0.5).alias("weight")))


#: Points that are left after peeling: each round drops those with too few neighbours left; the rounds are more than any of the tables needs.
PEELED = f"{PAIRS}, peel(k, pid) AS (SELECT 0, pid FROM points UNION ALL SELECT l.k + 1, l.pid FROM peel l JOIN pairs ON pairs.p = l.pid JOIN peel m ON m.pid = pairs.q WHERE l.k < 40 GROUP BY l.k, l.pid HAVING count(*) >= 20), core AS (SELECT pid FROM peel WHERE k = 40)"
LOOP = REACH.replace(CORE, PEELED)


@query(f"WITH RECURSIVE {LOOP} SELECT p.pid, CAST(coalesce(n.label, -1) AS INTEGER) AS label FROM points p LEFT JOIN numbers n USING (pid)")
def dbscan_loop_labels(spark, sf_dir):
    return clustering.dbscan_loop(points(spark, sf_dir), EPS, MIN_SAMPLES)


TILED = f"""
WITH RECURSIVE {POINTS},
b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, greatest(1, floor(sqrt(count(*) / 2000e0))) AS n FROM points),
t AS (
  SELECT pid, x, y, floor(x / 4e0) AS cx, floor(y / 4e0) AS cy,
    CAST(greatest(0, least(n - 1, floor((x - x0) / ((x1 - x0) / n)))) * n + greatest(0, least(n - 1, floor((y - y0) / ((y1 - y0) / n)))) AS INTEGER) AS tile
  FROM points, b
),
near AS (
  SELECT p.tile, p.pid AS p, q.pid AS q
  FROM (SELECT tile, pid, x, y, cx + a.o AS cx, cy + c.o AS cy FROM t, (VALUES (-1), (0), (1)) a(o), (VALUES (-1), (0), (1)) c(o)) p
  JOIN t q USING (tile, cx, cy) WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 16
),
core AS (SELECT tile, p AS pid FROM near GROUP BY tile, p HAVING count(*) >= 10),
edge AS (SELECT p, q FROM near WHERE p <> q AND p IN (SELECT pid FROM core) AND q IN (SELECT pid FROM core)),
reach(pid, seen) AS (SELECT pid, pid FROM core UNION SELECT e.q, r.seen FROM reach r JOIN edge e ON e.p = r.pid AND r.seen < e.q),
num AS (SELECT tile, pid, dense_rank() OVER (PARTITION BY tile ORDER BY rep) - 1 AS label FROM (SELECT pid, min(seen) AS rep FROM reach GROUP BY pid) JOIN core USING (pid)),
rim AS (SELECT e.p AS pid, min(m.label) AS label FROM near e JOIN num m ON m.pid = e.q GROUP BY e.p)
SELECT t.tile, t.pid, CAST(coalesce(m.label, r.label, -1) AS INTEGER) AS label FROM t LEFT JOIN num m ON m.pid = t.pid LEFT JOIN rim r ON r.pid = t.pid
"""


@query(TILED)
def dbscan_tiled(spark, sf_dir):
    return clustering.tiled_dbscan(points(spark, sf_dir), 2000, EPS, 10)


@query(f"""
WITH RECURSIVE {PAIRS},
nn AS (SELECT p, q, d2, row_number() OVER (PARTITION BY p ORDER BY d2, q) AS rank FROM pairs WHERE p <> q),
core AS (SELECT p AS pid FROM nn WHERE rank = 5 AND d2 < 16e0),
bad(pid) AS (SELECT pid FROM points ANTI JOIN core USING (pid) UNION SELECT nn.p FROM bad JOIN nn ON nn.q = bad.pid AND rank <= 5 SEMI JOIN core ON core.pid = nn.p)
SELECT pid, pid IN (SELECT pid FROM core) AS is_core, pid NOT IN (SELECT pid FROM bad) AS closed FROM points
""")
def core_of_cores(spark, sf_dir):
    return clustering.core_of_cores(points(spark, sf_dir), EPS, 6)


@query()
def sampled_tile_sizes(spark, sf_dir):
    tiles = clustering.tiled_dbscan(points(spark, sf_dir), 500, EPS, 10)
    return clustering.sampled_sizes(tiles)


@query()
def optics_tiles(spark, sf_dir):
    return clustering.optics(clustering.tile_of(points(spark, sf_dir), 800), 10, 8.0, by="tile")


@query()
def cluster_club(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("score", 1 / (1 + F.col("x"))).withColumn("label", (F.col("x") < 30).cast("int"))
    return clustering.club_within(p.select("pid", "score", "label", "x", "y"), 20, EPS)


@query(f"WITH RECURSIVE {REACH}, own AS (SELECT label FROM dbscan WHERE label >= 0 AND pid = (SELECT min(pid) FROM core)) SELECT pid FROM dbscan WHERE label = (SELECT label FROM own)")
def cluster_of_one_point(spark, sf_dir):
    return clustering.cluster_of(points(spark, sf_dir), EPS, MIN_SAMPLES)  # that of the smallest core point


@query(f"WITH RECURSIVE {REACH}, s AS (SELECT label, count(*) AS n FROM dbscan GROUP BY label) SELECT pid, CASE WHEN n > 40 THEN label ELSE -1 END AS label FROM dbscan JOIN s USING (label)")
def small_clusters_to_noise(spark, sf_dir):
    return filters.noise_below_population(clustering.dbscan(points(spark, sf_dir), EPS, MIN_SAMPLES).select("pid", "label"), 40)


@query(f"WITH RECURSIVE {REACH}, s AS (SELECT label, count(*) AS n FROM dbscan WHERE label >= 0 GROUP BY label) SELECT pid, CASE WHEN n < 45 THEN -1 ELSE label END AS label FROM dbscan LEFT JOIN s USING (label)")
def remove_labels_below_limit(spark, sf_dir):
    a = clustering.dbscan(points(spark, sf_dir), EPS, MIN_SAMPLES).select("pid", "label")
    return filters.remove_small_labels(a, stats.cluster_sizes(a), "clusterSize", 45)


@query(f"WITH RECURSIVE {REACH} SELECT pid, CASE WHEN label IN (0, 2, 5) THEN label ELSE -1 END AS label FROM dbscan")
def keep_listed_labels(spark, sf_dir):
    return filters.keep_labels(clustering.dbscan(points(spark, sf_dir), EPS, MIN_SAMPLES).select("pid", "label"), [0, 2, 5])


SMALL = "s AS (SELECT pid, x, y FROM points WHERE pid < 2000)"


@query(f"WITH {POINTS}, r AS (SELECT p.pid, q.pid AS nn_pid, row_number() OVER (PARTITION BY p.pid ORDER BY (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y), q.pid) AS rank, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS dist FROM points p JOIN points q ON p.pid <> q.pid AND p.pid % 50 = 0) SELECT pid, rank, nn_pid, round(dist, 6) AS dist FROM r WHERE rank <= 5")
def knn_points(spark, sf_dir):
    p = points(spark, sf_dir)
    near = spatial.knn(p.filter("pid % 50 = 0"), 5, targets=p)  # a stated query set against all points
    return near.select("pid", F.col("rank").cast("long").alias("rank"), "nn_pid", R("dist", 6).alias("dist"))


@query(f"WITH {POINTS}, r AS (SELECT p.pid, row_number() OVER (PARTITION BY p.pid ORDER BY (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y), q.pid) AS rank, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS dist FROM points p JOIN points q ON p.pid <> q.pid) SELECT round(quantile_cont(dist, 0.1), 6) AS low, round(quantile_cont(dist, 0.9), 6) AS high FROM r WHERE rank = 10")
def sigma_bounds(spark, sf_dir):
    near = spatial.knn(points(spark, sf_dir), 10)
    d = spatial.kth_distance(near, 10)
    return d.agg(R(F.percentile("dist", F.lit(0.1)), 6).alias("low"), R(F.percentile("dist", F.lit(0.9)), 6).alias("high"))


@query(f"WITH {POINTS} SELECT p.pid FROM points p WHERE p.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM points q WHERE q.event_type = 'error' AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 9.61e0)")
def far_from_other_set(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.far_from(p.filter("event_type = 'click'"), p.filter("event_type = 'error'"), 3.1).select("pid")


VEC = "q AS (SELECT vec_id AS pid, embedding AS v FROM embeddings), p AS (SELECT pid, v FROM q WHERE pid % 50 = 0), r AS (SELECT p.pid, q.pid AS nn_pid, list_distance(CAST(p.v AS DOUBLE[]), CAST(q.v AS DOUBLE[])) AS dist FROM p JOIN q ON p.pid <> q.pid), k AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY dist, nn_pid) AS rank FROM r)"


@query(f"WITH {VEC} SELECT pid, rank, nn_pid, round(dist, 4) AS dist FROM k WHERE rank <= 8")
def knn_vectors(spark, sf_dir):
    return _vector_neighbours(spark, sf_dir).select("pid", F.col("rank").cast("long").alias("rank"), "nn_pid", R("dist", 4).alias("dist"))


def _vector_neighbours(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("embedding").cast("array<double>").alias("v"))
    return spatial.knn_vectors(v, 8, v.filter("pid % 50 = 0"))


@query(f"WITH {VEC}, c AS (SELECT k.pid, k.rank, b.label = a.label AS same FROM k JOIN embeddings a ON a.vec_id = k.pid JOIN embeddings b ON b.vec_id = k.nn_pid WHERE rank <= 8) SELECT pid, CAST(least(coalesce(min(rank) FILTER (NOT same) - 1, 8), 7) AS INTEGER) AS run_len_capped FROM c GROUP BY pid")
def neighbour_run_length(spark, sf_dir):
    classes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("label").alias("class"))
    return features.leading_class(_vector_neighbours(spark, sf_dir), classes)


@query(f"WITH {VEC}, a AS (SELECT pid, list(dist ORDER BY rank) AS d FROM k WHERE rank <= 8 GROUP BY pid) SELECT pid, CAST(i AS INTEGER) AS i, round(d[i + 1] / sqrt(list_sum(list_transform(d, lambda x: x * x))), 5) AS unit, round((d[i + 1] - list_min(d)) / nullif(list_max(d) - list_min(d), 0), 4) AS own, round(CASE WHEN i < 7 THEN d[i + 2] - d[i + 1] END, 4) AS diff FROM a, range(8) r(i)")
def distance_normalisations(spark, sf_dir):
    a = features.distance_arrays(_vector_neighbours(spark, sf_dir))
    for name, kind in (("u", "Norm-Distances-Only"), ("s", "Norm-Self"), ("f", "Raw-Differences")):
        a = features.normalise(a, kind).withColumnRenamed("f", f"__{name}")
    i = F.col("i")
    return a.select("pid", F.posexplode("__u").alias("i", "unit"), "__s", "__f").select("pid", "i", R("unit", 5).alias("unit"), R(F.try_element_at("__s", i + 1), 4).alias("own"), R(F.try_element_at("__f", i + 1), 4).alias("diff"))


@query(f"WITH {VEC}, a AS (SELECT pid, list(dist ORDER BY rank) AS d FROM k WHERE rank <= 8 GROUP BY pid), e AS (SELECT pid, i, d[i + 2] - d[i + 1] AS x FROM a, range(7) r(i)), t AS (SELECT i, max(x) AS top FROM e GROUP BY i) SELECT pid, CAST(i AS INTEGER) AS i, round(x / nullif(top, 0), 4) AS f FROM e JOIN t USING (i)")
def normalised_by_largest_difference(spark, sf_dir):
    a = features.normalise(features.distance_arrays(_vector_neighbours(spark, sf_dir)), "Norm-MaxDiff")
    return a.select("pid", F.posexplode("f").alias("i", "f")).select("pid", "i", R("f", 4).alias("f"))


RING = [(5.0, 20.0), (60.0, 10.0), (90.0, 200.0), (40.0, 120.0), (10.0, 280.0), (5.0, 20.0)]
INSIDE = " + ".join(f"CASE WHEN (({y1}e0 > y) <> ({y2}e0 > y)) AND x < {x1}e0 + (y - {y1}e0) * ({x2 - x1}e0 / {y2 - y1}e0) THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(RING, RING[1:]))


@query(W + f"SELECT pid FROM points WHERE ({INSIDE}) % 2 = 1")
def points_in_polygon(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.filter(spatial.in_ring(F.col("x"), F.col("y"), RING)).select("pid")


ROI_RINGS = [("a", RING), ("b", [(0.0, 0.0), (40.0, 0.0), (40.0, 150.0), (0.0, 150.0), (0.0, 0.0)]), ("c", [(500.0, 5.0), (600.0, 5.0), (600.0, 9.0), (500.0, 5.0)])]


def _rois(spark):
    rows = ROI_RINGS
    return spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in ring]) for k, ring in rows], "roi string, ring array<struct<x double, y double>>")


ROI_AREA_A = abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(RING, RING[1:]))) / 2


@query(f"WITH {LABELLED}, m AS (SELECT 'a' AS roi, pid FROM labelled WHERE ({INSIDE}) % 2 = 1 UNION ALL SELECT 'b', pid FROM labelled WHERE x < 40 AND y < 150), z AS (SELECT * FROM (VALUES ('a', {ROI_AREA_A}e0), ('b', 6000e0), ('c', 200e0)) v(roi, area)), c AS (SELECT roi, count(*) AS points, count(*) FILTER (label >= 0) AS clustered FROM m JOIN labelled USING (pid) GROUP BY roi), s AS (SELECT roi, count(*) AS clusters, median(n) AS median_points FROM (SELECT roi, label, count(*) AS n FROM m JOIN labelled USING (pid) WHERE label >= 0 GROUP BY roi, label) GROUP BY roi) SELECT roi, round(area, 6) AS area, coalesce(points, 0) AS points, coalesce(clustered, 0) AS clustered, round(clustered / points, 6) AS clustered_share, coalesce(clusters, 0) AS clusters, round(coalesce(points, 0) / area, 6) AS points_per_area, round(median_points, 6) AS median_points FROM z LEFT JOIN c USING (roi) LEFT JOIN s USING (roi)")
def roi_statistics(spark, sf_dir):
    p, rois = labelled(spark, sf_dir), _rois(spark)
    areas = rois.select("roi", spatial.ring_area(F.col("ring")).alias("area"))
    s = stats.roi_statistics(p, spatial.points_in_rings(p, rois), areas)
    return s.select("roi", R("area", 6).alias("area"), "points", "clustered", R("clustered_share", 6).alias("clustered_share"), "clusters", R("points_per_area", 6).alias("points_per_area"), R("median_points", 6).alias("median_points"))


def _boxes(p, name, margin=0.0):
    """The box around the points of each label as a closed ring."""
    b = p.filter(F.col(name) >= 0).groupBy(F.col(name).cast("string").alias("roi"))
    b = b.agg((F.min("x") - margin).alias("x0"), (F.max("x") + margin).alias("x1"), (F.min("y") - margin).alias("y0"), (F.max("y") + margin).alias("y1"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return b.withColumn("ring", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0")))


BOX = "(SELECT CAST({0} AS VARCHAR) AS roi, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM labelled WHERE {0} >= 0 GROUP BY 1)"


@query(
    f"WITH {LABELLED} SELECT a.roi, b.roi AS \"outer\" FROM {BOX.format('label')} a JOIN {BOX.format('truth')} b "
    "ON a.x0 > b.x0 - 0.503e0 AND a.x1 < b.x1 + 0.503e0 AND a.y0 > b.y0 - 0.503e0 AND a.y1 < b.y1 + 0.503e0"
)
def polygons_within_polygon(spark, sf_dir):
    p = labelled(spark, sf_dir)
    return spatial.rings_within(_boxes(p, "label").select("roi", "ring"), _boxes(p, "truth", 0.503).select("roi", "ring"))


@query(f"WITH {LABELLED} SELECT roi, round((x0 + 2 * x1) / 3, 6) AS cx, round((2 * y0 + y1) / 3, 6) AS cy FROM {BOX.format('label')} WHERE x1 > x0 AND y1 > y0")
def ring_centroids(spark, sf_dir):
    half = F.array(*(F.get("ring", i) for i in (0, 1, 2, 0)))  # the lower right half of each box, so that the middle is not the answer
    c = _boxes(labelled(spark, sf_dir), "label").filter("x1 > x0 and y1 > y0").select("roi", spatial.ring_centroid(half).alias("c"))
    return c.select("roi", R("c.x", 6).alias("cx"), R("c.y", 6).alias("cy"))


BIN = "CAST(least(floor((x - 0e0) / (200e0 / 50)), 49) AS INTEGER) AS ix, CAST(least(floor((y - 0e0) / (480e0 / 60)), 59) AS INTEGER) AS iy"
IMG = f"{POINTS}, img AS (SELECT {BIN}, CAST(count(*) AS DOUBLE) AS v FROM points WHERE x BETWEEN 0 AND 200 AND y BETWEEN 0 AND 480 GROUP BY 1, 2)"
BOUNDS = (0.0, 200.0, 0.0, 480.0)


def _image(spark, sf_dir):
    return image.histogram2d(points(spark, sf_dir), BOUNDS, 50, 60)


@query(f"WITH {IMG} SELECT ix, iy, v FROM img")
def histogram_2d(spark, sf_dir):
    return _image(spark, sf_dir)


@query(f"WITH {LABELLED} SELECT {BIN}, count(*) AS n_all, count(*) FILTER (label >= 0) AS n_clustered FROM labelled WHERE x BETWEEN 0 AND 200 AND y BETWEEN 0 AND 480 GROUP BY 1, 2".replace("480e0 / 60", "480e0 / 50").replace(", 59)", ", 49)"))
def histogram_2d_clustered(spark, sf_dir):
    return image.histogram2d_by_label(labelled(spark, sf_dir), BOUNDS, 50)


@query(f"WITH {IMG}, c AS (SELECT quantile_cont(v, 0.8) AS cut FROM img) SELECT ix, iy, round(least(v, cut), 6) AS v FROM img, c")
def clip_at_quantile(spark, sf_dir):
    return image.clip_at_quantile(_image(spark, sf_dir), 0.8).select("ix", "iy", R("v", 6).alias("v"))


@query(f"WITH {IMG}, m AS (SELECT ix, iy FROM img WHERE v >= 6), n AS (SELECT ix + a AS ix, iy + b AS iy, a = 0 AND b = 0 AS own FROM m, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) s(a, b)) SELECT DISTINCT ix, iy FROM n WHERE own OR (ix > 0 AND ix < 49 AND iy > 0 AND iy < 59)")
def dilate_mask(spark, sf_dir):
    return image.dilate(_image(spark, sf_dir).filter("v >= 6"), 50, 60, 1)


@query(f"WITH RECURSIVE {IMG}, m AS (SELECT ix, iy, CAST(ix AS BIGINT) * 100000 + iy AS k FROM img WHERE v >= 6), e AS (SELECT a.k AS p, b.k AS q FROM m a JOIN m b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND a.k <> b.k), reach(k, seen) AS (SELECT k, k FROM m UNION SELECT e.q, r.seen FROM reach r JOIN e ON e.p = r.k AND r.seen < e.q), reps AS (SELECT k, min(seen) AS rep FROM reach GROUP BY k) SELECT ix, iy, CAST(dense_rank() OVER (ORDER BY rep) AS INTEGER) AS label FROM m JOIN reps USING (k)")
def image_components(spark, sf_dir):
    return image.components(_image(spark, sf_dir).filter("v >= 6"))


@query(f"WITH {IMG} SELECT round(count(*) FILTER (v > 0) / (3000 - count(*) FILTER (v > 0)), 6) AS ratio FROM img")
def occupied_pixel_ratio(spark, sf_dir):
    return image.occupancy(_image(spark, sf_dir), 3000).select(R("ratio", 6).alias("ratio"))


@query(f"WITH {IMG}, t AS (SELECT max(v) AS m FROM img) SELECT ix, iy, CAST(trunc(v * 255 / m) AS INTEGER) AS v FROM img, t")
def image_8bit(spark, sf_dir):
    return image.to_8bit(_image(spark, sf_dir))


@query()
def gaussian_otsu_mask(spark, sf_dir):
    blurred = image.gaussian(_image(spark, sf_dir), 50, 60, 1.5)
    return blurred.filter(F.col("v") > image.otsu_threshold(blurred)).select("ix", "iy", R("v", 6).alias("v"))


@query()
def segment_cell(spark, sf_dir):
    inside, outside = image.segment(points(spark, sf_dir), nx=80, quantile=0.9, sigma=2, pad=2)
    return inside.select("pid", F.lit("in").alias("side")).unionByName(outside.select("pid", F.lit("out").alias("side")))


@query(f"WITH {LABELLED}, c AS (SELECT label, count(*) AS n FROM labelled GROUP BY label ORDER BY n DESC, label LIMIT 1) SELECT pid FROM labelled JOIN c USING (label)")
def most_frequent_label(spark, sf_dir):
    a = labelled(spark, sf_dir).select(F.col("pid").alias("ix"), F.lit(0).alias("iy"), "label")
    return image.largest_component(a).select(F.col("ix").alias("pid"))


@query(W + "SELECT pid, CAST(greatest(0, least(99, CAST(round_even(x / 2e0, 0) AS INTEGER))) AS INTEGER) AS ix FROM points")
def point_to_pixel(spark, sf_dir):
    return points(spark, sf_dir).select("pid", spatial.grid_index(F.col("x"), 0.0, 2.0, 100).alias("ix"))


@query(W + "SELECT round(count(*) / ((max(x) - min(x)) * (max(y) - min(y))), 8) AS density FROM points")
def box_density(spark, sf_dir):
    return stats.density(points(spark, sf_dir)).select(R("density", 8).alias("density"))


# Evaluation of labels.


@query(f"WITH {LABELLED}, g AS (SELECT label, truth, count(*) AS n FROM labelled WHERE label >= 0 AND truth >= 0 GROUP BY 1, 2), a AS (SELECT label, count(*) AS n_label FROM labelled WHERE label >= 0 GROUP BY 1), b AS (SELECT truth, count(*) AS n_truth FROM labelled WHERE truth >= 0 GROUP BY 1) SELECT label, truth, n, n_label, n_truth FROM g JOIN a USING (label) JOIN b USING (truth)")
def label_overlaps(spark, sf_dir):
    return evaluate.overlap(labelled(spark, sf_dir)).select("label", "truth", "n", "n_label", "n_truth")


RATIOS = [k / 19 for k in range(20)]


def _matched(ratios: list[float]) -> str:
    """SQL of greedy matching at each of some least overlaps, as the table ``match``."""
    return f"""
WITH RECURSIVE {LABELLED},
pair AS (
  SELECT g.label, g.truth, n, n_label, n_truth FROM (SELECT label, truth, count(*) AS n FROM labelled WHERE label >= 0 AND truth >= 0 GROUP BY 1, 2) g
  JOIN (SELECT label, count(*) AS n_label FROM labelled WHERE label >= 0 GROUP BY 1) a USING (label) JOIN (SELECT truth, count(*) AS n_truth FROM labelled WHERE truth >= 0 GROUP BY 1) b USING (truth)
),
ratios(ratio) AS (VALUES {", ".join(f"({r!r}e0)" for r in ratios)}),
able AS (SELECT ratio, pair.* FROM ratios JOIN pair ON n > ratio * n_truth),
turn AS (SELECT ratio, label, dense_rank() OVER (PARTITION BY ratio ORDER BY label) AS k FROM (SELECT DISTINCT ratio, label FROM able)),
match(ratio, k, label, truth, taken) AS (
  SELECT ratio, CAST(0 AS BIGINT), CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST([] AS INTEGER[]) FROM ratios
  UNION ALL
  SELECT ratio, k, label, truth, CASE WHEN truth IS NULL THEN taken ELSE list_append(taken, truth) END FROM (
    SELECT m.ratio, t.k, t.label, any_value(m.taken) AS taken, first(a.truth ORDER BY a.n / a.n_label DESC, a.truth) FILTER (NOT list_contains(m.taken, a.truth)) AS truth
    FROM match m JOIN turn t ON t.ratio = m.ratio AND t.k = m.k + 1 JOIN able a ON a.ratio = t.ratio AND a.label = t.label GROUP BY m.ratio, t.k, t.label
  )
)"""


@query(f"{_matched([0.3])} SELECT label, truth FROM match WHERE truth IS NOT NULL")
def greedy_cluster_matching(spark, sf_dir):
    return evaluate.greedy_match(labelled(spark, sf_dir))


COUNTED = "(SELECT count(DISTINCT label) FROM labelled WHERE label >= 0) AS k, (SELECT count(DISTINCT truth) FROM labelled WHERE truth >= 0) AS g"


@query(f"{_matched([0.3])}, c AS (SELECT count(truth) AS tp, {COUNTED} FROM match) SELECT tp AS true_positives, k - tp AS false_positives, g - tp AS false_negatives, g AS n_groundtruth FROM c")
def cluster_level_scores(spark, sf_dir):
    return evaluate.cluster_evaluation(labelled(spark, sf_dir)).select("true_positives", "false_positives", "false_negatives", "n_groundtruth")


@query(f"{_matched(RATIOS)}, c AS (SELECT ratio, count(truth) AS tp, {COUNTED} FROM match GROUP BY ratio) SELECT round(ratio, 6) AS ratio, round(tp / g, 6) AS true_positives_ratio, round((k - tp) / g, 6) AS false_positives_ratio FROM c")
def overlap_threshold_sweep(spark, sf_dir):
    return evaluate.overlap_sweep(labelled(spark, sf_dir), RATIOS).select(*(R(c, 6).alias(c) for c in ("ratio", "true_positives_ratio", "false_positives_ratio")))


@query(f"WITH {LABELLED} SELECT count(*) FILTER (label >= 0 AND truth >= 0) AS true_positives, count(*) FILTER (label >= 0 AND truth < 0) AS false_positives, count(*) FILTER (label < 0 AND truth >= 0) AS false_negatives FROM labelled")
def point_level_scores(spark, sf_dir):
    return evaluate.point_evaluation(labelled(spark, sf_dir))


@query(f"WITH {LABELLED} SELECT truth, count(DISTINCT label) FILTER (label >= 0) AS subclusters FROM labelled WHERE truth >= 0 GROUP BY truth")
def subclusters_per_reference(spark, sf_dir):
    return evaluate.subclusters(labelled(spark, sf_dir))


@query(f"WITH {LABELLED}, s AS (SELECT truth, count(DISTINCT label) FILTER (label >= 0) AS k FROM labelled WHERE truth >= 0 GROUP BY truth) SELECT least(k, 10) AS subclusters, count(*) AS n FROM s GROUP BY 1")
def subcluster_histogram(spark, sf_dir):
    return evaluate.subcluster_histogram(evaluate.subclusters(labelled(spark, sf_dir))).select(F.col("subclusters").cast("long").alias("subclusters"), "n")


# Parameter grids.

CELLS = [(i * 2 + j, s, t) for i, s in enumerate((2.0, 3.0, 4.0)) for j, t in enumerate((15, 25))]


@query()
def parameter_selection(spark, sf_dir):
    return phase.ParameterSearch().fit(points(spark, sf_dir)).selected.select("idx", R("sigma", 6).alias("sigma"), "threshold", "similarityScore")


@query(f"WITH {LABELLED} SELECT pid, label, 'incell' AS type FROM labelled WHERE y < 240 UNION ALL SELECT pid, label, 'outcell' FROM labelled WHERE y >= 240")
def tagged_union(spark, sf_dir):
    p = labelled(spark, sf_dir)
    return p.filter("y < 240").select("pid", "label", F.lit("incell").alias("type")).unionByName(p.filter("y >= 240").select("pid", "label", F.lit("outcell").alias("type")))


@query(W + "SELECT pid FROM points WHERE x < 30 INTERSECT SELECT pid FROM points WHERE y < 200")
def intersect_ids(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.filter("x < 30").select("pid").intersect(p.filter("y < 200").select("pid"))


@query(W + "SELECT pid FROM points WHERE x < 30 EXCEPT SELECT pid FROM points WHERE y < 200")
def except_ids(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.filter("x < 30").select("pid").exceptAll(p.filter("y < 200").select("pid"))


@query(W + "SELECT pid FROM points p WHERE EXISTS (SELECT 1 FROM points q WHERE q.event_type = 'view' AND q.x = p.x AND q.y = p.y)")
def rows_in_other_set(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.join(p.filter("event_type = 'view'").select("x", "y").distinct(), ["x", "y"], "left_semi").select("pid")
