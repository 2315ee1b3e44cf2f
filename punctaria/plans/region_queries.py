"""Queries on neighbours, parameter grids of regions, exports and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctaria.functions import scalar
from punctaria.operators import clustering, evaluate, features, filters, generate, image, phase, series, spatial, stats
from punctaria.sources import points as source

from .catalog import query
from .point_queries import BOUNDS, CELLS, INSIDE, PAIRS, VEC, _rois, _vector_neighbours
from .views import LABELLED, POINTS, counts_by_type, labelled, points, table

R = F.round


# Neighbours.


@query(f"""
WITH {POINTS},
r AS (
  SELECT p.pid, t.pid AS nn_pid, sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y)) AS dist,
    row_number() OVER (PARTITION BY p.pid ORDER BY (p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y), t.pid) AS rank
  FROM points p JOIN points t ON p.pid <> t.pid AND p.pid % 50 = 0
)
SELECT p.pid, k.rank, r.nn_pid, round(dist, 6) AS dist
FROM (SELECT pid FROM points WHERE pid % 50 = 0) p CROSS JOIN (SELECT unnest(range(3, 7)) AS rank) k LEFT JOIN r ON r.pid = p.pid AND r.rank = k.rank
""")
def neighbour_rank_window(spark, sf_dir):
    p = points(spark, sf_dir)
    near = spatial.neighbour_ranks(p.filter("pid % 50 = 0"), 3, 6, targets=p)  # a stated query set against all points
    return near.select("pid", F.col("rank").cast("long").alias("rank"), "nn_pid", R("dist", 6).alias("dist"))


@query(f"""
WITH {POINTS},
s AS (SELECT pid, x, y, CAST(pid % 40 AS DOUBLE) AS z FROM points),
r AS (
  SELECT p.pid, q.pid AS nn_pid, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) AS d2
  FROM s p JOIN s q ON p.pid <> q.pid AND p.pid % 50 = 0
)
SELECT pid, rank, nn_pid, round(sqrt(d2), 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, nn_pid) AS rank FROM r) WHERE rank <= 4
""")
def knn_three_dimensions(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("z", (F.col("pid") % 40).cast("double"))
    near = spatial.knn(p.filter("pid % 50 = 0"), 4, ("x", "y", "z"), targets=p)
    return near.select("pid", F.col("rank").cast("long").alias("rank"), "nn_pid", R("dist", 6).alias("dist"))


@query(f"WITH {PAIRS} SELECT p.pid, count(*) FILTER (e.q <> e.p AND e.d2 < 16) >= 7 AS is_core FROM points p JOIN pairs e ON e.p = p.pid GROUP BY p.pid")
def core_by_kth_neighbour(spark, sf_dir):
    return clustering.core_by_kth_neighbour(points(spark, sf_dir), 4.0, 8)


@query(f"""
WITH {POINTS},
a AS (SELECT pid, x, y, sqrt((x - 10e0) * (x - 10e0) + (y - 60e0) * (y - 60e0)) AS d FROM points WHERE y < 240),
b AS (SELECT pid, x, y, sqrt((x - 10e0) * (x - 10e0) + (y - 300e0) * (y - 300e0)) AS d FROM points WHERE y >= 240)
SELECT pid, x, y, 'incell' AS type FROM a WHERE d < (SELECT max(d) FROM (SELECT d FROM a ORDER BY d LIMIT 201))
UNION ALL
SELECT pid, x, y, 'outcell' FROM b WHERE d < (SELECT max(d) FROM (SELECT d FROM b ORDER BY d LIMIT 201))
""")
def window_of_both_sets(spark, sf_dir):
    p = points(spark, sf_dir)
    return filters.define_window(p.filter("y < 240"), p.filter("y >= 240"), ((10.0, 60.0), (10.0, 300.0)), 200)[0]


@query(f"""
WITH {VEC},
a AS (SELECT pid, list(dist ORDER BY rank) AS d FROM k WHERE rank <= 8 GROUP BY pid),
j AS (SELECT pid, list_transform(range(1, 8), lambda i: d[i + 1] - d[i]) AS s FROM a),
m AS (SELECT pid, s, list_transform(s, lambda v: abs(v - list_median(s))) AS dev FROM j)
SELECT pid, CAST(list_position(list_transform(dev, lambda v: coalesce(v / nullif(list_median(dev), 0) > 5 * list_median(dev), false)), true) - 1 AS INTEGER) AS cut FROM m
""")
def outlier_jumps(spark, sf_dir):
    a = features.normalise(features.distance_arrays(_vector_neighbours(spark, sf_dir)), "Raw-Differences")
    return a.select("pid", features.outlier_cut(F.filter("f", lambda v: v.isNotNull())).cast("int").alias("cut"))


@query(f"""
WITH {PAIRS},
n AS (SELECT p, q, row_number() OVER (PARTITION BY p ORDER BY d2, q) AS rank FROM pairs WHERE p <> q),
r AS (SELECT n.p AS pid, n.rank, b.x - a.x AS dx, b.y - a.y AS dy FROM n JOIN points a ON a.pid = n.p JOIN points b ON b.pid = n.q WHERE n.rank <= 3),
l AS (SELECT pid, least(0, min(least(dx, dy))) AS lo, greatest(0, max(greatest(dx, dy))) AS hi FROM r GROUP BY pid)
SELECT pid, rank, round(coalesce(dx / nullif(hi - lo, 0), 0), 6) AS fx, round(coalesce(dy / nullif(hi - lo, 0), 0), 6) AS fy FROM r JOIN l USING (pid)
""")
def neighbour_coordinates(spark, sf_dir):
    p = points(spark, sf_dir).select("pid", "x", "y")
    near = spatial.knn_within(p, 3, 4.0).select("pid", "rank", "nn_pid")
    f = features.relative_coordinates(p, near)
    pair = F.transform(F.sequence(F.lit(0), F.floor(F.size("f") / 2).cast("int") - 1), lambda i: F.struct(R(F.get("f", 2 * i), 6).alias("fx"), R(F.get("f", 2 * i + 1), 6).alias("fy")))
    return f.select("pid", F.posexplode(pair).alias("rank", "c")).select("pid", (F.col("rank") + 1).cast("long").alias("rank"), "c.fx", "c.fy")


# Parameter grids. Six settings over two regions.


def _assigned(name: str, where: str, cells: list[tuple[int, float, int]]) -> str:
    """SQL of the labels of all settings over the points of a region, as the table ``name`` (idx, pid, label)."""
    n = name
    return f"""
{n}_p AS (SELECT pid, x, y, floor(x / 4e0) AS cx, floor(y / 4e0) AS cy FROM points WHERE {where}),
{n}_c(idx, sigma, threshold) AS (VALUES {", ".join(f"({i}, {s}e0, {t})" for i, s, t in cells)}),
{n}_near AS (
  SELECT idx, p.pid AS p, q.pid AS q, threshold
  FROM (SELECT pid, x, y, cx + a.o AS cx, cy + b.o AS cy FROM {n}_p, (VALUES (-1), (0), (1)) a(o), (VALUES (-1), (0), (1)) b(o)) p
  JOIN {n}_p q USING (cx, cy) JOIN {n}_c c ON (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= sigma * sigma
),
{n}_core AS (SELECT idx, p AS pid FROM {n}_near GROUP BY idx, p, threshold HAVING count(*) >= threshold),
{n}_edge AS (SELECT e.idx, p, q FROM {n}_near e JOIN {n}_core a ON a.idx = e.idx AND a.pid = p JOIN {n}_core b ON b.idx = e.idx AND b.pid = q WHERE p <> q),
{n}_reach(idx, pid, seen) AS (SELECT idx, pid, pid FROM {n}_core UNION SELECT e.idx, e.q, r.seen FROM {n}_reach r JOIN {n}_edge e ON e.idx = r.idx AND e.p = r.pid AND r.seen < e.q),
{n}_num AS (SELECT idx, pid, dense_rank() OVER (PARTITION BY idx ORDER BY rep) - 1 AS label FROM (SELECT idx, pid, min(seen) AS rep FROM {n}_reach GROUP BY idx, pid)),
{n}_rim AS (SELECT e.idx, e.p AS pid, min(m.label) AS label FROM {n}_near e JOIN {n}_num m ON m.idx = e.idx AND m.pid = e.q GROUP BY e.idx, e.p),
{n} AS (SELECT c.idx, p.pid, CAST(coalesce(m.label, b.label, -1) AS INTEGER) AS label FROM {n}_c c CROSS JOIN {n}_p p LEFT JOIN {n}_num m ON m.idx = c.idx AND m.pid = p.pid LEFT JOIN {n}_rim b ON b.idx = c.idx AND b.pid = p.pid)"""


def _scored(name: str) -> str:
    """SQL of the similarity of the clusters of an assignment, as ``name``_score (idx, label, similarityScore)."""
    n = name
    return f"""
{n}_size AS (SELECT idx, label, count(*) AS n FROM {n} WHERE label >= 0 GROUP BY 1, 2),
{n}_met AS (SELECT a.idx AS i, a.label AS a, b.idx AS j, b.label AS b, count(*) AS n FROM {n} a JOIN {n} b ON a.pid = b.pid AND a.idx <> b.idx WHERE a.label >= 0 AND b.label >= 0 GROUP BY 1, 2, 3, 4),
{n}_like AS (SELECT i, a, j FROM {n}_met m JOIN {n}_size x ON x.idx = i AND x.label = a JOIN {n}_size y ON y.idx = j AND y.label = b WHERE m.n > 0.5 * x.n AND m.n > 0.5 * y.n),
{n}_score AS (SELECT s.idx, s.label, count(DISTINCT j) AS "similarityScore" FROM {n}_size s LEFT JOIN {n}_like l ON l.i = s.idx AND l.a = s.label GROUP BY 1, 2)"""


ALL = f"WITH RECURSIVE {POINTS}, {_assigned('g', 'true', CELLS)}"
COUNTS = "coalesce(count(DISTINCT label) FILTER (label >= 0), 0) AS no_clusters, count(*) FILTER (label >= 0) AS no_points_clustered"


def _grid(spark):
    return spark.createDataFrame(CELLS, "idx int, sigma double, threshold int")


@query(f"{ALL} SELECT idx, pid, label FROM g")
def phase_assignment(spark, sf_dir):
    return phase.phase_assignment(points(spark, sf_dir), CELLS)


@query(f"{ALL} SELECT idx, sigma, threshold, {COUNTS} FROM g JOIN g_c USING (idx) GROUP BY ALL")
def phase_space(spark, sf_dir):
    return phase.phase_space(_grid(spark), phase.phase_assignment(points(spark, sf_dir), CELLS))


#: Settings so near one another that clusters persist.
NEAR = [(i * 2 + j, s, t) for i, s in enumerate((3.7, 3.85, 4.0)) for j, t in enumerate((19, 20))]
NEARBY = f"WITH RECURSIVE {POINTS}, {_assigned('g', 'true', NEAR)}, {_scored('g')}"


@query(f'{NEARBY} SELECT idx, label, "similarityScore" FROM g_score')
def phase_similarity(spark, sf_dir):
    return phase.similarity(phase.phase_assignment(points(spark, sf_dir), NEAR))[0]


@query(f"{NEARBY} SELECT i, j, count(DISTINCT a) AS score FROM g_like GROUP BY 1, 2")
def similarity_matrix(spark, sf_dir):
    return phase.similarity_matrix(phase.phase_assignment(points(spark, sf_dir), NEAR))


REGIONS = [(0, 2.0, 15), (1, 2.0, 25), (2, 4.0, 15), (3, 4.0, 25)]


@query(f"""
WITH RECURSIVE {POINTS}, {_assigned('a', 'pid % 2 = 0', REGIONS)}, {_assigned('b', 'pid % 2 = 1', REGIONS)}, {_scored('a')},
x AS (SELECT idx, sigma, threshold, {COUNTS} FROM a JOIN a_c USING (idx) GROUP BY ALL),
y AS (SELECT idx, {COUNTS.replace('no_clusters', 'no_clusters_ref').replace('no_points_clustered', 'no_points_clustered_ref')} FROM b GROUP BY idx)
SELECT idx, sigma, threshold, no_clusters, no_points_clustered, coalesce((SELECT CAST(sum("similarityScore") AS BIGINT) FROM a_score s WHERE s.idx = x.idx), 0) AS "similarityScore", no_clusters_ref, no_points_clustered_ref FROM x JOIN y USING (idx)
""")
def phase_space_in_and_out(spark, sf_dir):
    p = points(spark, sf_dir)
    search = phase.ParameterSearch(algo="dbscan", points_per_dimension=2, minmax_threshold=(15, 25), log_sigmas=False, adaptive_sigma_boundaries=False, sigma_boundaries=(2.0, 4.0))
    return phase.in_and_out_cell(p.filter("pid % 2 = 0"), p.filter("pid % 2 = 1"), search)[0]


TWO = f"{LABELLED}, two AS (SELECT 0 AS idx, pid, label FROM labelled UNION ALL SELECT 1, pid, truth FROM labelled)"


def _two(spark, sf_dir):
    p = labelled(spark, sf_dir)
    return p.select(F.lit(0).alias("idx"), "pid", "label").unionByName(p.select(F.lit(1).alias("idx"), "pid", F.col("truth").alias("label")))


@query(f"WITH {TWO}, r AS (SELECT idx, count(*) FILTER (t.label >= 0 AND truth >= 0) AS tp, count(*) FILTER (t.label >= 0 AND truth < 0) AS fp, count(*) FILTER (t.label < 0 AND truth >= 0) AS fn FROM two t JOIN labelled USING (pid) GROUP BY idx) SELECT idx, round(tp / (tp + 0.5e0 * (fp + fn)), 6) AS f1 FROM r")
def f1_by_setting(spark, sf_dir):
    f = evaluate.f1_by_cell(_two(spark, sf_dir), labelled(spark, sf_dir).select("pid", "truth"))
    return f.select("idx", R("f1", 6).alias("f1"))


@query(f'WITH {TWO} SELECT idx, CAST(10 + 5 * idx AS INTEGER) AS threshold, label, count(*) AS "clusterSize" FROM two WHERE label >= 0 GROUP BY ALL')
def sizes_along_optima(spark, sf_dir):
    return stats.sizes_along(_two(spark, sf_dir), spark.createDataFrame([(0, 10), (1, 15)], "idx int, threshold int"))


@query(f"WITH {TWO}, s AS (SELECT idx, label, count(*) AS n FROM two WHERE label >= 0 GROUP BY ALL) SELECT idx, round(count(*) FILTER (n >= CASE idx WHEN 0 THEN 30 ELSE 50 END) / count(*), 6) AS share FROM two LEFT JOIN s USING (idx, label) GROUP BY idx")
def share_of_points_kept(spark, sf_dir):
    a = _two(spark, sf_dir)
    info = a.filter("label >= 0").groupBy(F.col("idx").alias("index"), F.col("label").alias("labels")).agg(F.count("*").alias("clusterSize"))
    limits = spark.createDataFrame([(0, 30), (1, 50)], "index int, T int")
    return phase.share_kept(a, info, "clusterSize", limits).select("idx", R("percent_locsIncluded", 6).alias("share"))


# Regions and cluster shapes.

SHAPES = "shape AS (SELECT label, (max(x) - min(x)) * (max(y) - min(y)) AS area, count(*) AS population FROM labelled WHERE label >= 0 GROUP BY label)"


def _shapes(spark, sf_dir):
    box = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    return labelled(spark, sf_dir).filter("label >= 0").groupBy("label").agg(box.alias("area"), F.count("*").alias("population"))


@query(f"WITH {LABELLED}, {SHAPES} SELECT pid, label, round(area, 6) AS cluster_area, coalesce(population, 0) AS cluster_population, round(population / nullif(area, 0), 6) AS cluster_density FROM labelled LEFT JOIN shape USING (label)")
def points_with_cluster_shapes(spark, sf_dir):
    j = stats.with_shapes(_shapes(spark, sf_dir), labelled(spark, sf_dir))
    return j.select("pid", "label", R("cluster_area", 6).alias("cluster_area"), F.coalesce("cluster_population", F.lit(0)).alias("cluster_population"), R("cluster_density", 6).alias("cluster_density"))


@query(f"""
WITH {LABELLED}, {SHAPES},
m AS (SELECT DISTINCT 'a' AS roi, label FROM labelled WHERE label >= 0 AND ({INSIDE}) % 2 = 1 UNION SELECT DISTINCT 'b', label FROM labelled WHERE label >= 0 AND x < 40 AND y < 150)
SELECT roi, round(median(area), 6) AS median_area, round(median(population / nullif(area, 0)), 6) AS median_density
FROM (VALUES ('a'), ('b'), ('c')) z(roi) LEFT JOIN m USING (roi) LEFT JOIN shape USING (label) GROUP BY roi
""")
def roi_shape_medians(spark, sf_dir):
    p, rois = labelled(spark, sf_dir), _rois(spark)
    areas = rois.select("roi", spatial.ring_area(F.col("ring")).alias("area"))
    s = stats.roi_statistics(p, spatial.points_in_rings(p, rois), areas, _shapes(spark, sf_dir))
    return s.select("roi", R("median_area", 6).alias("median_area"), R("median_density", 6).alias("median_density"))


@query(f'WITH {LABELLED}, s AS (SELECT label, count(*) AS "clusterSize" FROM labelled WHERE label >= 0 GROUP BY 1) SELECT label, "clusterSize" FROM s WHERE "clusterSize" > 40')
def clusters_above_limit(spark, sf_dir):
    return filters.large_clusters(stats.cluster_sizes(labelled(spark, sf_dir)), "clusterSize", 40, strictly=True)


@query("""
WITH f AS (SELECT 'cell' || CAST(event_id % 400 AS VARCHAR) || '.txt' AS file, count(*) AS rows FROM events GROUP BY 1),
r AS (SELECT 'cell' || CAST(event_id AS VARCHAR) || '_roi' || CAST(user_id AS VARCHAR) || '.json' AS region_file FROM events)
SELECT region_file, file, rows FROM r JOIN f ON regexp_extract(region_file, '^(.*?)_roi', 1) || '.txt' = file
""")
def regions_of_files(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    files = e.groupBy(F.concat(F.lit("cell"), (F.col("event_id") % 400).cast("string"), F.lit(".txt")).alias("file")).agg(F.count("*").alias("rows"))
    regions = e.select(F.concat(F.lit("cell"), F.col("event_id").cast("string"), F.lit("_roi"), F.col("user_id").cast("string"), F.lit(".json")).alias("region_file"))
    return source.matched_regions(regions, files).select("region_file", "file", "rows")


@query("SELECT file, ordinal FROM (SELECT file, row_number() OVER (ORDER BY n DESC, file DESC) - 1 AS ordinal FROM (SELECT 'run_' || CAST(event_id AS VARCHAR) || '.csv' AS file, event_id AS n FROM events)) WHERE ordinal >= 10 AND ordinal < 300")
def queue_slice(spark, sf_dir):
    files = table(spark, sf_dir, "events").select(F.concat(F.lit("run_"), F.col("event_id").cast("string"), F.lit(".csv")).alias("file"))
    return source.queue_slice(files, 10, 300, reverse=True).select("file", "ordinal")


@query("SELECT event_id, CAST(user_id AS DOUBLE) AS sigma, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id AS DOUBLE) END AS cell FROM events")
def scenario_from_name(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("sim_sigma,"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, F.lit("-tile(")).otherwise(F.lit("-cell(")), F.col("event_id").cast("string"), F.lit(")"))
    return e.select("event_id", *source.values_in_name(name, {"sigma": (3, "sigma"), "cell": (5, "cell")}))


# Exports.


@query("SELECT user_id, list_sort(list(value))[1] AS value_1, list_sort(list(value))[2] AS value_2, list_sort(list(value))[3] AS value_3 FROM events GROUP BY user_id")
def rectangular_rows(spark, sf_dir):
    return source.rectangular_rows(table(spark, sf_dir, "events"), "user_id", "value", 3)


@query("SELECT 'a' AS source, event_id, value, NULL AS doubled FROM events WHERE event_type = 'click' UNION ALL SELECT 'b', event_id, NULL, 2 * value FROM events WHERE event_type <> 'click'")
def pooled_tables(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return source.pooled({"a": e.filter("event_type = 'click'").select("event_id", "value"), "b": e.filter("event_type <> 'click'").select("event_id", (2 * F.col("value")).alias("doubled"))})


@query("SELECT user_id, max(v) FILTER (event_type = 'click') AS click, max(v) FILTER (event_type = 'error') AS error, max(v) FILTER (event_type = 'purchase') AS purchase, max(v) FILTER (event_type = 'signup') AS signup, max(v) FILTER (event_type = 'view') AS view FROM (SELECT user_id, event_type, round(avg(value), 6) AS v FROM events GROUP BY 1, 2) GROUP BY user_id")
def replicate_table(spark, sf_dir):
    means = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(R(F.avg("value"), 6).alias("v"))
    return source.replicate_table(means, "user_id", "event_type", "v", ["click", "error", "purchase", "signup", "view"])


@query(f"""
WITH {LABELLED}, c AS (SELECT CAST(pid % 4 AS INTEGER) AS file, CAST(truth >= 0 AS INTEGER) AS t, CAST(label >= 0 AS INTEGER) AS p FROM labelled),
n AS (SELECT file, count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p = 0) AS fn, count(*) FILTER (t = 0 AND p = 0) AS tn FROM c GROUP BY GROUPING SETS ((file), ()))
SELECT coalesce(CAST(file AS VARCHAR), 'all') AS file, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM n
""")
def pooled_confusion(spark, sf_dir):
    p = labelled(spark, sf_dir).select((F.col("pid") % 4).cast("int").alias("file"), (F.col("truth") >= 0).cast("int").alias("t"), (F.col("label") >= 0).cast("int").alias("p"))
    return evaluate.pooled_confusion(p, "t", "p", "file").select(F.coalesce(F.col("file").cast("string"), F.lit("all")).alias("file"), "tp", "fp", "fn", "tn", R("accuracy", 6).alias("accuracy"))


# Distributions, labels, images.


@query("SELECT event_id, round(exp(k * ln(3.5e0) - 3.5e0 - lgamma(k + 1)), 9) AS poisson, round(exp(lgamma(k + 2.5e0) - lgamma(k + 1) - lgamma(2.5e0) + 2.5e0 * ln(0.6e0) + k * ln(0.4e0)), 9) AS negative_binomial FROM (SELECT event_id, CAST(user_id % 30 AS DOUBLE) AS k FROM events)")
def count_probabilities(spark, sf_dir):
    k = (F.col("user_id") % 30).cast("double")
    return table(spark, sf_dir, "events").select("event_id", R(scalar.poisson_column(k, F.lit(3.5)), 9).alias("poisson"), R(scalar.negative_binomial_column(k, F.lit(2.5), F.lit(0.4)), 9).alias("negative_binomial"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS label, CASE WHEN b < 1024 THEN format('{:.1f} B', b) WHEN b < 1048576 THEN format('{:.1f} KB', b / 1024) ELSE format('{:.1f} MB', b / 1048576) END AS size, round(greatest(0, b * b * 4.61e-9 - b * 2.92e-4), 6) AS seconds FROM (SELECT event_id, ts, CAST(event_id * 257 % 9000000 AS DOUBLE) + 0.3e0 AS b FROM events)")
def names_and_estimates(spark, sf_dir):
    b = (F.col("event_id") * 257 % 9_000_000).cast("double") + 0.3
    return table(spark, sf_dir, "events").select("event_id", scalar.date_label(F.col("ts")).alias("label"), scalar.readable_bytes(b).alias("size"), R(scalar.estimated_seconds(b, 4.61e-9, -2.92e-4), 6).alias("seconds"))


@query(f"""
WITH {POINTS},
h AS (SELECT CAST(least(floor(x / (200e0 / 10)), 9) AS INTEGER) AS ix, CAST(least(floor(y / (480e0 / 12)), 11) AS INTEGER) AS iy, CAST(count(*) AS DOUBLE) AS v FROM points WHERE x BETWEEN 0 AND 200 AND y BETWEEN 0 AND 480 GROUP BY 1, 2),
g AS (SELECT a.ix, b.iy, coalesce(v, 0) AS v FROM (SELECT unnest(range(10)) AS ix) a CROSS JOIN (SELECT unnest(range(12)) AS iy) b LEFT JOIN h ON h.ix = a.ix AND h.iy = b.iy),
s AS (SELECT avg(v) * avg(v) * count(*) AS level FROM g)
SELECT CAST((q.ix - p.ix + 10) % 10 AS INTEGER) AS dx, CAST((q.iy - p.iy + 12) % 12 AS INTEGER) AS dy, round(sum(p.v * q.v) / any_value(level), 6) AS v FROM g p, g q, s GROUP BY 1, 2
""")
def image_autocorrelation(spark, sf_dir):
    h = image.histogram2d(points(spark, sf_dir), BOUNDS, 10, 12)
    return image.autocorrelation(h, 10, 12).select("dx", "dy", R("v", 6).alias("v"))


@query("SELECT round(avg(n), 6) AS mean FROM (SELECT event_id % 12, count(*) AS n FROM events GROUP BY 1)")
def mean_template_population(spark, sf_dir):
    t = table(spark, sf_dir, "events").select((F.col("event_id") % 12).alias("tid"))
    return spark.createDataFrame([(round(generate.mean_population(t), 6),)], "mean double")


# Sequential or hashed: tested against brute force and by their invariants in tests/.


@query()
def cluster_pieces(spark, sf_dir):
    p = labelled(spark, sf_dir).select("pid", "label", "x", "y")
    return clustering.cleaned(clustering.shaped(p, spatial.knn(p, 1)))


@query()
def staged_clusters(spark, sf_dir):
    return clustering.cluster(clustering.tile_of(points(spark, sf_dir), 2000), "staged", cut=2.5, by="tile")


def _field(p):
    """The box around all points as a ring, and their number."""
    r = p.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    return [(r.x0, r.y0), (r.x1, r.y0), (r.x1, r.y1), (r.x0, r.y1), (r.x0, r.y0)], r.n


@query()
def sprinkled_points(spark, sf_dir):
    """As many points as the table holds, at random in their field: what its clusters are compared with."""
    ring, n = _field(points(spark, sf_dir))
    return generate.sprinkled(spark, ring, n, seed=4, fuzz=0.1)


@query()
def spaced_seeds(spark, sf_dir):
    ring, n = _field(points(spark, sf_dir))
    return generate.spaced_seeds(spark, ring, n // 25, 2.0, seed=4)


@query()
def simulation_truth(spark, sf_dir):
    grid = generate.scenarios(spark, {"points": counts_by_type(spark, sf_dir), "share_clustered": [0.4, 0.6], "per_cluster": [20.0], "radius": [30.0], "side": [2000.0]})
    return generate.truth_table(generate.simulated_cells(grid, 2), grid)


@query(f"WITH {POINTS}, s AS (SELECT * FROM points WHERE pid % 20 = 0) SELECT pid, x, y FROM points p WHERE NOT EXISTS (SELECT 1 FROM s WHERE (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 9)")
def depleted_points(spark, sf_dir):
    p = points(spark, sf_dir).select("pid", "x", "y")
    return generate.depleted(p, p.filter("pid % 20 = 0"), 3.0).select("pid", "x", "y")


# Series of experiments.

SERIES = {"algos": ["dbscan:near", "dbscan:far", "DbscanLoop"], "params_algos": {"dbscan:near": {"eps": 3.0, "min_samples": 4}, "dbscan:far": {"eps": 5.0, "min_samples": 8}, "DbscanLoop": {"eps": 4.0, "min_samples": 4}}}


def _experiments(spark, sf_dir):
    """All points with their reference clusters, as an experiment for each event type and half of the ids."""
    known = labelled(spark, sf_dir).select("pid", "truth")
    return points(spark, sf_dir).join(known, "pid").select(F.col("event_type").alias("var_1"), (F.col("pid") % 2).alias("var_2"), "pid", "x", "y", "truth")


@query(f"""
WITH RECURSIVE {LABELLED},
experiment AS (SELECT event_type AS var_1, pid % 2 AS var_2, pid, p.x, p.y, truth FROM points p JOIN labelled USING (pid)),
setting AS (SELECT * FROM (VALUES ('dbscan:near', 3e0, 4), ('dbscan:far', 5e0, 8)) v(algo, eps, least)),
cell AS (SELECT *, floor(x / 5e0) AS cx, floor(y / 5e0) AS cy FROM experiment),
step AS (SELECT * FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
close AS (
  SELECT p.var_1, p.var_2, p.pid AS p, q.pid AS q, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS d2
  FROM (SELECT cell.*, cx + dx AS nx, cy + dy AS ny FROM cell, step) p JOIN cell q ON q.var_1 = p.var_1 AND q.var_2 = p.var_2 AND q.cx = p.nx AND q.cy = p.ny
),
near AS (SELECT algo, least, var_1, var_2, p, q FROM close JOIN setting ON d2 <= eps * eps),
core AS (SELECT algo, p AS pid FROM near GROUP BY algo, least, p HAVING count(*) >= least),
link AS (SELECT near.* FROM near JOIN core a ON a.algo = near.algo AND a.pid = p JOIN core b ON b.algo = near.algo AND b.pid = q),
reach(algo, pid, seen) AS (SELECT algo, pid, pid FROM core UNION SELECT l.algo, l.q, r.seen FROM reach r JOIN link l ON l.algo = r.algo AND l.p = r.pid AND r.seen < l.q),
rep AS (SELECT algo, pid, min(seen) AS rep FROM reach GROUP BY algo, pid),
rim AS (SELECT near.algo, p AS pid, min(rep) AS rep FROM near JOIN rep ON rep.algo = near.algo AND rep.pid = q GROUP BY near.algo, p),
found AS (
  SELECT algo, var_1, var_2, pid, coalesce(rep.rep, rim.rep) AS label, CASE WHEN truth >= 0 THEN truth END AS truth
  FROM experiment CROSS JOIN setting LEFT JOIN rep USING (algo, pid) LEFT JOIN rim USING (algo, pid)
),
n_label AS (SELECT algo, var_1, var_2, label, count(*) AS n_label FROM found WHERE label IS NOT NULL GROUP BY ALL),
n_truth AS (SELECT algo, var_1, var_2, truth, count(*) AS n_truth FROM found WHERE truth IS NOT NULL GROUP BY ALL),
able AS (
  SELECT algo, var_1, var_2, label, truth, n FROM (SELECT algo, var_1, var_2, label, truth, count(*) AS n FROM found WHERE label IS NOT NULL AND truth IS NOT NULL GROUP BY ALL)
  JOIN n_truth USING (algo, var_1, var_2, truth) WHERE n > 0.3e0 * n_truth
),
turn AS (SELECT algo, var_1, var_2, label, dense_rank() OVER (PARTITION BY algo, var_1, var_2 ORDER BY label) AS k FROM (SELECT DISTINCT algo, var_1, var_2, label FROM able)),
match(algo, var_1, var_2, k, truth, taken) AS (
  SELECT DISTINCT algo, var_1, var_2, CAST(0 AS BIGINT), CAST(NULL AS INTEGER), CAST([] AS INTEGER[]) FROM able
  UNION ALL
  SELECT algo, var_1, var_2, k, truth, CASE WHEN truth IS NULL THEN taken ELSE list_append(taken, truth) END FROM (
    SELECT m.algo, m.var_1, m.var_2, t.k, any_value(m.taken) AS taken, first(a.truth ORDER BY a.n DESC, a.truth) FILTER (NOT list_contains(m.taken, a.truth)) AS truth
    FROM match m JOIN turn t ON t.algo = m.algo AND t.var_1 = m.var_1 AND t.var_2 = m.var_2 AND t.k = m.k + 1
    JOIN able a ON a.algo = t.algo AND a.var_1 = t.var_1 AND a.var_2 = t.var_2 AND a.label = t.label GROUP BY m.algo, m.var_1, m.var_2, t.k
  )
),
hit AS (SELECT algo, var_1, var_2, count(truth) AS tp FROM match GROUP BY ALL),
part AS (SELECT algo, var_1, var_2, count(DISTINCT (label, truth)) AS parts FROM found WHERE label IS NOT NULL AND truth IS NOT NULL GROUP BY ALL),
total AS (
  SELECT algo, var_1, var_2, count(DISTINCT label) AS clusters, count(DISTINCT truth) AS g, count(*) FILTER (label IS NOT NULL AND truth IS NOT NULL) AS points_in_both,
    count(*) FILTER (label IS NOT NULL AND truth IS NULL) AS points_found_only, count(*) FILTER (label IS NULL AND truth IS NOT NULL) AS points_missed FROM found GROUP BY ALL
)
SELECT var_1, var_2, algo, clusters, g AS "N_clusters", coalesce(tp, 0) AS true_positives, clusters - coalesce(tp, 0) AS false_positives, g - coalesce(tp, 0) AS false_negatives,
  round(coalesce(tp, 0) / g, 6) AS true_positives_ratio, round((clusters - coalesce(tp, 0)) / g, 6) AS false_positives_ratio, points_in_both, points_found_only, points_missed,
  round(coalesce(parts, 0) / g, 6) AS mean_subclusters
FROM total LEFT JOIN hit USING (algo, var_1, var_2) LEFT JOIN part USING (algo, var_1, var_2)
""")
def series_scores(spark, sf_dir):
    settings = SERIES | {"algos": ["dbscan:near", "dbscan:far"]}
    out = series.run_series(_experiments(spark, sf_dir), settings)
    return out.withColumns({c: R(c, 6) for c in ("true_positives_ratio", "false_positives_ratio", "mean_subclusters")})


@query()
def series_without_borders(spark, sf_dir):
    return series.run_series(_experiments(spark, sf_dir), SERIES | {"algos": ["DbscanLoop"]})
