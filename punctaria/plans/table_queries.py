"""Queries on result tables: statistics, pivots, optima, reference cuts, scores, pools, generators, models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from punctaria.functions import scalar
from punctaria.operators import evaluate, features, filters, generate, ml, phase, stats
from punctaria.operators.ranks import ranked
from punctaria.streaming import windowed_statistics

from .catalog import query
from .views import LABELLED, OPTIMA, PHASE, POINTS, counts_by_type, labelled, optima_like, phase_like, points, table

R = F.round
P = f"WITH {PHASE} "
O = f"WITH {OPTIMA} "
MOMENT3 = 'avg(pow(s, 3)) - 3 * avg(s) * avg(s * s) + 2 * pow(avg(s), 3)'
MOMENT4 = 'avg(pow(s, 4)) - 4 * avg(s) * avg(pow(s, 3)) + 6 * pow(avg(s), 2) * avg(s * s) - 3 * pow(avg(s), 4)'
STATS = f"round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(quantile_cont(s, 0.9), 6) AS q90, round(quantile_cont(s, 0.1), 6) AS q10, round(stddev_pop(s) / avg(s), 6) AS cv, round(var_pop(s) / avg(s), 6) AS fano, round(({MOMENT3}) / pow(var_pop(s), 1.5), 5) AS skewness, round(({MOMENT4}) / pow(var_pop(s), 2) - 3, 5) AS kurtosis"


@query(P + f"SELECT threshold, count(*) AS n, {STATS}, count(*) FILTER (s < threshold + 1) AS \"firstBin\" FROM (SELECT threshold, \"clusterSize\" AS s FROM phase) GROUP BY threshold")
def size_statistics(spark, sf_dir):
    s = stats.size_statistics(phase_like(spark, sf_dir))
    return s.select("threshold", "n", *(R(c, 6).alias(c) for c in ("mean", "median", "q90", "q10", "cv", "fano")), *(R(c, 5).alias(c) for c in ("skewness", "kurtosis")), "firstBin")


@query(P + f"SELECT threshold, type, round(median(s), 6) AS median, count(*) AS count, min(s) AS min, max(s) AS max, round(stddev_samp(s), 6) AS std, round(stddev_pop(s) / avg(s), 6) AS cv, round(({MOMENT3}) / pow(var_pop(s), 1.5), 5) AS skewness, round(({MOMENT4}) / pow(var_pop(s), 2) - 3, 5) AS kurtosis, round(var_pop(s) / avg(s), 6) AS fano FROM (SELECT threshold, type, \"clusterSize\" AS s FROM phase) GROUP BY threshold, type")
def type_statistics(spark, sf_dir):
    s = stats.type_statistics(phase_like(spark, sf_dir))
    return s.select("threshold", "type", R("median", 6).alias("median"), "count", "min", "max", *(R(c, 6).alias(c) for c in ("std", "cv")), *(R(c, 5).alias(c) for c in ("skewness", "kurtosis")), R("fano", 6).alias("fano"))


SIGMAS = [k / 100 for k in range(11)]


@query(P + "SELECT threshold, " + ", ".join(f"round(avg(\"clusterSize\") FILTER (round(sigma * 100) = {k}), 6) AS s{k}" for k in range(11)) + " FROM phase GROUP BY threshold")
def heat_map_mean(spark, sf_dir):
    p = phase_like(spark, sf_dir).withColumn("s", F.concat(F.lit("s"), F.round(F.col("sigma") * 100).cast("int")))
    h = stats.heat_map(p, "threshold", "s", "clusterSize", [f"s{k}" for k in range(11)])
    return h.select("threshold", *(R(f"s{k}", 6).alias(f"s{k}") for k in range(11)))


@query(P + "SELECT threshold, CAST(round(sigma * 100) AS INTEGER) AS s, count(*) AS n, round(sum(\"clusterSize\"), 2) AS total FROM phase GROUP BY 1, 2")
def counts_and_sums(spark, sf_dir):
    return phase_like(spark, sf_dir).groupBy("threshold", F.round(F.col("sigma") * 100).cast("int").alias("s")).agg(F.count("*").alias("n"), R(F.sum("clusterSize"), 2).alias("total"))


@query(P + "SELECT threshold, CAST(round(sigma * 100) AS INTEGER) AS s, type, round(quantile_cont(\"clusterSize\", 0.7), 6) AS q70 FROM phase GROUP BY 1, 2, 3")
def group_quantile(spark, sf_dir):
    return phase_like(spark, sf_dir).groupBy("threshold", F.round(F.col("sigma") * 100).cast("int").alias("s"), "type").agg(R(F.percentile("clusterSize", F.lit(0.7)), 6).alias("q70"))


@query(P + "SELECT threshold, type, round(avg(\"clusterSize\"), 6) AS mean, round(stddev_samp(\"clusterSize\"), 6) AS std, max(\"clusterSize\") AS top FROM phase WHERE \"clusterSize\" < 45 GROUP BY 1, 2")
def mean_std_after_filter(spark, sf_dir):
    return phase_like(spark, sf_dir).filter("clusterSize < 45").groupBy("threshold", "type").agg(R(F.avg("clusterSize"), 6).alias("mean"), R(F.stddev_samp("clusterSize"), 6).alias("std"), F.max("clusterSize").alias("top"))


@query(P + "SELECT threshold, type, \"clusterSize\" / max(\"clusterSize\") OVER () AS scaled, count(*) AS n FROM phase GROUP BY threshold, type, \"clusterSize\"")
def normalised_by_maximum(spark, sf_dir):
    g = phase_like(spark, sf_dir).groupBy("threshold", "type", F.col("clusterSize").alias("scaled")).agg(F.count("*").alias("n"))
    return stats.normalised(g, "scaled").select("threshold", "type", "scaled", "n")


@query(P + "SELECT threshold, type, sigma FROM phase WHERE type IN ('incell') AND \"clusterSize\" >= 49")
def in_list_filter(spark, sf_dir):
    return phase_like(spark, sf_dir).filter(F.col("type").isin("incell") & (F.col("clusterSize") >= 49)).select("threshold", "type", "sigma")


@query(O + "SELECT idx, threshold, sigma, \"similarityScore\" FROM (SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY \"similarityScore\" DESC, idx) AS r FROM optima) WHERE r = 1")
def line_of_optima(spark, sf_dir):
    return phase.line_of_optima(optima_like(spark, sf_dir), "threshold", "similarityScore")


@query(O + ", b AS (SELECT 0.99e0 * min(\"similarityScore\") AS lo, 1.01e0 * max(\"similarityScore\") AS hi FROM optima), g AS (SELECT *, ceil((\"similarityScore\" - lo) / ((hi - lo) / 8)) AS g FROM optima, b) SELECT idx, threshold FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY threshold DESC, idx) AS r FROM g WHERE g BETWEEN 1 AND 8) WHERE r = 1")
def line_of_optima_binned(spark, sf_dir):
    return phase.line_of_optima(optima_like(spark, sf_dir), "similarityScore", "threshold", bins=8).select("idx", "threshold")


@query(O + "SELECT idx, threshold FROM optima WHERE threshold > 8 ORDER BY \"similarityScore\" DESC, idx LIMIT 1")
def constrained_best_row(spark, sf_dir):
    return phase.best_row(optima_like(spark, sf_dir), "similarityScore", condition=F.col("threshold") > 8).select("idx", "threshold")


@query(O + "SELECT idx, threshold FROM optima ORDER BY abs(threshold - 7.2e0) + abs(sigma - 2.1e0), idx LIMIT 1")
def nearest_setting(spark, sf_dir):
    return filters.nearest_setting(optima_like(spark, sf_dir), 2.1, 7.2).select("idx", "threshold")


@query(O + "SELECT idx FROM (SELECT idx, dense_rank() OVER (ORDER BY sigma) - 1 AS i, dense_rank() OVER (ORDER BY threshold) - 1 AS j FROM optima) WHERE i = 2 AND j = 3")
def setting_by_ordinal(spark, sf_dir):
    return filters.setting_by_ordinal(optima_like(spark, sf_dir), 2, 3).select("idx")


@query(O + "SELECT idx, CAST(dense_rank() OVER (ORDER BY sigma) - 1 AS INTEGER) AS sigma_ordinal, CAST(dense_rank() OVER (ORDER BY threshold) - 1 AS INTEGER) AS threshold_ordinal FROM optima")
def setting_ordinals(spark, sf_dir):
    return filters.ordinals(optima_like(spark, sf_dir)).select("idx", "sigma_ordinal", "threshold_ordinal")


@query(O + ", l AS (SELECT threshold, max(\"similarityScore\") AS m FROM optima GROUP BY 1), s AS (SELECT threshold, (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) AS scaled FROM l) SELECT threshold, round(scaled, 6) AS scaled FROM s ORDER BY CASE WHEN scaled < 0.5 THEN 0 ELSE 1 END, CASE WHEN scaled < 0.5 THEN threshold ELSE -threshold END LIMIT 1")
def selected_threshold(spark, sf_dir):
    line = phase.line_of_optima(optima_like(spark, sf_dir), "threshold", "similarityScore")
    return phase.select_threshold(line).select("threshold", R("scaled", 6).alias("scaled"))


CUT = "n AS (SELECT \"clusterSize\" AS t, count(*) FILTER (type = 'incell') AS a, count(*) FILTER (type = 'outcell') AS b FROM phase GROUP BY 1), c AS (SELECT t, a, coalesce(sum(a) OVER w, 0) AS n_in, coalesce(sum(b) OVER w, 0) AS n_out, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM n WINDOW w AS (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), sc AS (SELECT t, n_in, n_out, (n_in / ta) / (n_in / ta + n_out / tb) AS score FROM c WHERE a > 0 AND n_in + n_out > 10), best AS (SELECT * FROM sc ORDER BY least(score, 1e0) DESC, t LIMIT 1)"


@query(P + f", {CUT} SELECT t AS \"T\", round(score, 6) AS score, CAST(n_in AS BIGINT) AS n_in, CAST(n_out AS BIGINT) AS n_out FROM best")
def optimal_size_cut(spark, sf_dir):
    return phase.optimal_t(phase_like(spark, sf_dir), "clusterSize").select("T", R("score", 6).alias("score"), "n_in", "n_out")


@query(P + f", {CUT}, g AS (SELECT threshold AS index, count(*) FILTER (type = 'incell' AND \"clusterSize\" > t) AS i, count(*) FILTER (type = 'outcell' AND \"clusterSize\" > t) AS o, count(*) FILTER (type = 'incell') AS a, count(*) FILTER (type = 'outcell') AS b FROM phase, best GROUP BY 1) SELECT index, i AS no_clusters, o AS no_clusters_ref, round(CASE WHEN i + o = 0 THEN 0 ELSE (i / a) / (i / a + o / b) END, 6) AS no_clusters_s_vs_n FROM g")
def cleaned_phase_rows(spark, sf_dir):
    info = phase_like(spark, sf_dir).withColumn("index", F.col("threshold"))
    t = phase.optimal_t(info, "clusterSize").select("T")
    limits = info.select("index").distinct().join(F.broadcast(t))
    c = phase.cleaned_labels(info, "clusterSize", limits)
    return c.select("index", "no_clusters", "no_clusters_ref", R("no_clusters_s_vs_n", 6).alias("no_clusters_s_vs_n"))


@query(P + "SELECT CAST(least(floor((\"clusterSize\" - 0e0) / 5e0), 9) AS INTEGER) AS bin, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM phase WHERE \"clusterSize\" BETWEEN 0 AND 50 GROUP BY 1")
def size_histogram(spark, sf_dir):
    return stats.histogram(phase_like(spark, sf_dir), "clusterSize", 0, 50, 10).select("bin", R("share", 6).alias("share"))


@query(P + "SELECT CAST(floor(log10(\"clusterSize\") * 10) AS INTEGER) AS bin, count(*) AS n FROM phase WHERE \"clusterSize\" > 0 GROUP BY 1")
def log_size_histogram(spark, sf_dir):
    return stats.log_histogram(phase_like(spark, sf_dir), "clusterSize", 10)


@query(P + "SELECT threshold, CAST(centre AS INTEGER) AS centre, n FROM (SELECT threshold, floor(\"clusterSize\" + 0.5e0) AS centre, count(*) AS n, row_number() OVER (PARTITION BY threshold ORDER BY count(*) DESC, floor(\"clusterSize\" + 0.5e0)) AS r FROM phase WHERE \"clusterSize\" >= 0.5 AND \"clusterSize\" < 40.5 GROUP BY 1, 2) WHERE r = 1")
def modal_size(spark, sf_dir):
    return stats.modal_bin(phase_like(spark, sf_dir))


@query(P + "SELECT round(e * e / (v - e), 6) AS r, round(1 - e / v, 6) AS p FROM (SELECT avg(\"clusterSize\") AS e, var_pop(\"clusterSize\") AS v FROM phase WHERE \"clusterSize\" < 100)")
def negative_binomial_moments(spark, sf_dir):
    return stats.negative_binomial(phase_like(spark, sf_dir)).select(R("r", 6).alias("r"), R("p", 6).alias("p"))


@query()
def fitted_count_distributions(spark, sf_dir):
    """Of the numbers of lines that a part is ordered in."""
    per_part = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.count("*").alias("clusterSize"))
    fits = stats.fitted_counts(per_part, by=("l_returnflag",))
    return fits.select("l_returnflag", "n", *(R(c, 5).alias(c) for c in ("mean", "poisson_error", "r", "p", "nb_error")))



HIST = "SELECT CAST(least(floor(\"clusterSize\" / 5e0), 9) AS INTEGER) AS bin, count(*) / sum(count(*)) OVER () AS share FROM phase WHERE \"clusterSize\" BETWEEN 0 AND 50 AND type = "


@query(P + f", p AS ({HIST}'incell' GROUP BY 1), q AS ({HIST}'outcell' GROUP BY 1) SELECT round(sum(p.share * log2(p.share / q.share)), 8) AS kl FROM p JOIN q USING (bin)")
def kl_divergence(spark, sf_dir):
    f = phase_like(spark, sf_dir)
    h = lambda k: stats.histogram(f.filter(F.col("type") == k), "clusterSize", 0, 50, 10)
    return stats.kl_divergence(h("incell"), h("outcell")).select(R("kl", 8).alias("kl"))


@query(P + ", m AS (SELECT threshold, avg(\"clusterSize\") AS y FROM phase GROUP BY 1) SELECT x_mid, round(slope, 6) AS slope FROM (SELECT (threshold + lead(threshold) OVER w) / 2 AS x_mid, (lead(y) OVER w - y) / (lead(threshold) OVER w - threshold) AS slope FROM m WINDOW w AS (ORDER BY threshold)) WHERE x_mid IS NOT NULL")
def statistic_slope(spark, sf_dir):
    m = phase_like(spark, sf_dir).groupBy("threshold").agg(F.avg("clusterSize").alias("y"))
    return stats.midpoint_derivative(m, "threshold", "y").select("x_mid", R("slope", 6).alias("slope"))


@query(P + ", m AS (SELECT threshold, avg(\"clusterSize\" * sigma) AS y FROM phase GROUP BY 1), s AS (SELECT threshold, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS s, first_value(y) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) > last_value(y) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS falls FROM m), u AS (SELECT threshold, CASE WHEN falls THEN 1 - s ELSE s END AS scaled FROM s) SELECT threshold, round(scaled, 6) AS scaled, min(threshold) FILTER (scaled > 0.5) OVER () AS first_above FROM u")
def rescaled_series(spark, sf_dir):
    m = phase_like(spark, sf_dir).groupBy("threshold").agg(F.avg(F.col("clusterSize") * F.col("sigma")).alias("y"))
    return stats.rescaled_series(m, "threshold", "y", 0.5).select("threshold", R("scaled", 6).alias("scaled"), "first_above")


@query("SELECT o_custkey % 7 AS var_1, o_orderpriority AS algo, round(count(*) FILTER (o_orderstatus = 'F') / 50e0, 6) AS true_positives_ratio, round(count(*) FILTER (o_orderstatus = 'O') / 50e0, 6) AS false_positives_ratio FROM orders GROUP BY 1, 2")
def series_ratios(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 7).alias("var_1"), F.lit(0).alias("var_2"), F.col("o_orderpriority").alias("algo")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("true_positives"), F.count_if(F.col("o_orderstatus") == "O").alias("false_positives"), F.lit(50).alias("N_clusters"))
    return stats.series_ratios(o).select("var_1", "algo", R("true_positives_ratio", 6).alias("true_positives_ratio"), R("false_positives_ratio", 6).alias("false_positives_ratio"))


TRUTH = "c AS (SELECT event_type AS file, CAST(value > 10 AS INTEGER) AS t, CAST(user_id % 3 = 0 AS INTEGER) AS p FROM events)"


def _classes(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("file"), (F.col("value") > 10).cast("int").alias("t"), (F.col("user_id") % 3 == 0).cast("int").alias("p"))


@query(f"WITH {TRUTH}, n AS (SELECT file, count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p = 0) AS fn, count(*) FILTER (t = 0 AND p = 0) AS tn FROM c GROUP BY file) SELECT file, tp, fp, fn, tn, round(tp / (tp + fn), 6) AS recall_1, round(tn / (tn + fp), 6) AS recall_0, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM n")
def confusion_by_file(spark, sf_dir):
    c = evaluate.confusion(_classes(spark, sf_dir), "t", "p", ("file",))
    return c.select("file", "tp", "fp", "fn", "tn", *(R(k, 6).alias(k) for k in ("recall_1", "recall_0", "accuracy")))


@query(f"WITH {TRUTH} SELECT t AS truth, p AS predicted, round(count(*) / sum(count(*)) OVER (PARTITION BY t), 6) AS share FROM c GROUP BY 1, 2")
def confusion_row_shares(spark, sf_dir):
    return evaluate.confusion_shares(_classes(spark, sf_dir), "t", "p").select("truth", "predicted", R("share", 6).alias("share"))


@query(f"WITH {TRUTH}, k AS (SELECT * FROM (VALUES (0), (1)) v(c)), n AS (SELECT k.c AS c, count(*) FILTER (t = k.c AND p = k.c) AS tp, count(*) FILTER (t = k.c) AS s, count(*) FILTER (p = k.c) AS g FROM c, k GROUP BY 1), f AS (SELECT s, tp / g AS pr, tp / s AS re FROM n) SELECT round(sum(2 * pr * re / (pr + re) * s) / sum(s), 6) AS f1_weighted, round(avg(pr), 6) AS precision_macro, round(avg(re), 6) AS recall_macro FROM f")
def class_scores(spark, sf_dir):
    c = evaluate.class_scores(_classes(spark, sf_dir), "t", "p")
    return c.select(*(R(k, 6).alias(k) for k in ("f1_weighted", "precision_macro", "recall_macro")))


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n FROM c")
def class_counts(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


# An order that SQL can give too: the first 60 bits of a digest.
SHUFFLED = "CAST('0x' || substr(md5('s' || CAST({0} AS VARCHAR)), 1, 15) AS BIGINT)"
EMBEDDED = f"SELECT vec_id AS pid, label, row_number() OVER (PARTITION BY label ORDER BY {SHUFFLED.format('vec_id')}, vec_id) AS r FROM embeddings"


def _shuffled(key):
    return F.conv(F.substring(F.md5(F.concat(F.lit("s"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")


@query(f"SELECT pid, label, CASE WHEN r <= 20 THEN 'train' ELSE 'test' END AS part FROM ({EMBEDDED}) WHERE r <= 25")
def training_pool(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), "label")
    return features.pool(e, "label", {"train": 200, "test": 50}, order=_shuffled("pid"))


@query(f"SELECT pid, label, CAST((r - 1) % 10 AS INTEGER) AS fold FROM ({EMBEDDED})")
def stratified_folds(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), "label")
    return features.stratified_folds(e, "label", order=_shuffled("pid"))


@query(f"WITH {POINTS} SELECT pid, x FROM points ORDER BY {SHUFFLED.format('pid')}, pid LIMIT (SELECT count(*) // 4 FROM points)")
def random_subset(spark, sf_dir):
    return features.sample_rows(points(spark, sf_dir), fraction=0.25, order=_shuffled("pid")).select("pid", "x")


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS label FROM embeddings")
def argmax_label(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", features.argmax_label(F.col("embedding")).alias("label"))


@query(f"WITH {POINTS} SELECT pid, CAST(round_even(x - floor(x), 0) AS INTEGER) AS label, CAST(trunc((x - floor(x)) * 1000e0) AS INTEGER) AS cut, CAST(greatest(2, least(20, floor(x))) AS INTEGER) AS clamped, round(sqrt(x * x + y * y), 6) AS norm FROM points")
def scalar_functions(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    part = x - F.floor(x)
    return points(spark, sf_dir).select("pid", features.label_from_score(part).alias("label"), scalar.truncated(part, 1000).alias("cut"), scalar.clamp(F.floor(x), 2, 20).cast("int").alias("clamped"), R(scalar.distance(x, y), 6).alias("norm"))


@query("SELECT event_type, i, round(exp(ln(lo) + i * (ln(hi) - ln(lo)) / 14), 6) AS sigma FROM (SELECT event_type, min(value) + 1 AS lo, max(value) + 1 AS hi FROM events GROUP BY 1), range(15) r(i)")
def log_grid(spark, sf_dir):
    b = table(spark, sf_dir, "events").groupBy("event_type").agg((F.min("value") + 1).alias("lo"), (F.max("value") + 1).alias("hi"))
    return b.select("event_type", F.posexplode(scalar.logspace(F.col("lo"), F.col("hi"), 15)).alias("i", "sigma")).select("event_type", F.col("i").cast("long").alias("i"), R("sigma", 6).alias("sigma"))


_COUNTS = "t AS (SELECT CAST(n AS DOUBLE) AS points, row_number() OVER (ORDER BY n, event_type) - 1 AS i FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1))"


@query(f"WITH {_COUNTS} SELECT CAST(i * 3 + j AS INTEGER) AS sc, points, 0.2e0 * (j + 1) AS share_clustered FROM t, range(3) b(j)")
def scenario_grid(spark, sf_dir):
    return generate.scenarios(spark, {"points": counts_by_type(spark, sf_dir), "share_clustered": [0.2, 0.2 * 2, 0.2 * 3]}).select("sc", "points", "share_clustered")


def _scenarios(spark, sf_dir):
    return generate.scenarios(spark, {"points": counts_by_type(spark, sf_dir), "share_clustered": [0.0, 0.25, 0.5], "per_cluster": [10.0, 25.0], "radius": [20.0, 60.0], "side": [2000.0]})


_GRID = f"{_COUNTS}, g AS (SELECT points, share_clustered, per_cluster, radius FROM t, (VALUES (0e0), (0.25e0), (0.5e0)) b(share_clustered), (VALUES (10e0), (25e0)) c(per_cluster), (VALUES (20e0), (60e0)) d(radius))"


@query(f"""
WITH {_GRID}, h AS (SELECT *, floor(points * share_clustered / per_cluster) AS clusters FROM g), k AS (SELECT *, {math.pi} * radius * radius * clusters AS area FROM h)
SELECT points, share_clustered, per_cluster, radius, CAST(clusters AS BIGINT) AS clusters, round(area, 4) AS clustered_area,
  round((clusters * per_cluster / nullif(area, 0)) / nullif((points - clusters * per_cluster) / nullif(4000000e0 - area, 0), 0), 4) AS density_ratio
FROM k
""")
def scenario_densities(spark, sf_dir):
    d = generate.scenario_densities(_scenarios(spark, sf_dir))
    d = d.withColumns({"clusters": F.col("clusters").cast("long"), "clustered_area": R("clustered_area", 4), "density_ratio": R("density_ratio", 4)})
    return d.select("points", "share_clustered", "per_cluster", "radius", "clusters", "clustered_area", "density_ratio")


@query()
def simulated_cells(spark, sf_dir):
    return generate.ground_truth(generate.simulated_cells(_scenarios(spark, sf_dir), 2))


def _templates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 12).cast("int").alias("tid"), F.col("event_id").alias("pid"), (F.col("value") % 5).alias("x"), ((F.col("user_id") * 7) % 5).cast("double").alias("y"))
    return generate.prepared_templates(e, 1.0)


@query()
def geometry_free(spark, sf_dir):
    return generate.geometry_free(_templates(spark, sf_dir), noise_ratio=0.2, seed=3)


@query()
def geometry_grid(spark, sf_dir):
    return generate.geometry_grid(_templates(spark, sf_dir), 4, 1.5, 0.3, seed=3)


@query()
def geometry_path(spark, sf_dir):
    return generate.geometry_path(_templates(spark, sf_dir), 10, 100, seed=3)


@query()
def overlay_reference(spark, sf_dir):
    p = points(spark, sf_dir)
    return generate.overlay(p.filter("x < 5"), p.filter("x >= 5"))


T = "t AS (SELECT CAST(event_id % 12 AS INTEGER) AS tid, value % 5 AS x, CAST((user_id * 7) % 5 AS DOUBLE) AS y FROM events)"


@query(f"WITH {T} SELECT a.tid, round(sqrt(max((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS diameter FROM t a JOIN t b USING (tid) GROUP BY a.tid")
def template_diameters(spark, sf_dir):
    return stats.diameters(_templates(spark, sf_dir)).select("tid", R("diameter", 6).alias("diameter"))


@query(f"WITH {LABELLED}, s AS (SELECT label, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM labelled WHERE label >= 0 GROUP BY 1) SELECT label, n AS population, round(cx, 6) AS cx, round(cy, 6) AS cy FROM s WHERE n >= 3")
def cluster_outlines(spark, sf_dir):
    from punctaria.operators.clustering import hulls

    return hulls(labelled(spark, sf_dir)).select("label", "population", R("cx", 6).alias("cx"), R("cy", 6).alias("cy"))


@query(f"WITH {LABELLED} SELECT pid, label AS c0, truth AS c1 FROM labelled")
def label_matrix(spark, sf_dir):
    from punctaria.sources.points import label_matrix as matrix

    p = labelled(spark, sf_dir)
    long = p.select("pid", F.lit("c0").alias("idx"), "label").unionByName(p.select("pid", F.lit("c1").alias("idx"), F.col("truth").alias("label")))
    return matrix(long, ["c0", "c1"])


TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    f"SELECT CAST(row AS INTEGER) AS row, {', '.join(f"max(value) FILTER (event_type = '{t}') AS {t}" for t in TYPES)} "
    "FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS row FROM events) GROUP BY row"
)
def rectangular_export(spark, sf_dir):
    from punctaria.sources.points import rectangular

    return rectangular(table(spark, sf_dir, "events"), "event_type", "value", TYPES)


@query("SELECT CAST(event_id AS VARCHAR) AS \"FileID\", TRY_CAST(CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS \"Points\" FROM events WHERE event_id % 7 <> 0")
def clean_log(spark, sf_dir):
    from punctaria.sources.points import clean_log as clean

    e = table(spark, sf_dir, "events")
    log = e.select(F.when(F.col("event_id") % 7 == 0, F.lit("FileID")).otherwise(F.col("event_id").cast("string")).alias("FileID"), F.when(F.col("event_id") % 10 == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string")).alias("Points"))
    return clean(log)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS top FROM events GROUP BY 1, 2")
def windowed_event_statistics(spark, sf_dir):
    w = windowed_statistics(table(spark, sf_dir, "events"))
    return w.select("start", "event_type", "n", R("mean", 6).alias("mean"), "top")


@query()
def logistic_scores(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("label", (F.col("x") + F.col("y") / 10 > 30).cast("int"))
    return ml.scores(ml.train_linear(p, ["x", "y"]), p).select("pid", R("score", 4).alias("score"), "label_pred")


@query()
def network_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), (F.col("label") < 5).cast("int").alias("label"), "embedding")
    v = ml.with_vector(e, "embedding")
    return ml.scores(ml.train_network(v, 64, epochs=20), v).select("pid", R("score", 4).alias("score"), "label_pred")


@query(f"""
WITH {POINTS},
p AS (SELECT x, y, CAST(x + y / 10 > 30 AS INTEGER) AS label FROM points),
l AS (SELECT slope, off FROM (VALUES (-10e0), (-5e0), (0e0)) a(slope), (VALUES (100e0), (200e0), (300e0)) b(off)),
n AS (
  SELECT slope, off, count(*) FILTER (y > slope * x + off AND label = 1) AS a, count(*) FILTER (y > slope * x + off) AS na,
    count(*) FILTER (NOT y > slope * x + off AND label = 0) AS b, count(*) FILTER (NOT y > slope * x + off) AS nb
  FROM p, l GROUP BY slope, off
)
SELECT slope, off AS "offset", round(coalesce(a / nullif(na, 0), 0) + coalesce(b / nullif(nb, 0), 0), 6) AS purity FROM n ORDER BY coalesce(a / nullif(na, 0), 0) + coalesce(b / nullif(nb, 0), 0) DESC, slope, off LIMIT 1
""")
def boundary_purity(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("label", (F.col("x") + F.col("y") / 10 > 30).cast("int"))
    best = ml.boundary_purity(p, "x", "y", [-10.0, -5.0, 0.0], [100.0, 200.0, 300.0])
    return best.select("slope", "offset", R("purity", 6).alias("purity"))


@query(f"WITH {POINTS}, w AS (SELECT pid, row_number() OVER (ORDER BY x DESC, pid) AS r FROM points) SELECT pid, CAST(r AS INTEGER) AS cluster0 FROM w")
def rank_by_score(spark, sf_dir):
    return ranked(points(spark, sf_dir), F.desc("x"), "pid", name="r").select("pid", (F.col("r") + 1).cast("int").alias("cluster0"))
