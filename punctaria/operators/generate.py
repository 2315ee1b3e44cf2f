"""Synthetic point patterns with ground truth, scenario grids, and regions.

Random numbers are hashes of ids and a seed, so a pattern is the same on any cluster and whatever the partitions.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stats import diameters
from .storage import delete


def uniform(*keys) -> Column:
    """A number in [0, 1) from keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / float(1 << 53)


def normal(*keys) -> Column:
    """A standard normal number from keys (Box-Muller)."""
    u = F.greatest(uniform(*keys, F.lit("u")), F.lit(1e-300))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(*keys, F.lit("v")))


def prepared_templates(templates: DataFrame, scale: float = 158.0) -> DataFrame:
    """Template points (tid, pid, x, y) about their mean, in nanometres."""
    from .filters import centred

    return centred(templates, "tid", scale)


def typical_diameter(templates: DataFrame) -> float:
    """Largest diameter of the library."""
    return float(diameters(templates, "tid").agg(F.max("diameter")).first()[0])


def mean_population(templates: DataFrame) -> float:
    return float(templates.groupBy("tid").count().agg(F.avg("count")).first()[0])


def _with_noise(points: DataFrame, n_noise: int, seed: int) -> DataFrame:
    """(pid, x, y, truth): the points and uniform noise, truth -1, in their bounding box."""
    spark = points.sparkSession
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max("pid").alias("last"))
    noise = spark.range(n_noise).join(F.broadcast(box)).select((F.col("last") + 1 + F.col("id")).alias("pid"), (F.col("x0") + (F.col("x1") - F.col("x0")) * uniform("id", F.lit(seed), F.lit("nx"))).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * uniform("id", F.lit(seed), F.lit("ny"))).alias("y"), F.lit(-1).alias("truth"))
    return points.select("pid", "x", "y", "truth").unionByName(noise)


def _numbered(placed: DataFrame) -> DataFrame:
    """A pid from the cluster's number and the point's own, by offsets of one row for each cluster."""
    sizes = placed.groupBy("truth").agg((F.max("at") + 1).alias("n"))
    before = sizes.select("truth", (F.sum("n").over(Window.orderBy("truth")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "truth").select((F.col("before") + F.col("at")).alias("pid"), "x", "y", "truth")


def _apart(p, q, d: float) -> bool | None:
    """Whether no point of a template is within d of one of another, by the corners (n, 2) of both outlines: corners are points, and no point lies outside. None if that leaves it open."""
    import numpy as np

    gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
    if (gap**2).sum() > d * d:
        return True
    if any(((c - q) ** 2).sum(1).min() <= d * d for c in p):
        return False
    # Outlines that are apart come nearest at a corner of one of them.
    def least(corners, ring):
        along = np.roll(ring, -1, 0) - ring
        t = np.clip(((corners[:, None] - ring[None]) * along[None]).sum(2) / np.maximum((along**2).sum(1), 1e-300), 0, 1)
        return ((corners[:, None] - ring[None] - t[..., None] * along[None]) ** 2).sum(2).min()

    # Of two convex outlines the sides of one tell them apart, unless they meet.
    def parted(a, b):
        side = np.roll(a, -1, 0) - a
        normal = np.stack([side[:, 1], -side[:, 0]], 1)
        return ((normal @ b.T).min(1) > (normal * a).sum(1)).any()

    if len(p) > 2 and len(q) > 2 and (parted(p, q) or parted(q, p)) and min(least(p, q), least(q, p)) > d * d * (1 + 1e-9):
        return True
    return None


def _points_apart(templates: DataFrame, one: tuple, other: tuple, d: float) -> bool:
    """Whether no point of a template (tid, x, y of its place) is within d of one of another, by the nearest neighbours of all that can be."""
    from .spatial import knn

    def moved(placed, odd: int):
        tid, x, y = placed
        return templates.filter(F.col("tid") == tid).select((F.col("pid") * 2 + odd).alias("pid"), (F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"))

    left, right = moved(one, 0), moved(other, 1)
    box = right.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max)))).first()
    for c in ("x", "y"):
        left = left.filter(F.col(c).between(box[f"lo_{c}"] - d * 1.001, box[f"hi_{c}"] + d * 1.001))
    near = knn(left, 1, targets=right)
    least = near.agg(F.min("dist")).first()[0]
    delete(near)
    return least is None or least > d


def geometry_free(templates: DataFrame, noise_ratio: float = 0.0, seed: int = 0) -> DataFrame:
    """Every template once, at random places in a box of side 3 D sqrt(n), no two nearer than D, with noise.

    Placement is sequential and has one row for each template, so the driver does it, with the corners of the templates' outlines. Where these leave open whether two are apart, Spark looks at their points.
    """
    import numpy as np

    from .spatial import convex_hulls

    spark = templates.sparkSession
    d = typical_diameter(templates)
    outlines = {r["tid"]: np.array([(p["x"], p["y"]) for p in r["ring"]]) for r in convex_hulls(templates, "tid").collect()}
    rng, side, placed = np.random.default_rng(seed), math.sqrt(len(outlines)) * d * 3, []
    centres = []
    for k, (tid, pts) in enumerate(sorted(outlines.items())):
        while True:
            at = rng.uniform(0, side, 2)
            mine = pts + at
            told = [_apart(mine, other, d) for other in placed]
            if False not in told and all(t or _points_apart(templates, (tid, *map(float, at)), centres[i][:1] + centres[i][2:], d) for i, t in enumerate(told)):
                break
        placed.append(mine)
        centres.append((int(tid), k, float(at[0]), float(at[1])))
    table = spark.createDataFrame(centres, "tid int, truth int, cx double, cy double")
    out = templates.withColumn("tid", F.col("tid").cast("int")).join(F.broadcast(table), "tid").withColumn("at", F.row_number().over(Window.partitionBy("truth").orderBy("pid")) - 1).select("truth", "at", (F.col("x") + F.col("cx")).alias("x"), (F.col("y") + F.col("cy")).alias("y"))
    points = _numbered(out)
    return _with_noise(points, int(noise_ratio * templates.count()), seed)


def geometry_grid(templates: DataFrame, n_side: int, delta_ratio: float = 1.0, noise_ratio: float = 0.0, seed: int = 0) -> DataFrame:
    """n_side^2 random templates on a grid of spacing ``delta_ratio`` D, with noise."""
    spark = templates.sparkSession
    d = typical_diameter(templates)
    ids = [r["tid"] for r in templates.select("tid").distinct().orderBy("tid").collect()]  # one row for each template
    pick = F.element_at(F.array(*map(F.lit, ids)), (F.floor(uniform("id", F.lit(seed)) * len(ids)) + 1).cast("int"))
    cells = spark.range(n_side * n_side).select(F.col("id").cast("int").alias("truth"), pick.alias("tid"), (F.floor(F.col("id") / n_side) * delta_ratio * d).alias("cx"), ((F.col("id") % n_side) * delta_ratio * d).alias("cy"))
    out = cells.join(templates, "tid").withColumn("at", F.row_number().over(Window.partitionBy("truth").orderBy("pid")) - 1).select("truth", "at", (F.col("x") + F.col("cx")).alias("x"), (F.col("y") + F.col("cy")).alias("y"))
    points = _numbered(out)
    n = points.count() if noise_ratio else 0
    return _with_noise(points, int(noise_ratio * n), seed)


def geometry_path(templates: DataFrame, n_clusters: int, n_noise: int, seed: int = 0) -> DataFrame:
    """Templates and noise along a sine with normal scatter across it, in units of D."""
    spark = templates.sparkSession
    d = typical_diameter(templates)
    ids = [r["tid"] for r in templates.select("tid").distinct().orderBy("tid").collect()]
    pick = F.element_at(F.array(*map(F.lit, ids)), (F.floor(uniform("id", F.lit(seed), F.lit("t")) * len(ids)) + 1).cast("int"))

    def along(what: str):
        x = uniform("id", F.lit(seed), F.lit(what)) * 20
        return x * d, (2 * F.sin(2 * 3.14 * x / 20) + normal("id", F.lit(seed), F.lit(what))) * d

    cx, cy = along("c")
    cells = spark.range(n_clusters).select(F.col("id").cast("int").alias("truth"), pick.alias("tid"), cx.alias("cx"), cy.alias("cy"))
    out = cells.join(templates, "tid").withColumn("at", F.row_number().over(Window.partitionBy("truth").orderBy("pid")) - 1).select("truth", "at", (F.col("x") + F.col("cx")).alias("x"), (F.col("y") + F.col("cy")).alias("y"))
    points = _numbered(out)
    nx, ny = along("n")
    last = points.agg(F.max("pid").alias("last"))
    noise = spark.range(n_noise).join(F.broadcast(last)).select((F.col("last") + 1 + F.col("id")).alias("pid"), nx.alias("x"), ny.alias("y"), F.lit(-1).alias("truth"))
    return points.unionByName(noise)


def overlay(inside: DataFrame, outside: DataFrame, seed: int = 0) -> DataFrame:
    """Out-cell tiles laid over one another until their density is that of the in-cell points; half of them with swapped axes."""
    from .stats import density

    ratio = density(inside).first()[0] / density(outside).first()[0]
    nx = max(1, round(math.sqrt(ratio)))
    ny = max(1, round(ratio / nx))
    b = outside.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    p = outside.join(F.broadcast(b))
    wx, wy = (F.col("x1") - F.col("x0")) / nx, (F.col("y1") - F.col("y0")) / ny
    ix = F.least(F.floor((F.col("x") - F.col("x0")) / wx), F.lit(nx - 1))
    iy = F.least(F.floor((F.col("y") - F.col("y0")) / wy), F.lit(ny - 1))
    px, py = F.col("x") - F.col("x0") - ix * wx, F.col("y") - F.col("y0") - iy * wy
    swap = uniform(ix, iy, F.lit(seed)) > 0.5
    return p.select("pid", F.when(swap, py).otherwise(px).alias("x"), F.when(swap, px).otherwise(py).alias("y"))


def scenarios(spark: SparkSession, values: dict[str, list[float]]) -> DataFrame:
    """Cross product of named parameter values, sc from 0. As many rows as the caller's lists span."""
    names = list(values)
    rows = [(i, *map(float, row)) for i, row in enumerate(itertools.product(*values.values()))]
    return spark.createDataFrame(rows, ", ".join(["sc int", *(f"{n} double" for n in names)]))


def scenario_densities(grid: DataFrame) -> DataFrame:
    """Derived columns for scenarios (points, share_clustered, per_cluster, radius, side): clusters, areas, densities in and out, their ratio."""
    clusters = F.floor(F.col("points") * F.col("share_clustered") / F.col("per_cluster"))
    area = math.pi * F.col("radius") * F.col("radius") * F.col("clusters")
    whole = F.col("side") * F.col("side")
    out = grid.withColumn("clusters", clusters).withColumn("clustered_area", area).withColumn("cpm", F.try_divide("clusters", whole * 1e-6))
    out = out.withColumn("density_in", F.try_divide(F.col("clusters") * F.col("per_cluster"), F.nullif(F.col("clustered_area"), F.lit(0.0))))
    out = out.withColumn("density_out", F.try_divide(F.col("points") - F.col("clusters") * F.col("per_cluster"), F.nullif(whole - F.col("clustered_area"), F.lit(0.0))))
    return out.withColumn("density_ratio", F.try_divide("density_in", F.nullif(F.col("density_out"), F.lit(0.0))))


def valid_scenarios(grid: DataFrame, cpm: tuple[float, float], ratio: tuple[float, float]) -> DataFrame:
    """Scenarios whose clusters fit and whose numbers lie strictly within the limits; where the grid has radius_min and radius_max, the first has to be smaller."""
    d = scenario_densities(grid)
    if {"radius_min", "radius_max"} <= set(grid.columns):
        d = d.filter(F.col("radius_min") < F.col("radius_max"))
    return d.filter((F.col("clustered_area") < F.col("side") * F.col("side")) & (F.col("cpm") > cpm[0]) & (F.col("cpm") < cpm[1]) & (F.col("density_ratio") > ratio[0]) & (F.col("density_ratio") < ratio[1]))


def simulated_cells(grid: DataFrame, replicates: int, gaussian: bool = False, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """(sc, rep, x, y, cluster, label) for scenarios (sc, points, share_clustered, per_cluster, radius, side): clusters spaced by 2.2 radii and points outside them.

    Cluster centres take the free places of a jittered grid in hashed order, so that spacing needs no sequential search.
    """
    d = scenario_densities(grid)
    reps = d.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    step = F.col("radius") * 2.2
    n_side = F.floor(F.col("side") / step).cast("int")
    places = reps.filter(n_side > 0).withColumn("n_side", n_side).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("n_side") * F.col("n_side") - 1)))
    order = Window.partitionBy("sc", "rep").orderBy(F.xxhash64("sc", "rep", "place", F.lit(seed)))
    centres = places.withColumn("cluster", F.row_number().over(order)).filter(F.col("cluster") <= F.col("clusters"))
    centres = centres.withColumn("cx", (F.col("place") % F.col("n_side") + 0.5) * step).withColumn("cy", (F.floor(F.col("place") / F.col("n_side")) + 0.5) * step)
    members = centres.filter("per_cluster >= 1").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("per_cluster").cast("int"))))
    keys = ("sc", "rep", "cluster", "i", F.lit(seed))
    if gaussian:
        dx, dy = normal(*keys, F.lit("x")) * F.col("radius") / 2, normal(*keys, F.lit("y")) * F.col("radius") / 2
    else:
        r, a = F.sqrt(uniform(*keys, F.lit("r"))) * F.col("radius"), uniform(*keys, F.lit("a")) * 2 * math.pi
        dx, dy = r * F.cos(a), r * F.sin(a)
    noise = lambda c: normal(*keys, F.lit(c)) * jitter
    inside = members.select("sc", "rep", (F.col("cx") + dx + noise("jx")).alias("x"), (F.col("cy") + dy + noise("jy")).alias("y"), "cluster", F.lit(1).alias("label"))
    free = (F.col("points") - F.col("clusters") * F.col("per_cluster")).cast("int")
    others = reps.filter(free > 0).withColumn("i", F.explode(F.sequence(F.lit(1), free)))
    at = ("sc", "rep", "i", F.lit(seed), F.lit("free"))
    others = others.select("sc", "rep", "radius", (uniform(*at, F.lit("x")) * F.col("side")).alias("x"), (uniform(*at, F.lit("y")) * F.col("side")).alias("y"), F.monotonically_increasing_id().alias("__i"))
    # Those that fall into a cluster go: one grid cell holds at most one centre.
    cell = centres.select("sc", "rep", F.floor(F.col("cx") / step).alias("gx"), F.floor(F.col("cy") / step).alias("gy"), "cx", "cy")
    placed = others.withColumn("gx", F.floor(F.col("x") / step)).withColumn("gy", F.floor(F.col("y") / step)).join(cell, ["sc", "rep", "gx", "gy"], "left")
    far = F.col("cx").isNull() | ((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) > F.col("radius") * F.col("radius"))
    return inside.unionByName(placed.filter(far).select("sc", "rep", "x", "y", F.lit(0).alias("cluster"), F.lit(0).alias("label")))


def sprinkled(spark: SparkSession, ring: list[tuple[float, float]], n: int, seed: int = 0, fuzz: float = 0.0, spacing: float = 0.0) -> DataFrame:
    """(pid, x, y): n points of complete spatial randomness in a polygon, distinct ones, fewer only if the polygon has no area.

    Candidates are uniform in the bounding box, by hashes of their number, a few rounds more of them than the areas' ratio asks for; those inside the polygon are numbered and the first n taken. ``fuzz`` then moves
    each by a normal step of that size. With ``spacing``, a candidate with a smaller number within it is passed over, so there may be fewer than n.
    """
    from .ranks import ranked
    from .spatial import in_ring, range_pairs

    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    x0, y0, w, h = min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)
    closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    area = abs(sum(a * d - c * b for (a, b), (c, d) in zip(closed, closed[1:], strict=False))) / 2
    if not area:
        return spark.createDataFrame([], "pid long, x double, y double")
    tries = int(n * w * h / area * 1.2 + 50 + 6 * math.sqrt(n * w * h / area))
    made = spark.range(tries).select("id", (F.lit(x0) + uniform("id", F.lit(seed), F.lit("x")) * w).alias("x"), (F.lit(y0) + uniform("id", F.lit(seed), F.lit("y")) * h).alias("y"))
    inside = made.filter(in_ring(F.col("x"), F.col("y"), ring)).groupBy("x", "y").agg(F.min("id").alias("pid"))
    if spacing > 0:
        crowd = range_pairs(inside, inside, spacing).filter("p > q").select(F.col("p").alias("pid")).distinct()
        inside = inside.join(crowd, "pid", "left_anti")
    out = ranked(inside, "pid", name="n").filter(F.col("n") < n)
    step = lambda c: F.col(c) + normal("n", F.lit(seed), F.lit(c)) * fuzz if fuzz else F.col(c)
    return out.select(F.col("n").alias("pid"), step("x").alias("x"), step("y").alias("y"))


def depleted(points: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """Points without those within a radius of a centre."""
    from .spatial import far_from

    return far_from(points, centres, radius)


def spaced_seeds(spark: SparkSession, ring: list[tuple[float, float]], n: int, radius: float, seed: int = 0) -> DataFrame:
    """(pid, x, y): cluster centres in a polygon, 2.2 radii or more from one another."""
    return sprinkled(spark, ring, n, seed, spacing=2.2 * radius)


def ground_truth(cells: DataFrame) -> DataFrame:
    """Counts for each scenario and replicate."""
    return cells.groupBy("sc", "rep").agg(F.count("*").alias("points"), F.count_if(F.col("label") == 1).alias("clustered"), F.countDistinct(F.when(F.col("label") == 1, F.col("cluster"))).alias("clusters"), F.try_divide(F.count_if(F.col("label") == 1), F.count("*")).alias("share_clustered"))


def truth_table(cells: DataFrame, grid: DataFrame, cell_area: float | None = None) -> DataFrame:
    """The 16 numbers of each simulated cell: what its scenario (sc, points, share_clustered, per_cluster, radius, side) asked for and what it got. Lengths in nanometres, areas in square micrometres; ``cell_area`` is
    that of the cell, the whole image without it."""
    d = scenario_densities(grid)
    whole = F.col("side") * F.col("side") * 1e-6
    area = whole if cell_area is None else F.lit(float(cell_area))
    asked = d.select(
        "sc", (F.col("points") / whole).alias("points_per_um2"), F.col("per_cluster").alias("points_per_cluster"), (F.col("share_clustered") * 100).alias("percent_clustered_target"),
        F.col("radius").alias("radius_min"), F.col("radius").alias("radius_max"), (F.col("clusters") / whole).alias("clusters_per_um2"), area.alias("cell_area_um2"), whole.alias("__whole"),
    )
    got = ground_truth(cells).withColumnRenamed("points", "total_points")
    j = asked.join(got, "sc")
    return j.select(
        F.col("sc").alias("file_uid"), "points_per_um2", "points_per_cluster", "percent_clustered_target", "radius_min", "radius_max", "clusters_per_um2", F.col("rep").alias("cell_repeat"),
        F.col("clusters").alias("cluster_count"), (F.col("clusters") / F.col("cell_area_um2")).alias("clusters_per_um2_actual"), (F.col("share_clustered") * 100).alias("percent_clustered"), "total_points",
        F.col("clustered").alias("total_clustered_points"), "cell_area_um2", (F.col("total_points") / F.col("cell_area_um2")).alias("points_per_um2_in_roi"), (F.col("total_points") / F.col("__whole")).alias("points_per_um2_in_image"),
    )


def cell_outline(seed: int = 0, knots: int = 50, size: float = 20.0, points: int = 400) -> list[tuple[float, float]]:
    """A closed smooth outline through random radii: periodic cubic interpolation between them."""
    import numpy as np

    r = np.random.default_rng(seed).uniform(0.8, 1.2, knots)
    t = np.arange(points) * knots / points
    i, f = t.astype(int), t % 1
    p = [r[(i + k) % knots] for k in (-1, 0, 1, 2)]
    radius = p[1] + 0.5 * f * (p[2] - p[0] + f * (2 * p[0] - 5 * p[1] + 4 * p[2] - p[3] + f * (3 * (p[1] - p[2]) + p[3] - p[0])))
    a = 2 * np.pi * t / knots
    ring = [(float(x), float(y)) for x, y in zip(size * radius * np.cos(a), size * radius * np.sin(a), strict=True)]
    return [*ring, ring[0]]


def square_rois(centre: tuple[float, float], widths: list[float]) -> list[list[tuple[float, float]]]:
    """Closed squares about a centre."""
    x, y = centre
    return [[(x - w / 2, y - w / 2), (x + w / 2, y - w / 2), (x + w / 2, y + w / 2), (x - w / 2, y + w / 2), (x - w / 2, y - w / 2)] for w in widths]


def full_field_roi(bounds: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    x0, x1, y0, y1 = bounds
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
