"""Scoring of labels against ground truth."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .storage import delete, written

NOISE = -1


def overlap(labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., label, truth, n, n_label, n_truth) for labelled points (label, truth): clusters and reference clusters with common points."""
    good = labels.filter("label >= 0 and truth >= 0").groupBy(*by, "label", "truth").agg(F.count("*").alias("n"))
    sizes = labels.filter("label >= 0").groupBy(*by, "label").agg(F.count("*").alias("n_label"))
    refs = labels.filter("truth >= 0").groupBy(*by, "truth").agg(F.count("*").alias("n_truth"))
    return good.join(sizes, [*by, "label"]).join(refs, [*by, "truth"])


#: Pairs of a group of clusters and reference clusters that hang together which one task may match in order.
TASK_PAIRS = 100_000


def _settled_in_rounds(pairs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round of the matching in order of label: (matches, pairs left), both written.

    A cluster whose first choice no earlier cluster that is still open could take is matched with it. The first open cluster of all is always one of those.
    """
    choice = pairs.groupBy(*keys, "label").agg(F.max(F.struct("n", (-F.col("truth")).alias("less"))).alias("best"))
    choice = choice.select(*keys, "label", (-F.col("best.less")).cast("int").alias("truth"))
    first = pairs.groupBy(*keys, "truth").agg(F.min("label").alias("label"))
    match = written(choice.join(first, [*keys, "truth", "label"], "left_semi").select(*keys, "label", "truth"), "matches")
    left = pairs.join(match.select(*keys, "label"), [*keys, "label"], "left_anti").join(match.select(*keys, "truth"), [*keys, "truth"], "left_anti")
    return match, written(left, "open-pairs")


def _in_order(pdf: pd.DataFrame) -> list[tuple[int, int]]:
    """Matches of a few pairs (label, truth, n) in order of label."""
    taken, out = set(), []
    for label, rows in pdf.sort_values(["label", "n", "truth"], ascending=[True, False, True]).groupby("label", sort=True):
        free = next((t for t in rows["truth"] if t not in taken), None)
        if free is not None:
            taken.add(free)
            out.append((int(label), int(free)))
    return out


def matched_in_order(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., label, truth), written: in order of label each cluster takes, of the reference clusters still free among its ``pairs`` (by..., label, truth, n), the one of largest n, ties the smaller.

    The result is that of going through the clusters one by one, found in rounds: all clusters settle together that no earlier open one can get in the way of. When a round settles less than half of what is open,
    the pairs are split into groups that hang together; groups of up to ``TASK_PAIRS`` pairs are matched in a task each, larger ones go on in rounds, of which there is no fixed number.
    """
    keys = list(by)
    open_pairs = written(pairs.select(*keys, "label", "truth", "n"), "open-pairs")
    found, passed, before = [], [open_pairs], open_pairs.count()
    while before:
        match, left = _settled_in_rounds(open_pairs, keys)
        found.append(match)
        passed += [match, left]
        open_pairs, n = left, left.count()
        if n > before / 2:
            node = lambda side: F.struct(*keys, F.lit(side).alias("side"), F.col(("label", "truth")[side]).alias("id"))
            parts = connected_components(open_pairs.select(node(0).alias("a"), node(1).alias("b")))
            named = open_pairs.withColumn("id", node(0)).join(parts, "id").drop("id")
            size = written(named.groupBy("component").agg(F.count("*").alias("size")), "group-sizes")
            named = written(named.join(size, "component"), "grouped-pairs")
            schema = ", ".join([*(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys), "label int, truth int"])

            def run(pdf: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), *m) for m in _in_order(pdf)], columns=[*keys, "label", "truth"])

            small = written(named.filter(F.col("size") <= TASK_PAIRS).groupBy("component").applyInPandas(run, schema), "matches")
            large = written(named.filter(F.col("size") > TASK_PAIRS).select(*keys, "label", "truth", "n"), "open-pairs")
            found.append(small)
            passed += [parts, size, named, small, large]
            open_pairs, n = large, large.count()
        before = n
    empty = pairs.select(*keys, F.col("label").cast("int").alias("label"), F.col("truth").cast("int").alias("truth")).limit(0)
    out = written(reduce(DataFrame.unionByName, [m.select(*keys, F.col("label").cast("int").alias("label"), "truth") for m in found], empty), "matched")
    delete(*passed)
    return out


def greedy_match(labels: DataFrame, min_overlap: float = 0.3, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., label, truth): each cluster in turn takes, of the reference clusters still free of which it holds more than ``min_overlap``, the one that makes up most of it."""
    return matched_in_order(overlap(labels, by).filter(F.col("n") > min_overlap * F.col("n_truth")), by)


def cluster_evaluation(labels: DataFrame, min_overlap: float = 0.3) -> DataFrame:
    """One row: true_positives, false_positives, false_negatives, n_groundtruth, and the ids of each."""
    match = greedy_match(labels, min_overlap)
    clusters = labels.filter("label >= 0").select("label").distinct().join(match, "label", "left")
    refs = labels.filter("truth >= 0").select("truth").distinct().join(match.withColumnRenamed("label", "by_label"), "truth", "left")
    a = clusters.agg(F.count("truth").alias("true_positives"), F.count_if(F.col("truth").isNull()).alias("false_positives"), F.array_sort(F.collect_list(F.when(F.col("truth").isNotNull(), F.col("label")))).alias("tp_labels"), F.array_sort(F.collect_list(F.when(F.col("truth").isNull(), F.col("label")))).alias("fp_labels"))
    b = refs.agg(F.count_if(F.col("by_label").isNull()).alias("false_negatives"), F.count("*").alias("n_groundtruth"), F.array_sort(F.collect_list(F.when(F.col("by_label").isNull(), F.col("truth")))).alias("fn_truths"))
    return a.join(F.broadcast(b))  # one row each


def point_evaluation(labels: DataFrame) -> DataFrame:
    """One row: points clustered in both, only by the labels, only in the truth."""
    l, t = F.col("label") >= 0, F.col("truth") >= 0
    return labels.agg(F.count_if(l & t).alias("true_positives"), F.count_if(l & ~t).alias("false_positives"), F.count_if(~l & t).alias("false_negatives"))


def subclusters(labels: DataFrame) -> DataFrame:
    """(truth, subclusters): number of clusters in each reference cluster, 0 without any."""
    return labels.filter("truth >= 0").groupBy("truth").agg(F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("subclusters"))


def subcluster_histogram(counts: DataFrame, most: int = 10) -> DataFrame:
    return counts.groupBy(F.least("subclusters", F.lit(most)).alias("subclusters")).agg(F.count("*").alias("n"))


def overlap_sweep(labels: DataFrame, ratios: list[float]) -> DataFrame:
    """(ratio, true_positives_ratio, false_positives_ratio): greedy matching at each minimal overlap, all ratios in the same rounds."""
    spark = labels.sparkSession
    grid = spark.createDataFrame([(float(r),) for r in ratios], "ratio double")
    pairs = overlap(labels).join(F.broadcast(grid), F.col("n") > F.col("ratio") * F.col("n_truth"))  # the caller's list
    found = matched_in_order(pairs, ("ratio",)).groupBy("ratio").agg(F.count("*").alias("tp"))
    n = labels.agg(F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("k"), F.countDistinct(F.when(F.col("truth") >= 0, F.col("truth"))).alias("g"))
    out = grid.join(found, "ratio", "left").na.fill(0, ["tp"]).join(F.broadcast(n))
    return out.select("ratio", F.try_divide("tp", "g").alias("true_positives_ratio"), F.try_divide(F.col("k") - F.col("tp"), F.col("g")).alias("false_positives_ratio"))


def confusion(df: DataFrame, truth: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Two-class counts, recall of each class and accuracy; null where a class is empty."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    n = df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    return n.select(*by, "tp", "fp", "fn", "tn", F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall_1"), F.try_divide("tn", F.col("tn") + F.col("fp")).alias("recall_0"), F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"))


def pooled_confusion(df: DataFrame, truth: str, predicted: str, by: str) -> DataFrame:
    """``confusion`` of each group and, with a null group, of all rows."""
    whole = confusion(df, truth, predicted)
    return confusion(df, truth, predicted, (by,)).unionByName(whole.select(F.lit(None).cast(df.schema[by].dataType).alias(by), "*"))


def confusion_shares(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, share): rows of a confusion matrix as shares."""
    n = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return n.select("truth", "predicted", (F.col("n") / F.sum("n").over(Window.partitionBy("truth"))).alias("share"))


def class_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: weighted F1, macro precision and macro recall."""
    n = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    tp = n.filter("t = p").select(F.col("t").alias("c"), F.col("n").alias("tp"))
    support = n.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("support"))
    guessed = n.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("guessed"))
    per = support.join(guessed, "c", "full").join(tp, "c", "left").na.fill(0)
    precision = F.coalesce(F.try_divide("tp", "guessed"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return per.agg((F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1_weighted"), F.avg(precision).alias("precision_macro"), F.avg(recall).alias("recall_macro"))


def f1_by_cell(assignment: DataFrame, truth: DataFrame) -> DataFrame:
    """(idx, f1) of points clustered or not."""
    j = assignment.join(truth, "pid")
    l, t = F.col("label") >= 0, F.col("truth") >= 0
    n = j.groupBy("idx").agg(F.count_if(l & t).alias("tp"), F.count_if(l & ~t).alias("fp"), F.count_if(~l & t).alias("fn"))
    return n.select("idx", F.try_divide("tp", F.col("tp") + 0.5 * (F.col("fp") + F.col("fn"))).alias("f1"))
