"""Matching in rounds against going through the clusters one by one."""

import random

import pytest

from punctaria.operators import evaluate


def plain(pairs):
    taken, out = {}, set()
    for by, label in sorted({(b, a) for b, a, _, _ in pairs}):
        free = sorted((-n, t) for b, a, t, n in pairs if (b, a) == (by, label) and t not in taken.setdefault(by, set()))
        if free:
            taken[by].add(free[0][1])
            out.add((by, label, free[0][1]))
    return out


def random_pairs(rng, groups, labels, truths, share):
    return [(g, a, t, rng.randint(1, 5)) for g in range(groups) for a in range(labels) for t in range(truths) if rng.random() < share]


@pytest.mark.parametrize("most", [evaluate.TASK_PAIRS, 3])
def test_rounds_give_the_sequential_result(spark, monkeypatch, most):
    monkeypatch.setattr(evaluate, "TASK_PAIRS", most)
    rng = random.Random(most)
    pairs = random_pairs(rng, 3, 25, 20, 0.15) + [(7, 0, t, 2) for t in range(30)] + [(7, a, 29 - a, 1) for a in range(1, 30)]
    pairs += [(8, a, t, 1 + (t == a)) for a in range(12) for t in (a, a + 1)]  # a chain in which each has to wait for the one before
    df = spark.createDataFrame(pairs, "g int, label int, truth int, n long").repartition(5)
    got = {(r["g"], r["label"], r["truth"]) for r in evaluate.matched_in_order(df, ("g",)).collect()}
    assert got == plain(pairs)


def test_no_pairs(spark):
    df = spark.createDataFrame([], "label int, truth int, n long")
    assert evaluate.matched_in_order(df).count() == 0
