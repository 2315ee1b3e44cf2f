"""Image operators in tiles and rows against whole arrays."""

import numpy as np
import pytest

from punctaria.operators import image


def table(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in np.argwhere(a)], "ix int, iy int, v double")


def array(df, shape, x="ix", y="iy"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[r[x], r[y]])
        out[r[x], r[y]] = r["v"]
    return out


def blurred(a, sigma):
    kernel = image._kernel(sigma)
    r = len(kernel) // 2
    for axis in (0, 1):
        padded = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        a = sum(w * np.take(padded, np.arange(i, i + a.shape[axis]), axis=axis) for i, w in enumerate(kernel))
    return a


@pytest.mark.parametrize("shape, sigma, tile", [((40, 23), 1.0, 9), ((40, 23), 2.0, 1), ((7, 50), 3.0, 10), ((30, 30), 1.5, 1024)])
def test_tiles_blur_like_the_whole_image(spark, monkeypatch, shape, sigma, tile):
    monkeypatch.setattr(image, "TILE", tile)
    rng = np.random.default_rng(1)
    a = np.where(rng.random(shape) < 0.1, rng.integers(1, 9, shape), 0).astype(float)
    assert np.array_equal(array(image.gaussian(table(spark, a), *shape, sigma), shape), blurred(a, sigma))
    assert np.array_equal(array(image.gaussian(table(spark, a * 0), *shape, sigma), shape), a * 0)


def test_autocorrelation_by_rows_and_columns(spark):
    rng = np.random.default_rng(2)
    a = np.where(rng.random((13, 8)) < 0.3, rng.integers(1, 5, (13, 8)), 0).astype(float)
    plain = np.array([[(a * np.roll(a, (-dx, -dy), (0, 1))).sum() for dy in range(8)] for dx in range(13)]) / (a.mean() ** 2 * a.size)
    assert array(image.autocorrelation(table(spark, a), 13, 8), (13, 8), "dx", "dy") == pytest.approx(plain)


def test_quantile_of_all_pixels(spark):
    a = np.array([[5.0, 1, 0, 0], [3, 0, 9, 0]])
    for q in (0.0, 0.3, 0.45, 0.55, 0.6, 0.8, 0.95, 1.0):
        got = {(r["ix"], r["iy"]): r["v"] for r in image.clip_at_quantile(table(spark, a), q, nonzero_only=False, n_pixels=8).collect()}
        cut = np.quantile(a, q)
        assert got == pytest.approx({(i, j): min(a[i, j], cut) for i, j in np.argwhere(a)})
