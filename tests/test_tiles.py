import numpy as np
import pytest

from tracewipe.operators import tiles

SAMPLE = "id int, x int, y int, width int, height int, value double"


def clamped(a, r):
    h, w = a.shape
    p = np.pad(a, r, mode="edge")
    return np.array([[p[y : y + 2 * r + 1, x : x + 2 * r + 1].mean() for x in range(w)] for y in range(h)])


@pytest.mark.parametrize(("radius", "tile"), [(1, 4), (3, 5), (4, 4), (2, 256), (0, 4)])
def test_tiles_equal_the_whole_picture(spark, radius, tile):
    rng = np.random.default_rng(radius)
    pictures = {i: rng.normal(size=s) for i, s in enumerate([(1, 1), (9, 17), (4, 8), (8, 3), (2, 30)])}
    rows = [(i, x, y, a.shape[1], a.shape[0], float(a[y, x])) for i, a in pictures.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    out = tiles.box_blur(spark.createDataFrame([*rows, (0, None, 0, 1, 1, 1.0)], SAMPLE), ["id"], radius, tile).collect()
    assert len(out) == len(rows)
    got = {i: np.full(a.shape, np.nan) for i, a in pictures.items()}
    for r in out:
        got[r.id][r.y, r.x] = r.value
    for i, a in pictures.items():
        assert np.allclose(got[i], clamped(a, radius))


def test_a_radius_beyond_a_tile_is_refused(spark):
    with pytest.raises(ValueError, match="does not fit"):
        tiles.box_blur(spark.createDataFrame([], SAMPLE), ["id"], 9, 8)
