"""Pages found in drawn photographs, and the map that sets them upright."""

import numpy as np
from quire.operators import scans

QUADS = {
    1: [(20, 15), (130, 22), (125, 100), (25, 95)], 2: [(30, 10), (110, 30), (95, 105), (18, 85)], 3: [(40, 20), (120, 20), (120, 90), (40, 90)], 4: [(15, 30), (140, 12), (130, 108), (28, 92)],
}


def picture(quad, width=160, height=120, noise=0.0, seed=0):
    """A light page on a dark ground: each pixel's share of the page, from points inside it."""
    q = np.array(quad, float)
    total = np.zeros((height, width))
    steps = (np.arange(4) + 0.5) / 4 - 0.5
    for dx in steps:
        for dy in steps:
            x, y = np.meshgrid(np.arange(width) + dx, np.arange(height) + dy)
            inside = np.ones_like(x, bool)
            for a, b in zip(q, np.roll(q, -1, axis=0), strict=True):
                inside &= (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0
            total += inside / 16
    grey = 40 + 180 * total
    return np.clip(grey + np.random.default_rng(seed).normal(0, noise, grey.shape), 0, 255).astype(int) if noise else grey.astype(int)


def rows(page, grey):
    return [(page, int(x), int(y), int(v)) for (y, x), v in np.ndenumerate(grey)]


def test_corners_within_a_pixel(spark):
    data = [r for page, quad in QUADS.items() for r in rows(page, picture(quad, noise=3.0 if page == 4 else 0.0))] + rows(9, np.full((120, 160), 90))
    got = {r.page: r for r in scans.page_corners(spark.createDataFrame(data, "page int, x int, y int, grey int")).collect()}
    assert set(got) == set(QUADS)
    for page, quad in QUADS.items():
        corners = np.array(got[page].corners)
        assert np.abs(corners - np.array(quad)).max() < 1.0, (page, corners)
        change = np.array(got[page]["map"]).reshape(3, 3)
        flat = np.c_[corners, np.ones(4)] @ change.T
        flat = flat[:, :2] / flat[:, 2:]
        w, h = flat[2]
        assert np.allclose(flat, [(0, 0), (w, 0), (w, h), (0, h)], atol=1e-6) and w > 60 and h > 55


def test_a_page_that_fills_the_picture(spark):
    grey = picture([(-20, -20), (200, -20), (200, 95), (-20, 105)])  # three sides are beyond the picture's: two may be its own
    found = scans.page_corners(spark.createDataFrame(rows(1, grey), "page int, x int, y int, grey int")).collect()
    assert len(found) == 0
    grey = picture([(-20, -20), (130, -20), (125, 95), (-20, 100)])
    corners = np.array(scans.page_corners(spark.createDataFrame(rows(1, grey), "page int, x int, y int, grey int")).first().corners)
    assert np.abs(corners[0]).max() < 1.5 and np.abs(corners[1] - [129.1, 0]).max() < 1.5 and np.abs(corners[3] - [0, 99.3]).max() < 1.5


def test_edges_and_votes_equal_plain_ones(spark):
    grey = picture(QUADS[2], 60, 50, noise=9.0, seed=3)
    df = spark.createDataFrame(rows(5, grey), "page int, x int, y int, grey int")
    g = grey.astype(float)
    gx = (g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[1:-1, :-2] + g[2:, :-2])
    gy = (g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[:-2, 1:-1] + g[:-2, 2:])
    size = np.hypot(gx, gy)
    want, votes = {}, {}
    for (y, x), s in np.ndenumerate(size):
        if s >= 0.25 * size.max():
            want[x + 1, y + 1] = int(np.round(np.degrees(np.arctan2(gy[y, x], gx[y, x])))) % 180
    found = scans.edges(df)
    got = {(r.x, r.y): r.theta for r in found.collect()}
    assert set(got) == set(want) and sum(got[k] != want[k] for k in want) <= 2  # halves round differently
    for (x, y), t in got.items():
        for k in range(t - 2, t + 3):
            a = k % 180 * np.pi / 180
            key = (k % 180, int(np.floor(x * np.cos(a) + y * np.sin(a) + 0.5)))
            votes[key] = votes.get(key, 0) + 1
    counted = {(r.theta, r.rho): r.votes for r in scans.line_votes(found).collect()}
    assert sum(counted.values()) == sum(votes.values()) and sum(counted.get(k) != v for k, v in votes.items()) <= len(votes) // 50


def test_degenerate_corners():
    assert scans.upright(np.array([(0, 0), (1, 1), (2, 2), (0, 5)], float), 10, 10) is None
    same = scans.upright(np.array([(0, 0), (4, 0), (4, 3), (0, 3)], float), 4, 3)
    assert np.allclose(same, np.eye(3))


def test_edges_cross_tiles_and_need_all_neighbours(spark):
    """Gradients at the seams of tiles, also left of and above zero, and around a pixel that is missing."""
    grey = np.random.default_rng(8).integers(0, 256, (140, 70))
    data = [(1, x - 66, y - 66, int(v)) for (y, x), v in np.ndenumerate(grey) if (x, y) != (30, 40)]
    g = grey.astype(float)
    gx = (g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[1:-1, :-2] + g[2:, :-2])
    gy = (g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[:-2, 1:-1] + g[:-2, 2:])
    size = {(x + 1, y + 1): s for (y, x), s in np.ndenumerate(np.hypot(gx, gy)) if max(abs(x + 1 - 30), abs(y + 1 - 40)) != 1}
    made = scans.edges(spark.createDataFrame(data, "page int, x int, y int, grey int"))
    assert {(r.x + 66, r.y + 66) for r in made.collect()} == {k for k, s in size.items() if s >= 0.25 * max(size.values())}
    plan = made._jdf.queryExecution().toString()
    assert "dx" not in plan  # a pixel isn't sent to each of its eight neighbours


def test_a_page_is_found_in_little_time():
    """Corners as they were drawn, at a cost that lets a core solve over 20 pages a second."""
    from time import process_time

    grey = picture(QUADS[2]).astype(float)
    gx = (grey[:-2, 2:] + 2 * grey[1:-1, 2:] + grey[2:, 2:]) - (grey[:-2, :-2] + 2 * grey[1:-1, :-2] + grey[2:, :-2])
    gy = (grey[2:, :-2] + 2 * grey[2:, 1:-1] + grey[2:, 2:]) - (grey[:-2, :-2] + 2 * grey[:-2, 1:-1] + grey[:-2, 2:])
    y, x = np.nonzero(np.hypot(gx, gy) >= 0.25 * np.hypot(gx, gy).max())
    theta = np.round(np.degrees(np.arctan2(gy[y, x], gx[y, x]))).astype(int)[:, None] + np.arange(-2, 3)
    rho = np.round((x + 1)[:, None] * np.cos(np.radians(theta % 180)) + (y + 1)[:, None] * np.sin(np.radians(theta % 180))).astype(int)
    lines, votes = np.unique(np.c_[(theta % 180).ravel(), rho.ravel()], axis=0, return_counts=True)
    points, strongest = np.c_[x + 1, y + 1].astype(float), lines[np.lexsort((lines[:, 1], lines[:, 0], -votes))][:400]
    spent = []
    for _ in range(3):
        start = process_time()
        corners, _ = scans.best_corners(points, strongest, 160, 120)
        spent.append(process_time() - start)
    assert np.abs(corners - np.array(QUADS[2])).max() < 1.0 and min(spent) < 0.1, spent


def test_nothing_is_joined_by_a_guess_of_its_size(spark):
    from test_scale import plan

    df = spark.createDataFrame([r for page in (1, 2) for r in rows(page, picture(QUADS[page]))] + [(None, 1, 1, 9)], "page int, x int, y int, grey int")
    made = scans.page_corners(df)
    assert "Join" not in plan(made) and "Broadcast" not in plan(made)
    assert "Join" not in plan(scans.edges(df, 7)) and scans.edges(df, 7).rdd.getNumPartitions() == 7
    got = {r.page: np.array(r.corners) for r in made.collect()}
    assert set(got) == {1, 2} and all(np.abs(got[page] - QUADS[page]).max() < 1.0 for page in got)
