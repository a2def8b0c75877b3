"""Kernels by closed forms, and by slow loops over random images."""

import math

import numpy as np
import pytest

from tessera.functions import kernels as K

RNG = np.random.default_rng(7)


def mirror(i, n):
    if n == 1:
        return 0
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i


def slow_filter(img, kernel, edge=False):
    h, w = img.shape
    k = len(kernel) // 2
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            for dy in range(-k, k + 1):
                for dx in range(-k, k + 1):
                    at = (lambda i, n: min(max(i, 0), n - 1)) if edge else mirror
                    out[y, x] += kernel[dy + k][dx + k] * img[at(y + dy, h), at(x + dx, w)]
    return out


@pytest.mark.parametrize("shape", [(1, 1), (1, 5), (2, 2), (3, 4), (9, 7)])
def test_filters_equal_loops(shape):
    img = RNG.integers(0, 256, shape).astype(float)
    assert np.allclose(K.laplacian(img), slow_filter(img, [[2, 0, 2], [0, -8, 0], [2, 0, 2]]))
    assert np.allclose(K.sobel(img, 1, 0), slow_filter(img, [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]))
    assert np.allclose(K.sobel(img, 0, 1, K.EDGE), slow_filter(img, [[-1, -2, -1], [0, 0, 0], [1, 2, 1]], True))
    assert np.allclose(K.sobel(img, 1, 1), slow_filter(img, [[1, 0, -1], [0, 0, 0], [-1, 0, 1]]))
    taps = K.gaussian_taps(1.2, 9)
    assert np.allclose(K.gaussian(img, 1.2, 9), slow_filter(img, np.outer(taps, taps)))


def test_flat_images():
    mid = np.full((64, 64), 128, np.uint8)
    assert K.mean_abs_laplacian(mid / 255) == 0
    assert K.illumination_unevenness(mid / 255) == pytest.approx(0)
    assert K.directional_loss(mid / 255) == 1
    assert K.orientation_concentration(mid / 255) == pytest.approx(1)
    assert set(np.unique(K.binary_patterns(mid))) == {255}
    white, black = np.full((8, 8), 255, np.uint8), np.zeros((8, 8), np.uint8)
    assert K.exposure(white / 255) == pytest.approx((1, 0.1, 0, 0))
    assert K.exposure(black / 255) == pytest.approx((0, 0, 1, 0.05))
    assert K.orientation_concentration(white / 255) == 0


def test_brightness_limits_are_whole_levels():
    levels = np.arange(256, dtype=np.uint8)[None]
    over, _, under, _ = K.exposure(levels / 255)
    assert over * 256 == 256 - 230 and under * 256 == 13


def test_impulse_and_tiny_images():
    img = np.zeros((7, 7))
    img[3, 3] = 1
    assert K.laplacian(img)[2:5, 2:5].tolist() == [[2, 0, 2], [0, -8, 0], [2, 0, 2]]
    for shape in ((2, 2), (1, 5), (1, 1)):
        tiny = np.full(shape, 9, np.uint8)
        assert K.texture_histogram(tiny)[0] == 1 and K.blockiness(tiny) == 0
        K.edge_density(tiny)
        K.residual_energy(tiny)
        assert math.isnan(K.self_dissimilarity(tiny, 0, 0))


def test_blocks():
    tile = np.kron(np.indices((4, 4)).sum(0) % 2, np.ones((8, 8))) * 100
    assert K.blockiness(tile.astype(np.uint8)) == 100
    assert K.blockiness(np.zeros((32, 32), np.uint8)) == 0


def test_patterns_equal_loops():
    g = RNG.integers(0, 4, (6, 7)).astype(np.uint8)
    want = np.zeros((4, 5), int)
    ring = [(-1, -1, 128), (-1, 0, 64), (-1, 1, 32), (0, 1, 16), (1, 1, 8), (1, 0, 4), (1, -1, 2), (0, -1, 1)]
    for y in range(4):
        for x in range(5):
            want[y, x] = sum(k for dy, dx, k in ring if g[y + 1 + dy, x + 1 + dx] >= g[y + 1, x + 1])
    assert (K.binary_patterns(g) == want).all()


@pytest.mark.parametrize(("shape", "patch", "radius", "margin"), [((40, 33), 8, 6, 2), ((24, 60), 7, 9, 1), ((21, 20), 6, 30, 3)])
def test_best_matches_equal_loops(shape, patch, radius, margin):
    img = RNG.integers(0, 256, shape)
    img[: shape[0] // 2, : shape[1] // 2] = 9  # no variance
    h, w = shape
    half = patch // 2
    centres = np.array([(half, half), (w // 2, h // 2), (w - half - 1, h - half - 1), (w - 6, 8), (0, 0), (w - 1, h // 2)])
    want = []
    for x, y in centres:
        here = img[y - half : y - half + patch, x - half : x - half + patch].astype(float) if min(x, y) >= half else np.zeros((0, 0))
        rows = range(max(0, y - radius - half), min(h, y + radius + half) - patch + 1)
        cols = range(max(0, x - radius - half), min(w, x + radius + half) - patch + 1)
        best = -1.0
        if here.shape != (patch, patch) or min(len(rows), len(cols)) < 3:
            want.append(0.0)
            continue
        here = here - here.mean()
        for top in rows:
            for left in cols:
                if max(abs(top - y + half), abs(left - x + half)) > margin:
                    there = img[top : top + patch, left : left + patch] - img[top : top + patch, left : left + patch].mean()
                    size = (here**2).sum() * (there**2).sum()
                    best = max(best, 1.0 if not here.any() else (here * there).sum() / math.sqrt(size) if there.any() else 0.0)
        want.append(np.clip((best + 1) / 2, 0, 1))
    assert np.allclose(K.best_matches(img, centres, patch, radius, margin), want)


def test_repeating_texture_matches_itself():
    tile = RNG.integers(0, 256, (20, 20))
    img = np.tile(tile, (10, 10)).astype(np.uint8)
    assert K.self_dissimilarity(img, 1, 0, n=8) == pytest.approx(0, abs=1e-6)
    assert K.self_dissimilarity(RNG.integers(0, 256, (200, 200)).astype(np.uint8), 1, 0, n=8) > 0.3


def test_edges():
    img = np.zeros((20, 20), np.uint8)
    img[:, 10:] = 255
    edges = K.edge_map(img)
    assert edges.any(1).all() and edges.sum() == 20
    assert not K.edge_map(np.full((9, 9), 7, np.uint8)).any()


def test_resizing():
    ramp = np.tile(np.arange(8.0), (8, 1))
    assert np.allclose(K.resize_linear(ramp, 8, 8), ramp)
    assert K.down_and_up(ramp).shape == (8, 8)
    big = np.full((1280, 700, 3), 77, np.uint8)
    small = K.shrink_to(big)
    assert small.shape == (640, 350, 3) and (small == 77).all()
    assert K.shrink_to(ramp.astype(np.uint8)) is not None
    assert np.allclose(K.area_weights(7, 3).sum(1), 1)


def test_lab_of_known_colours():
    bgr = np.array([[[255, 255, 255], [0, 0, 0], [0, 0, 255]]], np.uint8)
    white, black, red = K.lab_of(bgr)[0].tolist()
    assert white == [255, 128, 128] and black == [0, 128, 128]
    assert red == pytest.approx([136, 208, 195], abs=1)


def test_ring_share():
    assert K.ring_low_share(np.zeros((30, 30))) == 1
    noise = RNG.random((40, 40))
    assert K.ring_low_share(noise) == pytest.approx(0.30, abs=0.02)
    assert 0 <= K.ring_low_share(RNG.random((3, 3))) <= 1


def test_direction_of_stripes():
    x = np.sin(np.arange(64) / 2)[None].repeat(64, 0) * 0.3 + 0.5
    assert min(K.dominant_orientation(x), 180 - K.dominant_orientation(x)) < 1
    assert K.dominant_orientation(x.T) == pytest.approx(90, abs=1)
    assert K.directional_loss(x) > 0.9
    assert K.orientation_concentration(x) > K.orientation_concentration(np.clip(RNG.random((64, 64)), 0.1, 0.8))
