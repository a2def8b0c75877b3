"""Pixel kernels on numpy arrays; one image in, numbers or one array out.

Filters follow the conventions that image libraries share: odd kernels, borders mirrored without repeating
the edge sample, unnormalised 3-tap derivatives. Intermediate values are doubles.
"""

from __future__ import annotations

import math

import numpy as np

EPS = 1e-12
SMOOTH3, DIFF3, SECOND3 = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0]), np.array([1.0, -2.0, 1.0])
#: Border modes by their numpy names.
MIRROR, EDGE = "reflect", "edge"


def pad(img: np.ndarray, by: int, mode: str = MIRROR) -> np.ndarray:
    """Borders of `by` samples; mirrored as often as a small image needs, a side of one sample is repeated."""
    for axis in (0, 1):
        n = img.shape[axis]
        at = np.arange(-by, n + by)
        if mode == EDGE or n == 1:
            at = np.clip(at, 0, n - 1)
        else:
            at = np.abs((at + n - 1) % (2 * n - 2) - (n - 1))
        img = img.take(at, axis)
    return img


def separable(img: np.ndarray, across: np.ndarray, down: np.ndarray, mode: str = MIRROR) -> np.ndarray:
    """Correlation with the outer product of two odd kernels of one length."""
    by = len(across) // 2
    p = pad(img.astype(np.float64), by, mode)
    h, w = img.shape
    rows = sum(k * p[:, i : i + w] for i, k in enumerate(across) if k)
    return sum(k * rows[i : i + h] for i, k in enumerate(down) if k)


def sobel(img: np.ndarray, dx: int, dy: int, mode: str = MIRROR) -> np.ndarray:
    taps = {0: SMOOTH3, 1: DIFF3, 2: SECOND3}
    return separable(img, taps[dx], taps[dy], mode)


def laplacian(img: np.ndarray) -> np.ndarray:
    """The 3 by 3 Laplacian with twos in the corners and minus eight in the middle."""
    return separable(img, SECOND3, SMOOTH3) + separable(img, SMOOTH3, SECOND3)


def gaussian_taps(sigma: float, size: int) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-x * x / (2 * sigma * sigma))
    return k / k.sum()


def gaussian(img: np.ndarray, sigma: float = 0.0, size: int = 0) -> np.ndarray:
    """Gaussian blur; a missing size covers four deviations a side, a missing deviation follows from the size."""
    if size <= 0:
        size = round(8 * sigma + 1) | 1
    if sigma <= 0:
        sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    taps = gaussian_taps(sigma, size)
    return separable(img, taps, taps)


def mean_abs_laplacian(img01: np.ndarray) -> float:
    return float(np.abs(laplacian(img01)).mean())


def laplacian_variance(gray: np.ndarray) -> float:
    return float(laplacian(gray).var())


# Colour. Images are height x width x 3 in the order blue, green, red.


def gray_of(bgr: np.ndarray) -> np.ndarray:
    """Luma as 8-bit samples."""
    b, g, r = (bgr[..., k].astype(np.int64) for k in range(3))
    return ((r * 4899 + g * 9617 + b * 1868 + 8192) >> 14).astype(np.uint8)


def brightness01(bgr: np.ndarray, channel: str = "y") -> np.ndarray:
    """Brightness in [0, 1]: luma (y) or the largest channel (v)."""
    return (bgr.max(-1) if channel == "v" else gray_of(bgr)).astype(np.float64) / 255.0


def lab_of(bgr: np.ndarray) -> np.ndarray:
    """CIE L*a*b* (D65) scaled to 8 bits: L times 255/100, a and b plus 128, rounded."""
    c = bgr[..., ::-1].astype(np.float64) / 255.0
    c = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    # Linear sRGB to XYZ, and the white point.
    xyz = c @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T
    x, y, z = (xyz / np.array([0.950456, 1.0, 1.088754])).transpose(2, 0, 1)
    f = lambda t: np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    light = np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y)
    out = np.stack([light * 255 / 100, 500 * (f(x) - f(y)) + 128, 200 * (f(y) - f(z)) + 128], -1)
    return np.clip(np.rint(out), 0, 255)


# Resizing.


def linear_weights(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.clip((np.arange(m) + 0.5) * (n / m) - 0.5, 0, n - 1)
    lo = np.minimum(at.astype(int), max(n - 2, 0))
    return lo, np.minimum(lo + 1, n - 1), at - lo


def resize_linear(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, sample centres at halves."""
    a, b, t = linear_weights(img.shape[0], height)
    img = img.astype(np.float64)
    img = img[a] * (1 - t)[:, None] + img[b] * t[:, None]
    a, b, t = linear_weights(img.shape[1], width)
    return img[:, a] * (1 - t) + img[:, b] * t


def area_weights(n: int, m: int) -> np.ndarray:
    """Share of each of n samples in each of m equal intervals."""
    edges = np.arange(m + 1) * (n / m)
    lo, hi = edges[:-1, None], edges[1:, None]
    at = np.arange(n)
    return np.clip(np.minimum(hi, at + 1) - np.maximum(lo, at), 0, 1) * (m / n)


def shrink_to(img: np.ndarray, long_side: int = 640) -> np.ndarray:
    """8-bit image whose longer side is at most long_side, by area averages; smaller ones stay."""
    h, w = img.shape[:2]
    if long_side <= 0 or max(h, w) <= long_side:
        return img
    scale = long_side / max(h, w)
    nh, nw = max(2, round(h * scale)), max(2, round(w * scale))
    rows, cols = area_weights(h, nh), area_weights(w, nw)
    out = np.einsum("ih,hw...,jw->ij...", rows, img.astype(np.float64), cols, optimize=True)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def triangle_weights(n: int, m: int) -> np.ndarray:
    """Weights of n samples in each of m: a triangle as wide as the step, one sample at least, so that none is skipped."""
    step = n / m
    wide = max(step, 1.0)
    w = np.maximum(1 - np.abs(np.arange(n) + 0.5 - ((np.arange(m) + 0.5) * step)[:, None]) / wide, 0)
    return w / w.sum(1, keepdims=True)


def resize_smooth(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """8-bit image, bilinear with the filter widened where it shrinks, columns before rows and rounded after each."""
    for axis, m in ((1, width), (0, height)):
        w = triangle_weights(img.shape[axis], m)
        img = np.moveaxis(np.tensordot(w, np.moveaxis(img, axis, 0).astype(np.float64), 1), 0, axis)
        img = np.clip(np.floor(img + 0.5), 0, 255).astype(np.uint8)
    return img


def down_and_up(img01: np.ndarray, scale: float = 0.5) -> np.ndarray:
    h, w = img01.shape
    small = resize_linear(img01, max(1, round(h * scale)), max(1, round(w * scale)))
    return resize_linear(small, h, w)


# Light.


def exposure(bright: np.ndarray, over: float = 0.90, under: float = 0.05) -> tuple[float, float, float, float]:
    """Shares of over- and under-exposed samples, and how far these are beyond the limits in the mean."""
    hi, lo = bright >= over, bright <= under
    return (
        float(hi.mean()),
        float((bright[hi] - over).mean()) if hi.any() else 0.0,
        float(lo.mean()),
        float((under - bright[lo]).mean()) if lo.any() else 0.0,
    )


def illumination_unevenness(bright: np.ndarray, sigma: float = 25.0) -> float:
    smooth = gaussian(bright, sigma)
    return float(smooth.std() / (smooth.mean() + EPS))


def orientation_concentration(gray01: np.ndarray, over: float = 0.90, under: float = 0.05, percentile: float = 70.0, bins: int = 36) -> float:
    """One less the normalised entropy of the directions of strong gradients in well-exposed parts."""
    # Comparisons are made in single precision, in which 8-bit samples are held.
    img = gray01.astype(np.float32)
    valid = (img < over) & (img > under)
    if valid.mean() < 0.05:
        return 0.0
    gx, gy = (sobel(img, *d).astype(np.float32) for d in ((1, 0), (0, 1)))
    size = np.sqrt(gx * gx + gy * gy)
    strong = valid & (size >= np.percentile(size[valid], percentile))
    if strong.mean() < 0.01:
        return 0.0
    angle = np.arctan2(gy[strong], gx[strong]) + np.float32(np.pi)
    p = np.histogram(angle, bins, (0.0, 2 * np.pi))[0] / np.count_nonzero(strong)
    entropy = -float((p * np.log(p + EPS)).sum())
    return float(np.clip(1 - entropy / (math.log(bins) + EPS), 0, 1))


def dominant_orientation(gray01: np.ndarray, size: int = 9) -> float:
    """Degrees in [0, 180) of the structure tensor's leading direction, from means over the image."""
    gx, gy = sobel(gray01, 1, 0), sobel(gray01, 0, 1)
    size |= 1
    a, b, c = (float(gaussian(x, 0.0, size).mean()) for x in (gx * gx, gx * gy, gy * gy))
    return math.degrees(0.5 * math.atan2(2 * b, a - c + 1e-8)) % 180.0


def directional_loss(gray01: np.ndarray, degrees: float | None = None) -> float:
    """How much less energy the second derivative has in one direction than the Laplacian, in [0, 1].

    Without a direction it is the one across the dominant orientation.
    """
    if degrees is None:
        degrees = (dominant_orientation(gray01) + 90.0) % 180.0
    u, v = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    along = u * u * sobel(gray01, 2, 0) + 2 * u * v * sobel(gray01, 1, 1) + v * v * sobel(gray01, 0, 2)
    energy = float((laplacian(gray01) ** 2).mean())
    return float(np.clip(1 - float((along**2).mean()) / (energy + 1e-8), 0, 1))


# Space.


def edge_map(gray: np.ndarray, low: float = 100.0, high: float = 200.0) -> np.ndarray:
    """Canny edges: thinned gradient maxima above `low` that touch one above `high`, over eight neighbours."""
    gx, gy = sobel(gray, 1, 0, EDGE), sobel(gray, 0, 1, EDGE)
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    h, w = gray.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    ax, ay = np.abs(gx), np.abs(gy)
    slope = math.tan(math.pi / 8)
    flat, steep = ay < slope * ax, ay > (slope + 2) * ax
    same = gx * gy >= 0
    peak = np.where(
        flat,
        (size > at(0, -1)) & (size >= at(0, 1)),
        np.where(steep, (size > at(-1, 0)) & (size >= at(1, 0)), np.where(same, (size > at(-1, -1)) & (size > at(1, 1)), (size > at(-1, 1)) & (size > at(1, -1)))),
    )
    weak = peak & (size > low)
    out = weak & (size > high)
    front = np.argwhere(out)
    while len(front):
        near = (front[:, None] + np.array([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])).reshape(-1, 2)
        near = near[(near >= 0).all(1) & (near < (h, w)).all(1)]
        near = near[weak[near[:, 0], near[:, 1]] & ~out[near[:, 0], near[:, 1]]]
        near = np.unique(near, axis=0) if len(near) else near
        out[near[:, 0], near[:, 1]] = True
        front = near
    return out


def edge_density(gray: np.ndarray, low: float = 100.0, high: float = 200.0) -> float:
    return float(np.count_nonzero(edge_map(gray, low, high)) / (gray.size + EPS))


def sample_centres(height: int, width: int, n: int, patch: int, seed: int) -> np.ndarray:
    """(x, y) of n seeded centres of patches that lie within the image; none if a side has no two places for one."""
    half = patch // 2
    if min(height, width) < max(patch + 2, 2 * half + 2):
        return np.zeros((0, 2), np.int64)
    draw = np.random.default_rng(seed).integers
    x = draw(half, width - half, size=n, dtype=np.int32)
    return np.stack([x, draw(half, height - half, size=n, dtype=np.int32)], 1).astype(np.int64)


def best_matches(gray: np.ndarray, centres: np.ndarray, patch: int = 32, radius: int = 80, margin: int = 4) -> np.ndarray:
    """Best correlation, mapped to [0, 1], of the patch around each centre (x, y) with others up to `radius` away.

    Normalised cross-correlation, all centres at once: products by Fourier transforms of each one's area, sums of
    windows by integral images. A window counts if it lies in the image and is over `margin` away from the patch
    in x or y. A patch of no variance matches all windows, a window of none matches no other patch; a patch that
    leaves the image or has no room beside it has 0.
    """
    h, w = gray.shape
    half, side = patch // 2, 2 * radius + 2 * (patch // 2)
    left, top = centres[:, 0] - half, centres[:, 1] - half
    edge = radius + patch
    wide = np.pad(gray.astype(np.float64), edge)
    cut = lambda x, y, size: wide[(y[:, None] + edge + np.arange(size))[:, :, None], (x[:, None] + edge + np.arange(size))[:, None, :]]
    zero = cut(left, top, patch)
    zero -= zero.mean((1, 2), keepdims=True)
    norm = (zero**2).sum((1, 2))
    shifts = np.arange(-radius, side - patch - radius + 1)
    areas = cut(left - radius, top - radius, side)
    products = np.fft.irfft2(np.fft.rfft2(areas) * np.conj(np.fft.rfft2(zero, (side, side))), (side, side))[:, : len(shifts), : len(shifts)]

    def window_sums(x: np.ndarray) -> np.ndarray:
        total = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
        total[1:, 1:] = x.cumsum(0).cumsum(1)
        every = total[patch:, patch:] - total[:-patch, patch:] - total[patch:, :-patch] + total[:-patch, :-patch]
        return every[(top[:, None] + edge + shifts)[:, :, None], (left[:, None] + edge + shifts)[:, None, :]]

    spread = window_sums(wide**2) - window_sums(wide) ** 2 / patch**2
    ok = spread > 1e-6
    found = np.where(ok, np.clip(products / np.sqrt(np.where(ok, spread * np.maximum(norm, 1e-9)[:, None, None], 1.0)), -1, 1), 0.0)
    found[norm < 1e-9] = 1.0
    inside = [(a[:, None] + shifts >= 0) & (a[:, None] + shifts + patch <= n) for a, n in ((top, h), (left, w))]
    near = np.abs(shifts) <= margin
    found[~(inside[0][:, :, None] & inside[1][:, None, :])] = -1.0
    found[:, near[:, None] & near] = -1.0
    room = [np.minimum(n, a + half + radius + half) - np.maximum(0, a - radius) >= patch + 2 for a, n in ((top, h), (left, w))]
    fits = (left >= 0) & (top >= 0) & (left + patch <= w) & (top + patch <= h) & room[0] & room[1]
    return np.where(fits, np.clip((found.max((1, 2)) + 1) / 2, 0, 1), 0.0)


def self_dissimilarity(gray: np.ndarray, seed: int, side: int = 640, n: int = 64, patch: int = 32, radius: int = 80, margin: int = 4) -> float:
    """One less the mean best match of sampled patches, over the image at side x side (0: as it is); no patch: NaN."""
    if side > 0:
        gray = np.clip(np.rint(resize_linear(gray, side, side)), 0, 255)
    centres = sample_centres(*gray.shape, n, patch, seed)
    if not len(centres):
        return math.nan
    best = [best_matches(gray, centres[at : at + 64], patch, radius, margin) for at in range(0, len(centres), 64)]
    return 1.0 - float(np.concatenate(best).mean())


def high_frequency_share(gray01: np.ndarray, ratio: float = 0.55) -> float:
    """Share of the spectrum's power beyond a part of its largest radius."""
    power = np.abs(np.fft.fftshift(np.fft.fft2(gray01))) ** 2
    h, w = gray01.shape
    r = np.hypot(np.arange(h)[:, None] - h // 2, np.arange(w) - w // 2)
    return float(power[r >= ratio * r.max()].sum() / (power.sum() + EPS))


# Style.


def colour_vector(bgr: np.ndarray) -> np.ndarray:
    """Means and deviations of the three Lab channels."""
    flat = lab_of(bgr).reshape(-1, 3)
    return np.concatenate([flat.mean(0), flat.std(0)])


def tone_vector(bgr: np.ndarray) -> np.ndarray:
    """Mean, deviation and skewness of L."""
    x = lab_of(bgr)[..., 0].ravel()
    m, s = x.mean(), x.std()
    return np.array([m, s, ((x - m) ** 3).mean() / (s + EPS) ** 3])


def binary_patterns(gray: np.ndarray) -> np.ndarray:
    """Eight bits for each inner sample: from the upper left clockwise, set where the neighbour isn't darker."""
    g = gray.astype(np.int16)
    h, w = g.shape
    mid = g[1:-1, 1:-1]
    ring = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
    bits = [g[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] >= mid for dy, dx in ring]
    return np.packbits(np.stack(bits, -1), -1)[..., 0]


def texture_histogram(gray: np.ndarray, bins: int = 256) -> np.ndarray:
    """Shares of the binary patterns; images under three samples a side count as pattern 0."""
    out = np.zeros(bins)
    if min(gray.shape) < 3:
        out[0] = 1.0
        return out
    codes = binary_patterns(gray)
    return np.bincount(codes.ravel(), minlength=bins) / (codes.size + EPS)


def residual_energy(gray: np.ndarray, sigma: float = 1.2, size: int = 0) -> float:
    """Mean square of what a small Gaussian takes away."""
    if size <= 0:
        size = max(3, round(6 * sigma + 1) | 1)
    g = gray.astype(np.float64)
    return float(((g - gaussian(g, sigma, size)) ** 2).mean())


def blockiness(gray: np.ndarray, block: int = 8) -> float:
    """Mean step over the borders of a grid of blocks, both ways; images without a border: 0."""
    h, w = gray.shape
    if min(h, w) < block + 1:
        return 0.0
    g = gray.astype(np.float64)
    steps = [np.abs(x[block::block] - x[block - 1 : -1 : block]).mean() for x in (g.T, g)]
    return float(sum(steps) / 2)


# Annotations.


def ring_low_share(gray01: np.ndarray, widths: tuple[int, ...] = (2, 4, 8, 12), q: float = 0.30, middle: str = "median") -> float:
    """Share of weak gradients in the border rings of a patch, each against its own quantile; no ring: the whole patch."""
    gx, gy = sobel(gray01, 1, 0, EDGE), sobel(gray01, 0, 1, EDGE)
    # Equal gradients are to tie, so that sizes have single precision.
    size = np.sqrt(gx * gx + gy * gy).astype(np.float32).astype(np.float64)
    h, w = size.shape
    shares = []
    for t in widths:
        if t > 0 and min(h, w) > 2 * t:
            ring = np.ones((h, w), bool)
            ring[t : h - t, t : w - t] = False
            some = size[ring]
            if len(some) >= 16:
                shares.append(float((some <= np.quantile(some, q)).mean()))
    if not shares:
        return float((size <= np.quantile(size, q)).mean())
    return float(np.mean(shares) if middle == "mean" else np.median(shares))


# The mean and deviation of red, green and blue that networks trained on ImageNet expect.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def network_input(crops: list[np.ndarray], side: int = 224) -> np.ndarray:
    """BGR crops as one float array (crop, channel, row, column) of normalised red, green and blue at side x side."""
    out = np.empty((len(crops), 3, side, side), np.float32)
    for k, crop in enumerate(crops):
        rgb = resize_smooth(crop[..., ::-1], side, side) / 255.0
        out[k] = ((rgb - MEAN) / DEVIATION).transpose(2, 0, 1)
    return out
