"""Per-image numpy steps, called inside Arrow batches by the image and model operators.

Arrays are height x width (gray) or height x width x channels, uint8.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np

# Luma weights in 1/65536 of the usual 0.299, 0.587, 0.114.
LUMA_R, LUMA_G, LUMA_B = 19595, 38470, 7471
# Fraction bits of the resampling weights, and the cubic kernel's parameter.
WEIGHT_BITS = 22
CUBIC_A = -0.5


@dataclass(frozen=True)
class Profile:
    """Preparation of a page image for a model; ``bgr`` is the channel order of the input."""

    binarize: bool
    max_size: int = 800
    mean: Sequence[float] = (0.485, 0.485, 0.485)
    std: Sequence[float] = (0.229, 0.229, 0.229)
    dilate: int | None = None
    bgr: bool = True


# The two normalisations in use.
BINARIZED = Profile(binarize=True)
PLAIN = Profile(binarize=False, mean=(0.485, 0.456, 0.406), std=(0.229, 0.224, 0.225))


def as_array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    flat = np.frombuffer(data, dtype=np.uint8)
    return flat.reshape(height, width) if channels == 1 else flat.reshape(height, width, channels)


def swap_channels(img: np.ndarray) -> np.ndarray:
    """BGR to RGB and back; a fourth (alpha) channel is dropped."""
    return img if img.ndim == 2 else img[..., 2::-1]


def to_gray(rgb: np.ndarray) -> np.ndarray:
    if rgb.ndim == 2:
        return rgb
    r, g, b = (rgb[..., i].astype(np.uint32) for i in range(3))
    return ((r * LUMA_R + g * LUMA_G + b * LUMA_B + 0x8000) >> 16).astype(np.uint8)


def otsu_level(gray: np.ndarray) -> int:
    """Level with the largest between-class variance, the lowest on ties, 0 if there is no split."""
    counts = np.bincount(gray.ravel(), minlength=256)
    n0, s0 = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    total, total_sum = int(n0[-1]), int(s0[-1])
    split = np.flatnonzero((n0 > 0) & (n0 < total))
    if split.size == 0:
        return 0

    def variance(i: int) -> Fraction:
        left, moved = int(n0[i]), int(s0[i])
        return Fraction((total_sum * left - moved * total) ** 2, left * (total - left))

    # Floats find the candidates, whole numbers settle ties between them.
    gap = float(total_sum) * n0[split] - s0[split].astype(np.float64) * total
    rough = gap * gap / (n0[split].astype(np.float64) * (total - n0[split]))
    close = split[rough >= rough.max() * (1 - 1e-9)]
    return int(close[0] if close.size == 1 else max(close, key=lambda i: (variance(i), -i)))


def binarize(gray: np.ndarray) -> np.ndarray:
    return (gray > otsu_level(gray)).astype(np.uint8) * np.uint8(255)


def three_channels(gray: np.ndarray) -> np.ndarray:
    return np.repeat(gray[..., None], 3, axis=2)


def dilate(gray: np.ndarray, size: int = 3) -> np.ndarray:
    """Largest value in a size x size neighbourhood; outside the image counts as lowest."""
    before = size // 2
    out = gray
    for axis in (0, 1):
        pad = [(0, 0)] * out.ndim
        pad[axis] = (before, size - 1 - before)
        padded = np.moveaxis(np.pad(out, pad, constant_values=0), axis, 0)
        n = out.shape[axis]
        out = np.moveaxis(reduce(np.maximum, (padded[k : k + n] for k in range(size))), 0, axis)
    return out


def resized_sides(width: int, height: int, max_size: int) -> tuple[int, int]:
    """Sides after scaling the longest to max_size (small images grow); halves go to even."""
    scale = max_size / max(width, height)
    return round(scale * width), round(scale * height)


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    near = ((CUBIC_A + 2) * x - (CUBIC_A + 3)) * x * x + 1
    far = (((x - 5) * x + 8) * x - 4) * CUBIC_A
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def _weights(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    """Input positions and whole-number cubic weights (2**-WEIGHT_BITS units), n_out x taps each."""
    ratio = n_in / n_out
    spread = max(ratio, 1.0)
    center = ((np.arange(n_out) + 0.5) * ratio)[:, None]
    first = np.maximum(np.trunc(center - 2 * spread + 0.5), 0).astype(np.int64)
    last = np.minimum(np.trunc(center + 2 * spread + 0.5), n_in).astype(np.int64)
    pos = first + np.arange((last - first).max())
    raw = np.where(pos < last, _cubic((pos - center + 0.5) / spread), 0.0)
    share = raw / raw.sum(axis=1, keepdims=True) * 2**WEIGHT_BITS
    return np.minimum(pos, n_in - 1), np.trunc(share + np.copysign(0.5, share)).astype(np.int32)


def _resample(img: np.ndarray, n_out: int) -> np.ndarray:
    """Resize the first axis, one weighted gather per tap.

    Weights add up to 2**22 with small negative lobes, so sums of 8-bit pixels stay in 32 bits.
    """
    positions, weights = _weights(img.shape[0], n_out)
    total = np.full((n_out,) + img.shape[1:], 2 ** (WEIGHT_BITS - 1), np.int32)
    for at, weight in zip(positions.T, weights.T):
        total += img[at] * weight.reshape((-1,) + (1,) * (img.ndim - 1))
    return np.clip(total >> WEIGHT_BITS, 0, 255).astype(np.uint8)


def resize(img: np.ndarray, max_size: int = 800) -> np.ndarray:
    """Cubic resize, rows first across the width and then down the height."""
    height, width = img.shape[:2]
    new_w, new_h = resized_sides(width, height, max_size)
    out = img
    if new_w != width:
        out = np.swapaxes(_resample(np.ascontiguousarray(np.swapaxes(out, 0, 1)), new_w), 0, 1)
    if new_h != height:
        out = _resample(np.ascontiguousarray(out), new_h)
    return np.ascontiguousarray(out)


def normalize(img: np.ndarray, mean: Sequence[float], std: Sequence[float]) -> np.ndarray:
    """Channel-first float tensor, scaled to 0..1 and standardised."""
    hwc = (three_channels(img) if img.ndim == 2 else img).astype(np.float32) / np.float32(255)
    scaled = (hwc - np.asarray(mean, np.float32)) / np.asarray(std, np.float32)
    return np.ascontiguousarray(np.moveaxis(scaled, -1, 0))


def prepare(img: np.ndarray, profile: Profile) -> np.ndarray:
    """Run a profile. Thresholding comes first, at full size.

    A binarized page has three equal channels, so one is resized and then repeated.
    """
    rgb = swap_channels(img) if profile.bgr else img
    if profile.binarize:
        rgb = binarize(to_gray(rgb))
        if profile.dilate:
            rgb = dilate(rgb, profile.dilate)
    return normalize(resize(rgb, profile.max_size), profile.mean, profile.std)
