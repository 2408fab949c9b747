"""Descriptors of face images, a whole Arrow batch of images at a time.

An image is ``struct<height int, width int, rgb binary>`` (rows of pixels, three bytes each). It is brought into a
frame of 64 x 64 pixels, by the places of the eyes where they are known, and described by gradients and coarse
colour. Finding eyes is left to whoever supplies the images.

Defined results: null images, images without pixels or with too few bytes give null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The frame, its cells, orientation bins and blocks; the clip of a block; the share of colour;
# where the eyes come to stand; the colour outside a picture.
SIDE, CELL, BINS, BLOCK, CLIP, COLOUR = 64, 8, 9, 2, 0.2, 0.40
EYE_HEIGHT, EYE_GAP, OUTSIDE = 0.42, 0.34, (235.0, 235.0, 233.0)
DIMENSIONS = (SIDE // CELL - BLOCK + 1) ** 2 * BLOCK**2 * BINS + 4 * 4 * 3


def box_mean(images: np.ndarray, width: int) -> np.ndarray:
    """Mean over ``width`` x ``width`` pixels (odd) of each of N images, edges repeated."""
    pad = width // 2
    x = np.pad(images.astype(float), ((0, 0), (pad, pad), (pad, pad)), mode="edge")
    for axis in (1, 2):
        lead = [(0, 0)] * 3
        lead[axis] = (1, 0)
        sums = np.pad(np.cumsum(x, axis=axis), lead)
        n = sums.shape[axis]
        x = (np.take(sums, range(width, n), axis) - np.take(sums, range(n - width), axis)) / width
    return x


def local_max(images: np.ndarray, reach: int) -> np.ndarray:
    """Greatest value within ``reach`` pixels in both directions, edges repeated."""
    x = np.pad(images, ((0, 0), (reach, reach), (reach, reach)), mode="edge")
    return np.lib.stride_tricks.sliding_window_view(x, (2 * reach + 1,) * 2, axis=(1, 2)).max(axis=(3, 4))


def _unit(rows: np.ndarray, least: float = 1e-9) -> np.ndarray:
    return rows / (np.linalg.norm(rows, axis=-1, keepdims=True) + least)


def gradients(grey: np.ndarray) -> np.ndarray:
    """Histograms of unsigned gradient directions of N grey images of the frame: N unit rows."""
    n, cells = len(grey), SIDE // CELL
    x = grey - box_mean(grey, 9)  # slow changes of light go
    spread = x.std(axis=(1, 2), keepdims=True)
    x = np.divide(x, spread, out=x.copy(), where=spread > 1e-6)
    across, down = np.zeros_like(x), np.zeros_like(x)
    across[:, :, 1:-1], down[:, 1:-1] = x[:, :, 2:] - x[:, :, :-2], x[:, 2:] - x[:, :-2]
    strength = np.hypot(across, down)
    place = np.mod(np.arctan2(down, across), np.pi) / np.pi * BINS - 0.5
    low = np.floor(place).astype(int)
    cell = (np.arange(SIDE) // CELL)[:, None] * cells + np.arange(SIDE) // CELL
    base = (np.arange(n)[:, None, None] * cells * cells + cell) * BINS
    size = n * cells * cells * BINS
    # every pixel counts for the two nearest directions of its cell
    hist = sum(np.bincount((base + np.mod(b, BINS)).ravel(), (strength * w).ravel(), size) for b, w in ((low, 1 - (place - low)), (low + 1, place - low)))
    blocks = np.lib.stride_tricks.sliding_window_view(hist.reshape(n, cells, cells, BINS), (BLOCK, BLOCK), axis=(1, 2))
    blocks = blocks.transpose(0, 1, 2, 4, 5, 3).reshape(n, (cells - BLOCK + 1) ** 2, -1)
    for clip in (CLIP, np.inf):
        blocks = np.minimum(blocks / np.sqrt((blocks**2).sum(-1, keepdims=True) + 1e-6), clip)
    return _unit(blocks.reshape(n, -1))


def colours(rgb: np.ndarray) -> np.ndarray:
    """Mean colours of 4 x 4 parts of N images of the frame, against the image's own mean colour: N unit rows."""
    x = rgb / (rgb.mean(axis=(1, 2), keepdims=True) + 1e-6)
    step = SIDE // 4
    return _unit(x.reshape(len(x), 4, step, 4, step, 3).mean(axis=(2, 4)).reshape(len(x), -1))


def describe(rgb: np.ndarray) -> np.ndarray:
    """``DIMENSIONS`` numbers of unit length for each of N images of the frame."""
    grey = np.rint(rgb @ np.array([0.299, 0.587, 0.114]))
    return _unit(np.concatenate([gradients(grey) * (1 - COLOUR), colours(rgb) * COLOUR], axis=1))


def _sample(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values at ``x, y``; ``OUTSIDE`` beyond the picture."""
    h, w = image.shape[:2]
    inside = (x > -0.5) & (x < w - 0.5) & (y > -0.5) & (y < h - 0.5)
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
    fx, fy, x1, y1 = (x - x0)[..., None], (y - y0)[..., None], np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    value = (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
    return np.where(inside[..., None], value, OUTSIDE)


def align(image: np.ndarray, eyes: tuple[float, float, float, float] | None) -> np.ndarray:
    """The frame of a picture: turned, scaled and moved (never stretched) so the eyes (left x, y, right x, y) stand level in place.

    Without eyes, or with eyes closer than four pixels, the whole picture is brought to size.
    """
    at = np.arange(SIDE) + 0.5
    u, v = np.meshgrid(at, at)
    if eyes is None or np.hypot(eyes[2] - eyes[0], eyes[3] - eyes[1]) < 4:
        h, w = image.shape[:2]
        wide = max(1, int(round(min(h, w) / SIDE)) | 1)
        if wide > 1:
            image = np.stack([box_mean(image[None, :, :, k], wide)[0] for k in range(3)], -1)
        return _sample(image, u * w / SIDE - 0.5, v * h / SIDE - 0.5)
    span = complex(eyes[2] - eyes[0], eyes[3] - eyes[1])
    middle = complex(eyes[0] + eyes[2], eyes[1] + eyes[3]) / 2
    turn = span / (EYE_GAP * SIDE)  # a frame pixel in picture pixels, as a turn and a scale
    z = middle + turn * (u - SIDE / 2 + 1j * (v - EYE_HEIGHT * SIDE))
    return _sample(image, z.real - 0.5, z.imag - 0.5)


def _frames(images: pd.DataFrame, eyes: pd.Series) -> tuple[list[int], np.ndarray]:
    kept, frames = [], []
    for i, (h, w, rgb, e) in enumerate(zip(images["height"], images["width"], images["rgb"], eyes)):
        if rgb is not None and h and w and h == h and w == w and len(rgb) >= int(h) * int(w) * 3:
            picture = np.frombuffer(rgb, np.uint8, int(h) * int(w) * 3).reshape(int(h), int(w), 3).astype(float)
            usable = e is not None and len(e) == 4 and all(x is not None and np.isfinite(x) for x in e)
            kept.append(i)
            frames.append(align(picture, tuple(e) if usable else None))
    return kept, np.array(frames).reshape(-1, SIDE, SIDE, 3)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embedding(images: pd.DataFrame, eyes: pd.Series) -> pd.Series:
    """Descriptor of ``image`` with ``eyes`` (``array<double>`` of four numbers, or null)."""
    kept, frames = _frames(images, eyes)
    out = pd.Series([None] * len(images), dtype=object)
    if kept:
        for i, row in zip(kept, describe(frames).astype(np.float32)):
            out[i] = row.tolist()
    return out
