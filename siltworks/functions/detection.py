"""Augmentation of images with boxes: each transform gets and gives an example, a dict of image (height, width, channels), boxes (rows of left,
top, right, bottom) and labels. Draws come from the generator that images.draws() seeds by record."""

from __future__ import annotations

from typing import Any

import numpy as np

from . import images

Example = dict[str, Any]

#: The colour around an image that is zoomed out, the overlaps that a crop may demand (1: no crop), tries for each, the least share
#: of a side and the aspects of a crop, and the ranges of the distortion.
FILL, OVERLAPS, TRIES, SIDE, ASPECT = (123.0, 117.0, 104.0), (0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0), 40, 0.3, (0.5, 2.0)
BRIGHTNESS, CONTRAST, SATURATION, HUE = (0.875, 1.125), (0.5, 1.5), (0.5, 1.5), 0.05


def _boxes(example: Example) -> np.ndarray:
    return np.asarray(example["boxes"], float).reshape(-1, 4)


def zoom_out(example: Example, rng: np.random.Generator, most: float = 4.0) -> Example:
    """The image at a random place of a canvas of 1 to `most` times its sides."""
    x = example["image"]
    height, width = x.shape[:2]
    scale = rng.uniform(1.0, most)
    tall, wide = int(height * scale), int(width * scale)
    top, left = int(rng.integers(0, tall - height + 1)), int(rng.integers(0, wide - width + 1))
    canvas = np.empty((tall, wide, x.shape[2]), x.dtype)
    canvas[:] = np.asarray(FILL[: x.shape[2]]).astype(x.dtype)
    canvas[top : top + height, left : left + width] = x
    return {**example, "image": canvas, "boxes": _boxes(example) + (left, top, left, top)}


def overlaps(boxes: np.ndarray, window: tuple[float, float, float, float]) -> np.ndarray:
    """Intersection over union of each box with a window."""
    low, high = np.maximum(boxes[:, :2], window[:2]), np.minimum(boxes[:, 2:], window[2:])
    common = np.prod(np.maximum(high - low, 0), 1)
    area = np.prod(boxes[:, 2:] - boxes[:, :2], 1) + (window[2] - window[0]) * (window[3] - window[1])
    return np.where(area - common > 0, common / np.maximum(area - common, 1e-12), 0.0)


def iou_crop(example: Example, rng: np.random.Generator) -> Example:
    """A crop of which some box with its centre inside overlaps by a drawn least share. Boxes with their centre outside lose all area; the
    others are cut at the border. Images without boxes stay, and so does one for which a share of 1 is drawn."""
    x, boxes = example["image"], _boxes(example)
    height, width = x.shape[:2]
    if not len(boxes):
        return example
    while True:
        least = rng.choice(OVERLAPS)
        if least >= 1:
            return example
        for _ in range(TRIES):
            wide, tall = int(width * rng.uniform(SIDE, 1)), int(height * rng.uniform(SIDE, 1))
            if not (wide and tall and ASPECT[0] <= wide / tall <= ASPECT[1]):
                continue
            left, top = int((width - wide) * rng.random()), int((height - tall) * rng.random())
            window = (left, top, left + wide, top + tall)
            centre = (boxes[:, :2] + boxes[:, 2:]) / 2
            inside = ((centre > window[:2]) & (centre < window[2:])).all(1)
            if not inside.any() or overlaps(boxes[inside], window).max() < least:
                continue
            moved = np.clip(boxes - (left, top, left, top), 0, (wide, tall, wide, tall))
            return {**example, "image": x[top : top + tall, left : left + wide], "boxes": np.where(inside[:, None], moved, 0.0)}


def sanitized(example: Example, least: float = 1.0) -> Example:
    """Boxes of at least `least` in both directions that lie within the image, with their labels."""
    boxes = _boxes(example)
    height, width = example["image"].shape[:2]
    keep = ((boxes[:, 2:] - boxes[:, :2]) >= least).all(1) & (boxes >= 0).all(1) & (boxes[:, 2:] <= (width, height)).all(1)
    return {**example, "boxes": boxes[keep], "labels": [v for v, k in zip(example["labels"], keep) if k]}


def flipped(example: Example) -> Example:
    boxes, width = _boxes(example), example["image"].shape[1]
    return {**example, "image": images.flip(example["image"]), "boxes": np.stack([width - boxes[:, 2], boxes[:, 1], width - boxes[:, 0], boxes[:, 3]], 1)}


def distorted(example: Example, rng: np.random.Generator) -> Example:
    """Brightness, then contrast before or after saturation and hue, and perhaps another order of the channels."""
    x, late = images.brightness(example["image"], rng.uniform(*BRIGHTNESS)), rng.random() < 0.5
    x = x if late else images.contrast(x, rng.uniform(*CONTRAST))
    x = images.hue(images.saturation(x, rng.uniform(*SATURATION)), rng.uniform(-HUE, HUE))
    x = images.contrast(x, rng.uniform(*CONTRAST)) if late else x
    return {**example, "image": x[:, :, rng.permutation(x.shape[2])] if rng.random() < 0.5 else x}


def to_tensor(example: Example) -> Example:
    return {**example, "image": np.moveaxis(images.to_unit(example["image"]), 2, 0)}
