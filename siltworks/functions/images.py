"""Images as numpy arrays (height, width, channels): decoding of uncompressed formats, and the transforms of the vision pipelines.

Random transforms take a generator, which draws() seeds by record, epoch and tag: a record gets the same draws wherever and however often
it is computed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Sequence

import numpy as np


def draws(seed: int, epoch: int, record, tag: str) -> np.random.Generator:
    digest = hashlib.blake2b(f"{seed}:{epoch}:{record}:{tag}".encode(), digest_size=8).digest()
    return np.random.default_rng(int.from_bytes(digest, "big"))


# Decoding


def decode(raw: bytes) -> np.ndarray:
    """RGB from a PNG (8 bits a channel, not interlaced) or a binary PPM or PGM. Other formats need a codec that the caller brings."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(raw)
    if raw[:2] in (b"P5", b"P6"):
        return _pnm(raw)
    raise ValueError("no decoder for this image format")


def size_of(raw: bytes) -> tuple[int, int]:
    """(width, height) from the header of a PNG, PNM, GIF, BMP or JPEG file, without decoding it."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", raw[16:24])
    if raw[:2] in (b"P5", b"P6"):
        fields = raw[:64].split()
        return int(fields[1]), int(fields[2])
    if raw[:3] == b"GIF":
        return struct.unpack("<HH", raw[6:10])
    if raw[:2] == b"BM":
        w, h = struct.unpack("<ii", raw[18:26])
        return w, abs(h)
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw):
            marker, length = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
                return w, h
            at += 2 + length
    raise ValueError("no image header")


def _pnm(raw: bytes) -> np.ndarray:
    fields, at = [], 0
    while len(fields) < 4:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while not raw[end : end + 1].isspace():
            end += 1
        fields.append(raw[at:end])
        at = end
    w, h, n = int(fields[1]), int(fields[2]), 3 if fields[0] == b"P6" else 1
    data = np.frombuffer(raw, np.uint8, w * h * n, at + 1).reshape(h, w, n)
    return np.repeat(data, 3, 2) if n == 1 else data.copy()


def _png(raw: bytes) -> np.ndarray:
    at, data, palette, head = 8, b"", None, None
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    w, h, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced:
        raise ValueError("only PNG of 8 bits, not interlaced")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    above = np.zeros(w * n, np.int32)
    for y in range(h):
        kind, line = int(lines[y, 0]), lines[y, 1:].astype(np.int32)
        if kind == 2:
            line = line + above
        elif kind in (1, 3, 4):
            for x in range(w * n):
                left = line[x - n] if x >= n else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + above[x]) >> 1
                else:
                    corner = above[x - n] if x >= n else 0
                    p = left + above[x] - corner
                    near = (abs(p - left), abs(p - above[x]), abs(p - corner))
                    guess = (left, above[x], corner)[near.index(min(near))]
                line[x] = (line[x] + guess) & 255
        above = line & 255
        out[y] = above
    out = out.reshape(h, w, n)
    if colour == 3:
        return palette[out[:, :, 0]]
    return np.repeat(out[:, :, :1], 3, 2) if n < 3 else out[:, :, :3]


# Geometry


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w = x.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    z = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, z0 = np.floor(y).astype(int), np.floor(z).astype(int)
    y1, z1 = np.minimum(y0 + 1, h - 1), np.minimum(z0 + 1, w - 1)
    fy, fz = (y - y0)[:, None, None], (z - z0)[None, :, None]
    f = x.astype(np.float64)
    out = (f[y0][:, z0] * (1 - fz) + f[y0][:, z1] * fz) * (1 - fy) + (f[y1][:, z0] * (1 - fz) + f[y1][:, z1] * fz) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8) if x.dtype == np.uint8 else out.astype(x.dtype)


def center_crop(x: np.ndarray, size: int) -> np.ndarray:
    h, w = x.shape[:2]
    top, left = max(0, (h - size) // 2), max(0, (w - size) // 2)
    return x[top : top + size, left : left + size]


def resize_short_side(x: np.ndarray, size: int) -> np.ndarray:
    h, w = x.shape[:2]
    return resized(x, size, round(w * size / h)) if h <= w else resized(x, round(h * size / w), size)


def random_resized_crop(x: np.ndarray, rng: np.random.Generator, size: int, area=(0.08, 1.0), aspect=(3 / 4, 4 / 3)) -> np.ndarray:
    h, w = x.shape[:2]
    for _ in range(10):
        target = h * w * rng.uniform(*area)
        shape = np.exp(rng.uniform(*np.log(aspect)))
        cw, ch = round((target * shape) ** 0.5), round((target / shape) ** 0.5)
        if 0 < cw <= w and 0 < ch <= h:
            top, left = rng.integers(0, h - ch + 1), rng.integers(0, w - cw + 1)
            return resized(x[top : top + ch, left : left + cw], size, size)
    return resized(center_crop(x, min(h, w)), size, size)


def flip(x: np.ndarray) -> np.ndarray:
    return x[:, ::-1]


def affine(x: np.ndarray, matrix: np.ndarray, fill=(128, 128, 128)) -> np.ndarray:
    """Each place gets the nearest pixel at matrix @ (column, row, 1), or the fill."""
    h, w = x.shape[:2]
    rows, cols = np.mgrid[:h, :w]
    at = np.rint(matrix @ np.stack([cols.ravel(), rows.ravel(), np.ones(h * w)])).astype(int)
    inside = (at[0] >= 0) & (at[0] < w) & (at[1] >= 0) & (at[1] < h)
    out = np.empty((h * w, x.shape[2]), x.dtype)
    out[:] = np.asarray(fill)[: x.shape[2]]
    out[inside] = x[at[1][inside], at[0][inside]]
    return out.reshape(x.shape)


def rotated(x: np.ndarray, degrees: float, fill=(128, 128, 128)) -> np.ndarray:
    h, w = x.shape[:2]
    a, cx, cy = np.deg2rad(degrees), (w - 1) / 2, (h - 1) / 2
    c, s = np.cos(a), np.sin(a)
    return affine(x, np.array([[c, -s, cx - c * cx + s * cy], [s, c, cy - s * cx - c * cy]]), fill)


# Colour


def to_float(x: np.ndarray) -> np.ndarray:
    """As floats, not scaled."""
    return x.astype(np.float32)


def to_unit(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32) / 255 if x.dtype == np.uint8 else x.astype(np.float32)


def normalized(x: np.ndarray, mean, std) -> np.ndarray:
    return ((x - np.asarray(mean)) / np.asarray(std)).astype(np.float32)


def luma(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def _as(x: np.ndarray, like: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8) if like.dtype == np.uint8 else x.astype(like.dtype)


def grayscale(x: np.ndarray) -> np.ndarray:
    return _as(np.repeat(luma(x)[:, :, None], 3, 2), x)


def blended(x: np.ndarray, other: np.ndarray, factor: float) -> np.ndarray:
    """other at factor 0, x at 1."""
    return _as(other + (x.astype(np.float64) - other) * factor, x)


def brightness(x: np.ndarray, factor: float) -> np.ndarray:
    return blended(x, np.zeros(()), factor)


def contrast(x: np.ndarray, factor: float) -> np.ndarray:
    return blended(x, np.full((), luma(x).mean()), factor)


def saturation(x: np.ndarray, factor: float) -> np.ndarray:
    return blended(x, np.repeat(luma(x)[:, :, None], 3, 2), factor)


def hue(x: np.ndarray, turn: float) -> np.ndarray:
    """Turns the hue by a share of the circle, at equal luma, in the YIQ colour space."""
    to_yiq = np.array([[0.299, 0.587, 0.114], [0.596, -0.274, -0.322], [0.211, -0.523, 0.312]])
    a = 2 * np.pi * turn
    spin = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]])
    return _as(x.astype(np.float64) @ (np.linalg.inv(to_yiq) @ spin @ to_yiq).T, x)


def color_jitter(x: np.ndarray, rng: np.random.Generator, b=0.1, c=0.1, s=0.1, h=0.1) -> np.ndarray:
    """The four changes in random order; saturation and hue only with three channels."""
    for k in rng.permutation(4):
        if k == 0:
            x = brightness(x, rng.uniform(max(0, 1 - b), 1 + b))
        elif k == 1 and x.shape[2] == 3:
            x = contrast(x, rng.uniform(max(0, 1 - c), 1 + c))
        elif k == 2 and x.shape[2] == 3:
            x = saturation(x, rng.uniform(max(0, 1 - s), 1 + s))
        elif x.shape[2] == 3:
            x = hue(x, rng.uniform(-h, h))
    return x


def gaussian_blur(x: np.ndarray, sigma: float, size: int | None = None) -> np.ndarray:
    """Separable; edges are mirrored."""
    reach = (size or 2 * int(3 * sigma + 0.5) + 1) // 2
    reach = min(reach, min(x.shape[:2]) - 1)
    k = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    out = x.astype(np.float64)
    for axis in (0, 1):
        pad = [(reach, reach) if a == axis else (0, 0) for a in range(3)]
        wide = np.pad(out, pad, "reflect")
        out = sum(w * wide.take(range(i, i + x.shape[axis]), axis) for i, w in enumerate(k))
    return _as(out, x)


def solarize(x: np.ndarray, threshold: int = 128) -> np.ndarray:
    return np.where(x < threshold, x, 255 - x).astype(x.dtype)


def posterize(x: np.ndarray, off: int) -> np.ndarray:
    """Without the lowest `off` bits."""
    return x & np.uint8(255 << off & 255)


def autocontrast(x: np.ndarray) -> np.ndarray:
    low, high = x.min((0, 1)).astype(np.float64), x.max((0, 1)).astype(np.float64)
    scale = np.where(high > low, 255 / np.maximum(high - low, 1), 1)
    return _as((x - np.where(high > low, low, 0)) * scale, x)


def equalize(x: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    for c in range(x.shape[2]):
        counts = np.bincount(x[:, :, c].ravel(), minlength=256)
        step = (counts.sum() - counts[np.flatnonzero(counts)[-1]]) // 255
        table = np.arange(256) if not step else np.clip((np.concatenate([[0], np.cumsum(counts)[:-1]]) + step // 2) // step, 0, 255)
        out[:, :, c] = table[x[:, :, c]]
    return out


def sharpness(x: np.ndarray, factor: float) -> np.ndarray:
    """Blends with a smoothed image; the border stays."""
    soft = x.astype(np.float64).copy()
    if min(x.shape[:2]) > 2:
        parts = [(x[1 + a : x.shape[0] - 1 + a, 1 + b : x.shape[1] - 1 + b].astype(np.float64)) * (5 if a == b == 0 else 1) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        soft[1:-1, 1:-1] = sum(parts) / 13
    return blended(x, soft, factor)


def cutout(x: np.ndarray, rng: np.random.Generator, size: int, fill=(128, 128, 128)) -> np.ndarray:
    out = x.copy()
    y, z = rng.integers(0, x.shape[0]), rng.integers(0, x.shape[1])
    out[max(0, y - size // 2) : y + size // 2, max(0, z - size // 2) : z + size // 2] = np.asarray(fill)[: x.shape[2]]
    return out


#: What a level, of 10 at most, means to each change. Those with a sign are turned around half of the time.
LEVELS: dict[str, tuple[float, float, bool]] = {"rotate": (30, 0, True), "solarize": (256, 0, False), "color": (1.8, 0.1, False), "contrast": (1.8, 0.1, False), "brightness": (1.8, 0.1, False), "sharpness": (1.8, 0.1, False), "shear_x": (0.3, 0, True), "shear_y": (0.3, 0, True), "translate_x": (10, 0, True), "translate_y": (10, 0, True), "posterize": (4, 0, False)}
CHANGES: dict[str, Callable] = {
    "identity": lambda x, _: x,
    "autocontrast": lambda x, _: autocontrast(x),
    "equalize": lambda x, _: equalize(x),
    "rotate": rotated,
    "solarize": lambda x, v: solarize(x, int(v)),
    "color": saturation,
    "contrast": contrast,
    "brightness": brightness,
    "sharpness": sharpness,
    "shear_x": lambda x, v: affine(x, np.array([[1, v, 0], [0, 1, 0]])),
    "shear_y": lambda x, v: affine(x, np.array([[1, 0, 0], [v, 1, 0]])),
    "translate_x": lambda x, v: affine(x, np.array([[1, 0, -v], [0, 1, 0]])),
    "translate_y": lambda x, v: affine(x, np.array([[1, 0, 0], [0, 1, -v]])),
    "posterize": lambda x, v: posterize(x, int(v)),
}


def rand_augment(x: np.ndarray, rng: np.random.Generator, n: int = 2, level: int = 5, names: Sequence[str] = tuple(CHANGES)) -> np.ndarray:
    """n changes drawn with repetition, each made with probability one half."""
    for name in rng.choice(list(names), n):
        if rng.random() > 0.5:
            continue
        scale, base, signed = LEVELS.get(str(name), (0, 0, False))
        value = scale * level / 10 + base
        x = CHANGES[str(name)](x, -value if signed and rng.random() < 0.5 else value)
    return x


# Chains


def simclr_view(x: np.ndarray, rng: np.random.Generator, size: int = 244) -> np.ndarray:
    x = random_resized_crop(to_float(x), rng, size)
    x = flip(x) if rng.random() < 0.5 else x
    return normalized(gaussian_blur(grayscale(color_jitter(x, rng)), rng.uniform(0.1, 2.0), 11), 0.1307, 0.3081)


#: The number of global and local views, their sizes and areas, and the normalisation.
MULTI_CROP = {"dino": ((2, 224, (0.4, 1.0)), (8, 96, (0.05, 0.4)), (0.229, 0.224, 0.225)), "swav": ((2, 224, (0.14, 1.0)), (6, 96, (0.05, 0.14)), (0.228, 0.224, 0.225))}


def multi_crop(x: np.ndarray, seed: Callable[[str], np.random.Generator], kind: str = "dino") -> list[np.ndarray]:
    """Views of one decoded image; every view starts from the original and has its own draws."""
    *groups, std = MULTI_CROP[kind]
    views = []
    for count, size, area in groups:
        for _ in range(count):
            rng = seed(f"view{len(views)}")
            v = random_resized_crop(x, rng, size, area)
            v = flip(v) if rng.random() < 0.5 else v
            v = color_jitter(v, rng, 0.4, 0.4, 0.2, 0.1) if rng.random() < 0.8 else v
            v = grayscale(v) if rng.random() < 0.2 else v
            v = gaussian_blur(v, rng.uniform(0.1, 2.0)) if rng.random() < (1.0, 0.1, 0.5)[min(len(views), 2)] else v
            v = solarize(v) if kind == "dino" and len(views) == 1 and rng.random() < 0.2 else v
            views.append(normalized(to_unit(v), (0.485, 0.456, 0.406), std))
    return views


def clip_view(x: np.ndarray, size: int = 224) -> np.ndarray:
    x = center_crop(resize_short_side(x, size), size)
    return normalized(to_unit(x), (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711))
