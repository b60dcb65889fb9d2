"""Deterministic preprocessing of rasters, in integer column expressions and as one Arrow UDF.

Small rasters are arrays of int in row order with known width and height; whole
images go through ``preprocess``, the same steps in NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texweave.functions.binding import let

# Fixed values of the preprocessing format.
SPEC_VERSION = "1.0.0"
GRAY = (299, 587, 114)
GRAY_DIVISOR = 1000


@dataclass(frozen=True)
class Spec:
    """Target size and constants of the pipeline."""

    image_width: int = 384
    image_height: int = 384
    foreground_threshold: int = 200
    polarity_border_threshold: float = 127.5
    padding_value: int = 0
    alpha_background: tuple[int, int, int] = (255, 255, 255)
    mean: float = 0.7931
    std: float = 0.1738

    def __post_init__(self) -> None:
        if self.image_width < 1 or self.image_height < 1 or not 0 <= self.foreground_threshold <= 255 or self.std <= 0:
            raise ValueError("sizes and std must be positive and the threshold a byte")

    def to_dict(self) -> dict:
        return asdict(self) | {"spec_version": SPEC_VERSION, "grayscale": {"coefficients": list(GRAY), "divisor": GRAY_DIVISOR}, "resize": "bilinear", "layout": "CHW", "dtype": "float32"}


def alpha_composite(rgba: Column) -> Column:
    """RGB over white of interleaved RGBA values."""

    def value(i: Column) -> Column:
        s, a = F.get(rgba, F.floor(i / 3).cast("int") * 4 + i % 3), F.get(rgba, F.floor(i / 3).cast("int") * 4 + 3)
        return F.floor((s * a + (255 * 255) - 255 * a + 127) / 255).cast("int")

    return F.transform(F.sequence(F.lit(0), (F.size(rgba) / 4 * 3).cast("int") - 1), value)


def grayscale(rgb: Column) -> Column:
    r, g, b = GRAY
    weigh = lambda i: F.floor((F.get(rgb, i * 3) * r + F.get(rgb, i * 3 + 1) * g + F.get(rgb, i * 3 + 2) * b + GRAY_DIVISOR // 2) / GRAY_DIVISOR).cast("int")
    return F.transform(F.sequence(F.lit(0), (F.size(rgb) / 3).cast("int") - 1), weigh)


def border_mean(gray: Column, width: int, height: int) -> Column:
    """Mean of the border pixels, corners once."""
    edge = F.filter(gray, lambda v, i: (i < width) | (i >= width * (height - 1)) | (i % width == 0) | (i % width == width - 1))
    return F.aggregate(edge, F.lit(0), lambda a, v: a + v) / F.size(edge)


def invert_if(gray: Column, inverted: Column) -> Column:
    return F.when(inverted, F.transform(gray, lambda v: 255 - v)).otherwise(gray)


def dynamic_range(gray: Column) -> Column:
    """Stretch to 0..255, rounding half up; a constant raster stays."""

    def stretch(x: Column) -> Column:
        low, span = x["low"], x["high"] - x["low"]
        return F.when(span == 0, x["px"]).otherwise(F.transform(x["px"], lambda v: F.floor(((v - low) * 255 + F.floor(span / 2)) / span).cast("int")))

    return let(lambda g: let(stretch, px=g["px"], low=F.array_min(g["px"]), high=F.array_max(g["px"])), px=gray)


def foreground_box(gray: Column, width: int, height: int, threshold: int = 200) -> Column:
    """``x0, y0, x1, y1`` (half open) of the pixels under the threshold, the whole raster if there is none, and ``empty``."""

    def sides(x: Column) -> Column:
        xs, ys = F.transform(x["at"], lambda i: i % width), F.transform(x["at"], lambda i: F.floor(i / width).cast("int"))
        some = F.size(x["at"]) > 0
        return F.struct(
            F.when(some, F.array_min(xs)).otherwise(0).alias("x0"),
            F.when(some, F.array_min(ys)).otherwise(0).alias("y0"),
            F.when(some, F.array_max(xs) + 1).otherwise(width).alias("x1"),
            F.when(some, F.array_max(ys) + 1).otherwise(height).alias("y1"),
            (~some).alias("empty"),
        )

    dark = lambda g: F.filter(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.get(g["px"], i) < threshold)
    return let(lambda g: let(sides, at=dark(g)), px=gray)


def crop(gray: Column, width: int, box: Column) -> Column:
    inside = lambda b, i: (i % width >= b["x0"]) & (i % width < b["x1"]) & (F.floor(i / width) >= b["y0"]) & (F.floor(i / width) < b["y1"])
    return let(lambda x: F.filter(x["px"], lambda v, i: inside(x["box"], i)), px=gray, box=box)


def fit(width: Column, height: Column, spec: Spec) -> tuple[Column, Column]:
    """The size that fits the target and keeps the aspect."""
    scale = F.least(F.lit(float(spec.image_width)) / width, F.lit(float(spec.image_height)) / height)
    side = lambda n, most: F.least(F.lit(most), F.greatest(F.lit(1), F.floor(n * scale + 0.5).cast("int")))
    return side(width, spec.image_width), side(height, spec.image_height)


def bilinear(pixels: Column, w: Column, h: Column, to_w: Column, to_h: Column) -> Column:
    """Half-pixel centers, clamped edges, double arithmetic, half up."""

    def resize(s: Column) -> Column:
        w, h, to_w, to_h = s["w"], s["h"], s["to_w"], s["to_h"]

        def value(i: Column) -> Column:
            x = ((i % to_w) + F.lit(0.5)) * w / to_w - 0.5
            y = (F.floor(i / to_w) + F.lit(0.5)) * h / to_h - 0.5
            clamp = lambda v, most: F.least(F.greatest(v, F.lit(0)), most - 1).cast("int")
            x0, x1, y0, y1 = clamp(F.floor(x), w), clamp(F.floor(x) + 1, w), clamp(F.floor(y), h), clamp(F.floor(y) + 1, h)
            wx, wy = x - F.floor(x), y - F.floor(y)
            at = lambda yy, xx: F.get(s["px"], (yy * w + xx).cast("int")).cast("double")
            top = at(y0, x0) * (1 - wx) + at(y0, x1) * wx
            bottom = at(y1, x0) * (1 - wx) + at(y1, x1) * wx
            return F.least(F.greatest(F.floor(top * (1 - wy) + bottom * wy + 0.5), F.lit(0)), F.lit(255)).cast("int")

        return F.transform(F.sequence(F.lit(0), to_w * to_h - 1), value)

    return let(resize, px=pixels, w=w, h=h, to_w=to_w, to_h=to_h)


def center_pad(pixels: Column, w: Column, h: Column, spec: Spec) -> Column:
    """The target raster; an odd remainder goes right and down."""

    def pad(s: Column) -> Column:
        def value(i: Column) -> Column:
            x, y = i % spec.image_width - s["left"], F.floor(i / spec.image_width).cast("int") - s["top"]
            inside = (x >= 0) & (x < s["w"]) & (y >= 0) & (y < s["h"])
            return F.when(inside, F.get(s["px"], y * s["w"] + x)).otherwise(spec.padding_value)

        return F.transform(F.sequence(F.lit(0), F.lit(spec.image_width * spec.image_height - 1)), value)

    left, top = F.floor((spec.image_width - w) / 2).cast("int"), F.floor((spec.image_height - h) / 2).cast("int")
    return let(pad, px=pixels, w=w, h=h, left=left, top=top)


def standardize(pixels: Column, spec: Spec = Spec()) -> Column:
    """Float32 ``(v / 255 - mean) / std``, rounded at each step."""
    f = lambda c: c.cast("float")
    return F.transform(pixels, lambda v: f((f(f(v) / f(F.lit(255.0))) - f(F.lit(spec.mean))) / f(F.lit(spec.std))))


def process(rgba: np.ndarray, spec: Spec = Spec()) -> dict:
    """All steps on one H x W x 4 raster of bytes: ``image, tensor`` and what was done."""
    s = rgba.astype(np.int64)
    a = s[..., 3:]
    rgb = (s[..., :3] * a + np.array(spec.alpha_background) * (255 - a) + 127) // 255
    gray = (rgb @ np.array(GRAY) + GRAY_DIVISOR // 2) // GRAY_DIVISOR
    height, width = gray.shape
    edge = np.ones(gray.shape, bool)
    edge[1:-1, 1:-1] = False
    inverted = bool(gray[edge].mean() < spec.polarity_border_threshold)
    gray = 255 - gray if inverted else gray
    low, span = int(gray.min()), int(gray.max() - gray.min())
    gray = ((gray - low) * 255 + span // 2) // span if span else gray
    ys, xs = np.nonzero(gray < spec.foreground_threshold)
    empty = not len(xs)
    x0, y0, x1, y1 = (0, 0, width, height) if empty else (int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1)
    part = gray[y0:y1, x0:x1]
    h, w = part.shape
    scale = min(spec.image_width / w, spec.image_height / h)
    to_w, to_h = (min(most, max(1, int(np.floor(n * scale + 0.5)))) for n, most in ((w, spec.image_width), (h, spec.image_height)))
    if (to_w, to_h) != (w, h):
        taps = []
        for n, to in ((w, to_w), (h, to_h)):
            at = (np.arange(to) + 0.5) * n / to - 0.5
            base = np.floor(at).astype(np.int64)
            taps.append((np.clip(base, 0, n - 1), np.clip(base + 1, 0, n - 1), at - base))
        (xa, xb, wx), (ya, yb, wy) = taps
        rows = [part[np.ix_(y, xa)] * (1 - wx) + part[np.ix_(y, xb)] * wx for y in (ya, yb)]
        part = np.clip(np.floor(rows[0] * (1 - wy)[:, None] + rows[1] * wy[:, None] + 0.5), 0, 255)
    left, top = (spec.image_width - to_w) // 2, (spec.image_height - to_h) // 2
    image = np.full((spec.image_height, spec.image_width), spec.padding_value, np.uint8)
    image[top : top + to_h, left : left + to_w] = part
    one = (image.astype(np.float32) / np.float32(255) - np.float32(spec.mean)) / np.float32(spec.std)
    return {
        "image": image,
        "tensor": np.stack([one] * 3),
        "bbox": (x0, y0, x1, y1),
        "input_size": (width, height),
        "crop_size": (w, h),
        "resize_size": (to_w, to_h),
        "padding": (left, top, spec.image_width - to_w - left, spec.image_height - to_h - top),
        "inverted": inverted,
        "empty": empty,
    }


RESULT = "image_sha256 string, tensor_sha256 string, x0 int, y0 int, x1 int, y1 int, resize_width int, resize_height int, inverted boolean, empty boolean"


def preprocess(rows: DataFrame, spec: Spec = Spec(), key: str = "id") -> DataFrame:
    """``key`` and digests and metadata of each raster of ``rows`` (``data`` RGBA bytes, ``width, height``)."""
    import hashlib

    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, data, w, h in zip(b[key], b["data"], b["width"], b["height"]):
                r = process(np.frombuffer(data, np.uint8).reshape(h, w, 4), spec)
                out.append((k, hashlib.sha256(r["image"].tobytes()).hexdigest(), hashlib.sha256(r["tensor"].astype("<f4").tobytes()).hexdigest(), *r["bbox"], *r["resize_size"], r["inverted"], r["empty"]))
            yield pd.DataFrame(out, columns=[key, *(x.split()[0] for x in RESULT.split(", "))])

    return rows.select(key, "data", "width", "height").mapInPandas(run, f"{key} {kind}, {RESULT}")


def from_image_source(images: DataFrame) -> DataFrame:
    """Rows of Spark's ``image`` source as ``id, data`` (RGBA), ``width, height``: BGR(A) is turned, gray spread, alpha added."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for origin, data, w, h, n in b.itertuples(index=False):
                raw = np.frombuffer(data, np.uint8).reshape(h, w, n)
                color = np.repeat(raw, 3, axis=2) if n == 1 else raw[..., [2, 1, 0]]
                alpha = raw[..., 3:] if n == 4 else np.full((h, w, 1), 255, np.uint8)
                out.append((origin, np.concatenate([color, alpha], axis=2).tobytes(), w, h))
            yield pd.DataFrame(out, columns=["id", "data", "width", "height"])

    return images.select("image.origin", "image.data", "image.width", "image.height", "image.nChannels").mapInPandas(run, "id string, data binary, width int, height int")
