"""Digests and checks of stored artifacts, and comparisons of layer outputs, as column expressions."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texweave.operators.raster import Spec

NUL = bytearray(b"\0")


def artifact_sha256(files: DataFrame) -> DataFrame:
    """``artifact, sha256`` of ``artifact, name, payload`` rows: each name and payload ended by NUL, in the order of names.

    An artifact is a handful of small files, so its rows are gathered in one place.
    """
    part = F.concat(F.encode("name", "UTF-8"), F.lit(NUL), F.col("payload"), F.lit(NUL))
    ordered = F.array_sort(F.collect_list(F.struct("name", part.alias("part"))))
    joined = F.aggregate(F.transform(ordered, lambda x: x["part"]), F.lit(bytearray()), lambda a, x: F.concat(a, x))
    return files.groupBy("artifact").agg(F.sha2(joined, 256).alias("sha256"))


def fixture_sha256(image: Column, gray: Column, tensor: Column, metadata: Column) -> Column:
    """One digest over the bytes of image, grayscale and tensor and the canonical JSON of the metadata."""
    return F.sha2(F.concat(image, gray, tensor, F.encode(metadata, "UTF-8")), 256)


def valid_raster(data: Column, width: Column, height: Column) -> Column:
    """Whether bytes are an RGBA raster of positive size."""
    return (width > 0) & (height > 0) & (F.length(data) == width * height * 4)


def valid_pixels(values: Column, spec: Spec = Spec()) -> Column:
    """Whether an array holds three channels of the specified size."""
    return F.size(values) == 3 * spec.image_width * spec.image_height


def pad_right_bottom(pixels: Column, width: int, height: int, right: int = 1, bottom: int = 1) -> Column:
    """A raster in row order with zero columns on the right and zero rows below."""
    if right < 0 or bottom < 0:
        raise ValueError("padding is not negative")
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.concat(F.slice(pixels, y * width + 1, F.lit(width)), F.array_repeat(F.lit(0), right)))
    return F.concat(F.flatten(rows), F.array_repeat(F.lit(0), (width + right) * bottom))


ACTIVATIONS = {"relu": lambda x: F.greatest(x, F.lit(0).cast("double"))}


def activation(name: str, value: Column) -> Column:
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation {name!r}")
    return ACTIVATIONS[name](value.cast("double"))


def pair_ids(first: Column, second: Column, bos: int, eos: int) -> Column:
    """Ids of two texts in one sequence: BOS, the first, EOS, the second, EOS."""
    return F.concat(F.array(F.lit(bos)), first, F.array(F.lit(eos)), second, F.array(F.lit(eos)))


def compare_stages(reference: DataFrame, actual: DataFrame) -> DataFrame:
    """``stage, max_abs_error, mean_abs_error, relative_error`` of outputs ``stage, at, value`` of two models, joined by stage and place.

    The relative error is the norm of the difference over that of the
    reference, which counts as 1e-12 at least.
    """
    both = reference.select("stage", "at", F.col("value").alias("r")).join(actual.select("stage", "at", F.col("value").alias("a")), ["stage", "at"])
    off = F.abs(F.col("a") - F.col("r"))
    norm = lambda x: F.sqrt(F.sum(x * x))
    relative = norm(off) / F.greatest(norm(F.col("r")), F.lit(1e-12))
    return both.groupBy("stage").agg(F.max(off).alias("max_abs_error"), F.avg(off).alias("mean_abs_error"), relative.alias("relative_error"))


def load_spec(path: str) -> Spec:
    """A stored preprocessing spec; anything but a JSON object with its values is an error."""
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError("a spec is a JSON object")
    plain = Spec()
    found = Spec(**{k: tuple(value[k]) if isinstance(value[k], list) else value[k] for k in vars(plain)})
    rest = {k: v for k, v in plain.to_dict().items() if k not in vars(plain)}
    wrong = sorted(k for k, v in rest.items() if value.get(k) != v)
    if wrong:
        raise ValueError(f"the spec differs in {wrong}")
    return found


def save_spec(spec: Spec, path: str) -> None:
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(json.dumps(spec.to_dict(), ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")
