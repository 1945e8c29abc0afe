"""Camera models: from a point of the image plane at depth 1 to pixels, as Column expressions, and back.

Parameters are in the order of the formats (tessella.sources.model): one focal length or two, the principal point, then the distortion.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE_FOCAL = {"SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL", "SIMPLE_RADIAL_FISHEYE", "RADIAL_FISHEYE"}


class Columns:
    """The functions that distort() needs, for Columns."""

    sqrt, atan, tan = F.sqrt, F.atan, F.tan

    @staticmethod
    def where(c, a, b):
        return F.when(c, a).otherwise(b)


class Arrays:
    sqrt, atan, tan, where = np.sqrt, np.arctan, np.tan, np.where


def distort(model: str, k: Sequence[float], u, v, of=Columns):
    """The distorted point. k: the parameters after the principal point; of: Columns or Arrays."""
    if model in ("SIMPLE_PINHOLE", "PINHOLE"):
        return u, v
    r2 = u * u + v * v
    if model == "FOV":
        r = of.sqrt(r2)
        safe = of.where(r2 > 1e-12, r, 1.0)
        scale = of.where(r2 > 1e-12, of.atan(safe * (2 * np.tan(k[0] / 2))) / k[0] / safe, 1.0)
        return u * scale, v * scale
    if "FISHEYE" in model:
        r = of.sqrt(r2)
        safe = of.where(r2 > 1e-12, r, 1.0)
        scale = of.where(r2 > 1e-12, of.atan(safe) / safe, 1.0)
        u, v = u * scale, v * scale
        r2 = u * u + v * v
    radial = {"SIMPLE_RADIAL": k[:1], "RADIAL": k[:2], "OPENCV": k[:2], "OPENCV_FISHEYE": k[:4], "FULL_OPENCV": [*k[:2], *k[4:5]], "SIMPLE_RADIAL_FISHEYE": k[:1], "RADIAL_FISHEYE": k[:2], "THIN_PRISM_FISHEYE": [*k[:2], *k[4:6]]}[model]

    def series(c: Sequence[float]):
        out, power = 1.0, 1.0
        for x in c:
            power = r2 * power
            out = x * power + out
        return out

    scale = series(radial)
    if model == "FULL_OPENCV":
        scale = scale / series(k[5:8])
    du, dv = u * scale, v * scale
    if model in ("OPENCV", "FULL_OPENCV", "THIN_PRISM_FISHEYE"):
        p1, p2 = k[2], k[3]
        du = du + u * v * (2 * p1) + (r2 + u * u * 2) * p2
        dv = dv + u * v * (2 * p2) + (r2 + v * v * 2) * p1
    if model == "THIN_PRISM_FISHEYE":
        du, dv = du + r2 * k[6], dv + r2 * k[7]
    return du, dv


def split_parameters(model: str, p: Sequence[float]) -> tuple[float, float, float, float, list[float]]:
    """(focal lengths, principal point, distortion)."""
    return (p[0], p[0], p[1], p[2], list(p[3:])) if model in ONE_FOCAL else (p[0], p[1], p[2], p[3], list(p[4:]))


def to_pixels(model: str, p: Sequence[float], u: Column, v: Column) -> tuple[Column, Column]:
    fx, fy, cx, cy, k = split_parameters(model, p)
    du, dv = distort(model, k, u, v)
    return du * fx + cx, dv * fy + cy


def undistorted(pixels: DataFrame, model: str, p: Sequence[float], steps: int = 100) -> DataFrame:
    """pixels (px, py and other columns) with u, v: the point is moved, step by step, by how far its distorted place is off."""
    fx, fy, cx, cy, k = split_parameters(model, p)
    schema = ", ".join(f"{c} {t}" for c, t in pixels.dtypes) + ", u double, v double"
    places = [pixels.columns.index("px"), pixels.columns.index("py")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = (batch.column(places[0]).to_numpy(zero_copy_only=False) - cx) / fx
            b = (batch.column(places[1]).to_numpy(zero_copy_only=False) - cy) / fy
            u, v = a.copy(), b.copy()
            for _ in range(steps):
                du, dv = distort(model, k, u, v, Arrays)
                u, v = u + (a - du), v + (b - dv)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(u), pa.array(v)], names=[*batch.schema.names, "u", "v"])

    return pixels.mapInArrow(run, schema)
