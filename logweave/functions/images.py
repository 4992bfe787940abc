"""Image payloads as bytes: layouts, colour conversion and cropping by numpy in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of channels in each encoding.
CHANNELS = {"gray": "L", "mono8": "L", "rgb": "RGB", "rgb8": "RGB", "bgr": "BGR", "bgr8": "BGR", "rgba": "RGBA", "rgba8": "RGBA", "bgra": "BGRA", "bgra8": "BGRA"}


def payload_layout(fields: list[str]) -> str | None:
    """``raw`` for data with height, width and encoding, ``packed`` for data with a format, else None."""
    names = set(fields)
    return "raw" if {"data", "height", "width", "encoding"} <= names else "packed" if {"data", "format"} <= names else None


def convert(pixels: np.ndarray, source: str, target: str) -> np.ndarray:
    """Channels of an (h, w, c) image in another order; alpha is dropped or added opaque, gray is the mean of the colours."""
    a, b = CHANNELS[source], CHANNELS[target]
    if pixels.ndim == 2:
        pixels = pixels[:, :, None]
    if pixels.shape[2] != len(a):
        raise ValueError(f"{source} has {len(a)} channels, the image {pixels.shape[2]}")
    if b == "L":
        return pixels if a == "L" else pixels[:, :, :3].astype(np.float64).mean(axis=2, keepdims=True).astype(np.uint8)
    opaque = np.full((*pixels.shape[:2], 1), 255, dtype=np.uint8)
    return np.concatenate([pixels[:, :, [0]] if a == "L" and c != "A" else pixels[:, :, [a.index(c)]] if c in a else opaque for c in b], axis=2)


def crop(pixels: np.ndarray, left: int, top: int, width: int, height: int) -> np.ndarray:
    """A box inside an image; one that leaves it is an error."""
    if min(left, top) < 0 or min(width, height) <= 0 or top + height > pixels.shape[0] or left + width > pixels.shape[1]:
        raise ValueError("the box leaves the image")
    return pixels[top : top + height, left : left + width]


def _each(data, height, width, channels, step) -> pd.Series:
    out = []
    for d, h, w in zip(data, height, width, strict=True):
        try:
            out.append(step(np.frombuffer(d, dtype=np.uint8).reshape(int(h), int(w), channels)).tobytes())
        except (TypeError, ValueError):  # a failed transform is a missing value
            out.append(None)
    return pd.Series(out, dtype=object)


def color_convert(data: Column, height: Column, width: Column, source: str, target: str) -> Column:
    """Pixels in another channel order; null when they don't fit their size."""

    @F.pandas_udf("binary")
    def run(d: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return _each(d, h, w, len(CHANNELS[source]), lambda x: convert(x, source, target))

    return run(data, height, width)


def image_crop(data: Column, height: Column, width: Column, channels: int, box: tuple[int, int, int, int]) -> Column:
    """Pixels inside ``(left, top, width, height)``; null when the box leaves the image."""

    @F.pandas_udf("binary")
    def run(d: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return _each(d, h, w, channels, lambda x: crop(x, *box))

    return run(data, height, width)


def pixel_bytes(pixels: Column) -> Column:
    """An integer list of pixels as bytes (the compact layout); null when a value is no byte."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            a = None if v is None else np.asarray(v)
            out.append(a.astype(np.uint8).tobytes() if a is not None and (a.size == 0 or (a.min() >= 0 and a.max() <= 255)) else None)
        return pd.Series(out, dtype=object)

    return run(pixels)


def payload(pixels: Column, contract: str = "bytes_v2") -> Column:
    """An integer list of pixels as an output holds it: ``bytes_v2`` as bytes (an error where a value is no byte), ``legacy_list_v1`` as it is."""
    if contract == "legacy_list_v1":
        return pixels.cast("array<bigint>")
    if contract != "bytes_v2":
        raise ValueError(f"unknown image payload contract {contract!r}")
    whole = F.forall(pixels, lambda x: x.between(0, 255))
    return F.when(pixels.isNotNull(), F.when(whole, pixel_bytes(pixels)).otherwise(F.raise_error(F.lit("image data values must be in the range 0 to 255")).cast("binary")))
