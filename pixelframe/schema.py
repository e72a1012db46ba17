"""Columns of the relations that stand for images.

An image is a dense relation of pixels: image_id, y, x and one integer column a channel (c0, c1, ...). Images of any
number share one relation; windows and joins are keyed by image_id, so that images are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import types as T

#: A packed image, with the fields of Spark's own image source.
IMAGE_SCHEMA = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("nChannels", T.IntegerType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)

#: Where a pixel is.
PLACE = ["image_id", "y", "x"]


def channels(columns: list[str]) -> list[str]:
    """The channel columns among columns: c0, c1, ..."""
    return [c for c in columns if len(c) > 1 and c[0] == "c" and c[1:].isdigit()]
