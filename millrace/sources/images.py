"""Images as rows: scan, resize, normalise, histograms and flips in Arrow batches.

Tables carry an ``image`` struct (height, width, nChannels, data) with interleaved bytes in
blue-green-red order, as Spark's image source gives it.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_images(spark: SparkSession, path, pattern=None, recursive=False):
    """(origin, image) of every decodable image under ``path``."""
    reader = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("image.origin", F.struct("image.height", "image.width", "image.nChannels", "image.data").alias("image"))


def pixels(image):
    """Height x width x 3 array in red-green-blue order."""
    a = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])
    return np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, 2::-1]


def _axis_weights(size, target):
    """Share of every source cell in every target cell along one axis."""
    edges = np.arange(target + 1) * (size / target)
    lo, hi = np.maximum(edges[:-1, None], np.arange(size)), np.minimum(edges[1:, None], np.arange(size) + 1)
    w = np.maximum(hi - lo, 0)
    return w / w.sum(1, keepdims=True)


def resize(a, width, height):
    """Area-mean resize."""
    return np.einsum("yi,ijc,xj->yxc", _axis_weights(a.shape[0], height), a.astype(float), _axis_weights(a.shape[1], width))


#: Pictures whose results a task holds at once.
PICTURES = 256


def _few(batches):
    """Batches of at most PICTURES rows, since a result can be many times larger than its picture."""
    for pdf in batches:
        for first in range(0, len(pdf), PICTURES):
            yield pdf.iloc[first : first + PICTURES].reset_index(drop=True)


def process(df: DataFrame, key, operations=({"type": "resize"}, {"type": "normalize"})):
    """Apply resize / normalize / flip operations in order: (key, height, width, channels, values)."""

    def one(a):
        for op in operations:
            if op["type"] == "resize":
                a = resize(a, op.get("width", 224), op.get("height", 224))
            elif op["type"] == "normalize":
                a = a / 255.0
            elif op["type"] == "flip":
                a = a[:, ::-1] if op.get("axis", "horizontal") == "horizontal" else a[::-1]
            else:
                raise ValueError(f"unknown image operation {op['type']}")
        return a

    def run(batches):
        for pdf in _few(batches):
            arrays = [one(pixels(i)) for i in pdf["image"]]
            yield pd.DataFrame({key: pdf[key], "height": [a.shape[0] for a in arrays], "width": [a.shape[1] for a in arrays], "channels": [a.shape[2] for a in arrays],
                                "values": [a.astype("float32").ravel() for a in arrays]})

    return df.select(key, "image").mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, height int, width int, channels int, values array<float>")


def histograms(df: DataFrame, key):
    """256 bin counts per channel, red, green, blue after each other."""

    def run(batches):
        for pdf in _few(batches):
            rows = []
            for i in pdf["image"]:
                a = pixels(i)
                rows.append(np.concatenate([np.bincount(a[:, :, c].ravel(), minlength=256) for c in range(3)]))
            yield pd.DataFrame({key: pdf[key], "histogram": rows})

    return df.select(key, "image").mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, histogram array<long>")


def augment_flips(df: DataFrame, key, copies=1, seed=42, horizontal=True, vertical=True):
    """``copies`` seeded flips per image: (key, copy, flips, height, width, channels, values)."""
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed + salt), F.col(key), F.col("copy")), F.lit(2)) == 1
    many = df.select(key, "image", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    many = many.withColumns({"h": draw(0) & F.lit(horizontal), "v": draw(1) & F.lit(vertical)})

    def run(batches):
        for pdf in _few(batches):
            out = []
            for image, h, v in zip(pdf["image"], pdf["h"], pdf["v"]):
                a = pixels(image)
                a = a[:, ::-1] if h else a
                out.append(a[::-1] if v else a)
            yield pd.DataFrame({key: pdf[key], "copy": pdf["copy"], "horizontal": pdf["h"], "vertical": pdf["v"], "height": [a.shape[0] for a in out],
                                "width": [a.shape[1] for a in out], "channels": 3, "values": [a.astype("float32").ravel() for a in out]})

    kind = df.schema[key].dataType.simpleString()
    return many.mapInPandas(run, f"{key} {kind}, copy int, horizontal boolean, vertical boolean, height int, width int, channels int, values array<float>")
