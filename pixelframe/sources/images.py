"""Image files, image sets and packed images as relations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import extension, file_name, number_in_name
from ..schema import IMAGE_SCHEMA, PLACE, channels
from ..scratch import numbered, ship_code
from . import codecs

#: OpenCV-style mode of 8-bit images by channel count. Fixed values.
MODES = {1: 0, 3: 16, 4: 24}
FRAME_SCHEMA = T.StructType([T.StructField("set_id", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("delay", T.IntegerType()), T.StructField("image", IMAGE_SCHEMA)])
VIDEO = ("avi", "mp4", "mov", "mkv", "wmv", "mpg")


#: What a batch of frames is to Arrow.
_IMAGE = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])
_FRAME = pa.schema([("set_id", pa.string()), ("frame", pa.int32()), ("name", pa.string()), ("delay", pa.int32()), ("image", _IMAGE)])
Batches = Iterator[pa.RecordBatch]


def _made(build: Callable, step: Callable[[Batches], Batches], schema) -> DataFrame:
    """build(step, schema), a frame that remembers how it is made, for _then()."""
    out = build(step, schema)
    out._chain = build, step  # type: ignore[attr-defined]
    return out


def _then(df: DataFrame, step: Callable[[Batches], Batches], schema) -> DataFrame:
    """A further step on the batches of df, in the Python worker that makes them if df comes straight from one: a task then has one worker however many steps there are, and images pass one by one."""
    build, before = getattr(df, "_chain", (df.mapInArrow, None))
    return _made(build, step if before is None else lambda batches: step(before(batches)), schema)


def _one_frame(set_id: str, frame: int, name: str, delay: int, image: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"set_id": set_id, "frame": frame, "name": name, "delay": delay, "image": image}], schema=_FRAME)


def packed(origin: str | None, image: np.ndarray) -> dict:
    h, w, n = image.shape
    return {"origin": origin, "height": h, "width": w, "nChannels": n, "mode": MODES[n], "data": np.ascontiguousarray(image, np.uint8).tobytes()}


def array_of(image) -> np.ndarray:
    """The array of a packed image, given as a row or a dict."""
    d = image if isinstance(image, dict) else image.asDict()
    return np.frombuffer(bytes(d["data"]), np.uint8).reshape(d["height"], d["width"], d["nChannels"])


def decode(name: str, data: bytes) -> list[tuple[int, np.ndarray]]:
    """(delay, image) of every frame of a file, by its first bytes."""
    if data[:3] == b"GIF":
        return [(f["delay"], codecs.gif_pixels(f)) for f in codecs.read_gif(data)]
    if data[:2] == b"BM":
        return [(0, codecs.read_bmp(data))]
    if data[:4] == b"\x89PNG":
        return [(0, codecs.read_png(data))]
    if data[:4] == codecs.MATRIX_MAGIC.to_bytes(4, "little"):
        return [(0, codecs.read_matrix(data).astype(np.uint8))]
    raise ValueError(f"{name}: no decoder for this file")


def list_files(spark: SparkSession, path: str, ext: str = "") -> DataFrame:
    """(path, name, place): files of a folder in order of the number in their names if every name has one, else by name. ext: one extension, whatever its case."""
    files = spark.read.format("binaryFile").load(path).select("path")
    files = files.withColumn("name", file_name(F.col("path")))
    if ext:
        files = files.where(extension(F.col("path")) == ext.lower().lstrip("."))
    return order_names(files)


def order_names(files: DataFrame) -> DataFrame:
    """Add place to (path, name)."""
    named = files.withColumn("_n", number_in_name(F.col("name")))
    every = named.agg(F.count_if(F.col("_n").isNull()).alias("_missing"))
    keyed = named.crossJoin(F.broadcast(every)).withColumn("_n", F.when(F.col("_missing") == 0, F.col("_n"))).drop("_missing")
    return numbered(keyed, ["_n", "name", "path"], "place").drop("_n")


def read_images(spark: SparkSession, path: str, n_channels: int | None = None, set_id: str = "set") -> DataFrame:
    """Frames (FRAME_SCHEMA) of all image files at path (a folder, a glob or a file), decoded on the executors. n_channels forces a channel count.

    Files' places and numbers of frames are found first, so that no decoded image goes through a shuffle to be numbered."""
    ship_code(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(codecs.read_gif(d.as_py())) if d.as_py()[:3] == b"GIF" else 1 for d in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["path", "frames"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, content, name, first = (c[k].as_py() for c in batch.columns)
                for i, (d, im) in enumerate(decode(path, content)):
                    yield _one_frame(set_id, first + i, name, d, packed(path, force_channels(im, n_channels)))

    counted = files.mapInArrow(count, "path string, frames long")
    order = order_names(counted.withColumn("name", file_name(F.col("path"))))
    order = numbered(order, ["place"], "first", "frames").select("path", "name", "first")
    out = _then(files.join(order, "path").select("path", "content", "name", "first"), run, FRAME_SCHEMA)
    out._n_channels = n_channels  # type: ignore[attr-defined]
    return out


def force_channels(image: np.ndarray, n: int | None) -> np.ndarray:
    have = image.shape[2]
    if n is None or have == n:
        return image
    if n == 1:
        b, g, r = (image[..., k].astype(np.int64) for k in range(3))
        return ((b * 1868 + g * 9617 + r * 4899 + 8192) >> 14).astype(np.uint8)[..., None]
    if have == 1:
        out = np.repeat(image, 3, axis=2)
        return out if n == 3 else np.concatenate((out, np.full_like(image, 255)), axis=2)
    if have == 4 and n == 3:
        return image[..., :3]
    return np.concatenate((image, np.full((*image.shape[:2], 1), 255, np.uint8)), axis=2)


def select_frames(frames: DataFrame, wanted: list[int]) -> DataFrame:
    """The named frames; numbers out of range name nothing."""
    return frames.where(F.col("frame").isin(wanted))


def kind_of(config: str) -> str:
    """Which source a path asks for: video or images, by extension."""
    return "video" if config.rsplit(".", 1)[-1].lower() in VIDEO else "images"


def open_images(spark: SparkSession, config: str, kind: str = "*", n_channels: int = 0) -> DataFrame:
    """Frames of whatever config names. kind: v for video, f for files, * to tell by the extension."""
    if kind == "v" or kind == "*" and kind_of(config) == "video":
        raise NotImplementedError("video needs a decoder that is not part of this library")
    return read_images(spark, config, n_channels or None)


def from_arrays(spark: SparkSession, images: list[np.ndarray], title: str = "") -> DataFrame:
    """Frames held in memory."""
    return spark.createDataFrame([(title, k, f"{k:03d}", 0, packed(None, im)) for k, im in enumerate(images)], FRAME_SCHEMA)


def generate(spark: SparkSession, n: int, make: Callable[[int], np.ndarray | None], title: str = "generated") -> DataFrame:
    """Frames 0 to n - 1 that make(k) gives, on the executors; None is no frame."""
    ship_code(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(title, int(k), f"{int(k):03d}", 0, packed(None, im)) for k in batch["id"] if (im := make(int(k))) is not None]
            yield pd.DataFrame(rows, columns=["set_id", "frame", "name", "delay", "image"])

    return spark.range(n).mapInPandas(run, FRAME_SCHEMA)


def explode(frames: DataFrame) -> DataFrame:
    """Packed frames of one channel count to pixels: (image_id, y, x, c0, ...), image_id the frame's number."""
    ship_code(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                im = array_of(batch.column("image")[k].as_py())
                h, w, n = im.shape
                if n > count:
                    raise ValueError(f"an image has {n} channels, not {count}")
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
                flat = im.reshape(-1, n).astype(np.int32)
                cols = [pa.array(np.full(h * w, batch.column("frame")[k].as_py(), np.int64)), pa.array(y), pa.array(x), *(pa.array(np.ascontiguousarray(flat[:, c])) for c in range(n))]
                yield pa.RecordBatch.from_arrays(cols, names)

    count = getattr(frames, "_n_channels", None) or frames.agg(F.max("image.nChannels")).first()[0] or 1
    names = [*PLACE, *[f"c{c}" for c in range(count)]]
    return _then(frames, run, "image_id long, y int, x int" + "".join(f", c{c} int" for c in range(count)))


def pack(pixels: DataFrame, set_id: str = "packed") -> DataFrame:
    """Pixels to packed frames, one image a task; pixels that are missing are 0."""
    ship_code(pixels.sparkSession)
    cs = channels(pixels.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, k, h, w = [], 0, 0, 0
        for batch in batches:
            k = batch.column(0)[0].as_py()
            y, x, *values = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 3 + len(cs)))
            h, w = max(h, int(y.max()) + 1), max(w, int(x.max()) + 1)
            held.append((y.copy(), x.copy(), np.stack(values, axis=1).astype(np.uint8)))
        im = np.zeros((h, w, len(cs)), np.uint8)
        for y, x, values in held:
            im[y, x] = values
        yield _one_frame(set_id, k, f"{k:03d}", 0, packed(None, im))

    def build(step: Callable[[Batches], Batches], schema) -> DataFrame:
        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from step(batches)

        return pixels.select(*PLACE, *cs).groupBy("image_id").applyInArrow(one, schema)

    out = _made(build, run, FRAME_SCHEMA)
    out._n_channels = len(cs)  # type: ignore[attr-defined]
    return out


def encode(frames: DataFrame, form: str) -> DataFrame:
    """(frame, content): each frame as the bytes of a bmp, png or matrix file."""
    ship_code(frames.sparkSession)
    write = {"bmp": codecs.write_bmp, "png": codecs.write_png, "matrix": codecs.write_matrix}[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                body = write(array_of(batch.column("image")[k].as_py()))
                yield pa.RecordBatch.from_arrays([batch.column("frame").slice(k, 1), pa.array([body], pa.binary())], ["frame", "content"])

    return _then(frames, run, "frame int, content binary")


def decode_column(contents: DataFrame, set_id: str = "decoded") -> DataFrame:
    """(frame, content) to packed frames: those of a file are numbered from the file's own number."""
    ship_code(contents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                frame = batch.column("frame")[k].as_py()
                for j, (d, im) in enumerate(decode(str(frame), batch.column("content")[k].as_py())):
                    yield _one_frame(set_id, frame + j, f"{frame + j:03d}", d, packed(None, im))

    return _then(contents, run, FRAME_SCHEMA)


def encode_gif(pixels: DataFrame, palette: list[tuple[int, int, int]], delay: int = 10, transparent: tuple[int, int, int] | None = None) -> DataFrame:
    """(set_id, content): all images of pixels (image_id, y, x, idx) as the frames of one animation, in order of image_id. One file is one task's work."""
    from ..operators.palettes import nearest_entry

    ship_code(pixels.sparkSession)
    clear = nearest_entry(palette, transparent)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for _, one in pdf.sort_values("image_id").groupby("image_id"):
            im = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), np.uint8)
            im[one["y"], one["x"]] = one["idx"]
            frames.append(im)
        return pd.DataFrame({"set_id": ["gif"], "content": [codecs.write_gif(frames, palette, delay, clear)]})

    return pixels.select(F.lit("gif").alias("set_id"), *PLACE, "idx").groupBy("set_id").applyInPandas(run, "set_id string, content binary")


def write_files(contents: DataFrame, folder: str, ext: str, stem: str = "img") -> DataFrame:
    """(path, size): each content of (frame, content) as a file stem<frame>.ext in folder, a URI that driver and executors share. A file appears under its name only when it is whole."""
    import uuid

    ship_code(contents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, top = fs.FileSystem.from_uri(folder)
        where.create_dir(top, recursive=True)
        for batch in batches:
            rows = []
            for k, body in zip(batch.column("frame").to_pylist(), batch.column("content").to_pylist(), strict=True):
                name = f"{stem}{k}.{ext}"
                with where.open_output_stream(tmp := f"{top}/_{name}.{uuid.uuid4().hex}") as out:
                    out.write(body)
                where.move(tmp, f"{top}/{name}")
                rows.append((f"{folder}/{name}", len(body)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "size"])

    return _then(contents, run, "path string, size long")
