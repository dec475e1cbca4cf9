"""Images as BINARY columns: PNG decoding and encoding, blacking boxes out, text regions of a score map.

Bytes are read as PNG (8 and 16 bits, grey, RGB, palette, with alpha; not interlaced); there is no other codec library
here. Files of JPEG, BMP and GIF come through Spark's image source as rasters, which from_rasters() turns to PNG. WebP and
the orientation that a JPEG's camera notes are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Limits of an image and of its boxes, and what counts as a text region.
MOST_BYTES, MOST_SIDE, MOST_PIXELS, MOST_BOXES = 20 * 1024 * 1024, 8192, 16_000_000, 10_000
REGION_SCORE, REGION_AREA, MOST_REGIONS = 0.4, 20, 200
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def decode_png(data: bytes) -> np.ndarray:
    """RGBA pixels, height by width by 4. ValueError if it isn't a PNG within the limits."""
    if data[:8] != SIGNATURE or len(data) > MOST_BYTES:
        raise ValueError("undecodable")
    at, body, palette, clear = 8, [], None, None
    width = height = depth = kind = lace = 0
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if len(part) != n or zlib.crc32(name + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("undecodable")
        at += 12 + n
        if name == b"IHDR":
            width, height, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", part)
            if not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE and width * height <= MOST_PIXELS):
                raise ValueError("dimensions")
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = part
        elif name == b"IDAT":
            body.append(part)
        elif name == b"IEND":
            break
    planes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if planes is None or depth not in (8, 16) or lace:
        raise ValueError("undecodable")
    step, line = planes * depth // 8, width * planes * depth // 8
    raw = zlib.decompressobj().decompress(b"".join(body), height * (line + 1))
    if len(raw) != height * (line + 1):
        raise ValueError("undecodable")
    rows = np.frombuffer(raw, np.uint8).reshape(height, line + 1)
    out = np.zeros((height + 1, line), np.uint8)
    for y in range(height):
        out[y + 1] = _unfilter(int(rows[y, 0]), rows[y, 1:], out[y], step)
    px = out[1:].reshape(height, width, planes, depth // 8)[..., 0]
    rgba = np.full((height, width, 4), 255, np.uint8)
    if kind == 3:
        rgba[..., :3] = palette[px[..., 0]]
        if clear:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            rgba[..., 3] = alpha[px[..., 0]]
    else:
        rgba[..., :3] = px[..., :3] if planes >= 3 else px[..., :1]
        if planes in (2, 4):
            rgba[..., 3] = px[..., -1]
    return rgba


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    out, up = row.astype(int).tolist(), above.tolist()
    for i in range(len(out)):
        a, b, c = (out[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.uint8)


def encode_png(rgba: np.ndarray) -> bytes:
    """RGBA pixels as a PNG without anything else. ValueError over 20 MiB."""
    height, width = rgba.shape[:2]
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rgba.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda name, part: struct.pack(">I", len(part)) + name + part + struct.pack(">I", zlib.crc32(name + part))
    out = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")
    if len(out) > MOST_BYTES:
        raise ValueError("too large")
    return out


def blacked(rgba: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Pixels with boxes (x, y, w, h), clipped, in opaque black. ValueError if there are none, too many, or none touches the image."""
    if not 0 < len(boxes) <= MOST_BOXES:
        raise ValueError("boxes")
    height, width = rgba.shape[:2]
    out, changed = rgba.copy(), False
    for x, y, w, h in boxes:
        part = out[min(y, height) : min(y + h, height), min(x, width) : min(x + w, width)]
        changed |= part.size > 0
        part[...] = (0, 0, 0, 255)
    if not changed:
        raise ValueError("outside")
    return out


def redacted(images: DataFrame) -> DataFrame:
    """image_id, content (PNG, null where it failed) and status of images (image_id, content, boxes: array of struct x, y, w, h)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out, status = [], []
            for content, boxes in zip(b["content"].to_pylist(), b["boxes"].to_pylist(), strict=True):
                try:
                    out.append(encode_png(blacked(decode_png(content or b""), [(q["x"], q["y"], q["w"], q["h"]) for q in boxes or []])))
                    status.append("ok")
                except (ValueError, zlib.error, struct.error) as e:
                    out.append(None)
                    status.append(str(e) if isinstance(e, ValueError) else "undecodable")
            yield pa.RecordBatch.from_arrays([b["image_id"], pa.array(out, pa.binary()), pa.array(status)], ["image_id", "content", "status"])

    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "content", "boxes").mapInArrow(run, f"image_id {kind}, content binary, status string")


def normalised(images: DataFrame) -> DataFrame:
    """image_id, content (PNG of the pixels alone), width, height and status of images (image_id, content)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for content in b["content"].to_pylist():
                try:
                    px = decode_png(content or b"")
                    rows.append((encode_png(px), px.shape[1], px.shape[0], "ok"))
                except (ValueError, zlib.error, struct.error) as e:
                    rows.append((None, None, None, str(e) if isinstance(e, ValueError) else "undecodable"))
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b["image_id"], pa.array(c[0], pa.binary()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3])], ["image_id", "content", "width", "height", "status"])

    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "content").mapInArrow(run, f"image_id {kind}, content binary, width int, height int, status string")


def from_rasters(images: DataFrame) -> DataFrame:
    """image_id, content (PNG), width, height and status of rasters (image_id, width, height, channels, raster: rows from the top, blue first)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out, status = [], []
            for width, height, channels, raw in zip(*(b[c].to_pylist() for c in ("width", "height", "channels", "raster")), strict=True):
                try:
                    if not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE and width * height <= MOST_PIXELS):
                        raise ValueError("dimensions")
                    px = np.frombuffer(raw, np.uint8).reshape(height, width, channels)
                    rgba = np.full((height, width, 4), 255, np.uint8)
                    rgba[..., :3] = px[..., 2::-1] if channels >= 3 else px[..., :1]
                    if channels == 4:
                        rgba[..., 3] = px[..., 3]
                    out.append(encode_png(rgba))
                    status.append("ok")
                except ValueError as e:
                    out.append(None)
                    status.append(str(e))
            yield pa.RecordBatch.from_arrays([b["image_id"], pa.array(out, pa.binary()), b["width"], b["height"], pa.array(status)], ["image_id", "content", "width", "height", "status"])

    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "width", "height", "channels", "raster").mapInArrow(run, f"image_id {kind}, content binary, width int, height int, status string")


def regions(score: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of four-connected areas of high score, a pixel wider all round, in the order in which a scan meets them; the first 200.

    Rows are cut to runs; runs that touch in neighbouring rows are joined, and an area's box and size are those of its runs.
    """
    height, width = score.shape
    edge = np.diff(np.pad((score >= REGION_SCORE).astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, left), (_, stop) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    up = np.arange(len(row))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    first = np.searchsorted(row, np.arange(height + 1))
    for y in range(1, height):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if left[i] < stop[j] and left[j] < stop[i]:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
            i, j = (i + 1, j) if stop[i] < stop[j] else (i, j + 1)
    root = np.array([top(i) for i in range(len(row))], dtype=np.int64)
    out = []
    for r in np.unique(root).tolist():  # an area's first run is the first that a scan meets
        own = root == r
        if (stop[own] - left[own]).sum() < REGION_AREA:
            continue
        x, y = max(int(left[own].min()) - 1, 0), max(int(row[own].min()) - 1, 0)
        out.append((x, y, min(int(stop[own].max()) - int(left[own].min()) + 2, width - x), min(int(row[own].max()) - int(row[own].min()) + 3, height - y)))
        if len(out) == MOST_REGIONS:
            break
    return out


def detector_tensor(rgba: np.ndarray, most: int = 960, least: int = 32) -> np.ndarray:
    """A detector's input: longest side at most `most`, sides multiples of 32, RGB scaled by the usual means and deviations; channels first."""
    height, width = rgba.shape[:2]
    scale = min(1.0, most / max(height, width))
    h, w = (max(least, round(v * scale / least) * least) for v in (height, width))
    ys, xs = (np.minimum((np.arange(n) * m) // n, m - 1) for n, m in ((h, height), (w, width)))
    # Means and deviations of the usual image corpus.
    mean, deviation = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])
    return ((rgba[ys][:, xs, :3] / 255.0 - mean) / deviation).transpose(2, 0, 1).astype(np.float32)


def recogniser_tensor(rgba: np.ndarray, box: tuple[int, int, int, int], height: int = 48, most: int = 960) -> np.ndarray:
    """A recogniser's input: a box (x, y, w, h) of an image 48 high, its width in proportion but from 48 to 960, by linear interpolation; RGB from -1 to 1, channels first."""
    x, y, w, h = box
    crop = rgba[y : y + h, x : x + w, :3].astype(np.float64)
    width = int(min(max(height * crop.shape[1] // max(1, crop.shape[0]), height), most))

    def weights(n: int, m: int) -> np.ndarray:
        """A triangle filter from m pixels to n, as wide as a pixel of the coarser."""
        scale = max(1.0, m / n)
        reach = np.abs((np.arange(m) + 0.5)[None, :] - ((np.arange(n) + 0.5) * m / n)[:, None]) / scale
        out = np.maximum(0.0, 1 - reach)
        return out / out.sum(axis=1, keepdims=True)

    out = np.einsum("yh,hwc,xw->cyx", weights(height, crop.shape[0]), crop, weights(width, crop.shape[1]))
    return ((np.rint(out) / 255 - 0.5) / 0.5).astype(np.float32)


def rasters_blacked(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images (image_id, width, height, raster: RGBA, rows from the top) with the pixels inside a box (image_id, x, y, w, h) in opaque black; other columns give way.

    The same pixels as pixels_blacked() makes of rows, but an image is a row and meets its distinct boxes once, so what
    is shuffled grows with images and boxes, not with pixels. Boxes are clipped to the image; those without area, or
    with a null image or place, cover nothing. A null raster stays null.
    """
    box = F.struct(*[F.col(c).cast("long").alias(c) for c in "xywh"])
    sound = F.col("image_id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("w") > 0) & (F.col("h") > 0)
    own = boxes.where(sound).groupBy("image_id").agg(F.collect_set(box).alias("_boxes"))
    none = F.expr("cast(array() as array<struct<x: bigint, y: bigint, w: bigint, h: bigint>>)")
    d = images.select("image_id", "width", "height", "raster").join(own, "image_id", "left").withColumn("_boxes", F.coalesce("_boxes", none))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = b["_boxes"]
            each = lists.flatten()
            x, y, w, h = (each.field(i).to_numpy() for i in range(4))
            x0, y0, x1, y1 = (v.tolist() for v in (np.maximum(x, 0), np.maximum(y, 0), np.maximum(x + w, 0), np.maximum(y + h, 0)))
            ends = np.cumsum(lists.value_lengths().to_numpy()).tolist()
            out, at = [], 0
            for end, width, height, raw in zip(ends, b["width"].to_pylist(), b["height"].to_pylist(), b["raster"].to_pylist(), strict=True):
                if raw is not None and end > at:
                    px = np.frombuffer(raw, "<u4").reshape(height, width).copy()
                    for i in range(at, end):
                        px[y0[i] : y1[i], x0[i] : x1[i]] = 0xFF000000
                    raw = px.tobytes()
                out.append(raw)
                at = end
            yield pa.RecordBatch.from_arrays([b["image_id"], b["width"], b["height"], pa.array(out, pa.binary())], ["image_id", "width", "height", "raster"])

    kind = images.schema["image_id"].dataType.simpleString()
    size = images.schema["width"].dataType.simpleString(), images.schema["height"].dataType.simpleString()
    return d.mapInArrow(run, f"image_id {kind}, width {size[0]}, height {size[1]}, raster binary")


def pixels_blacked(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """The relational form: the pixels (image_id, x, y, r, g, b, a) of whole images, from (0, 0) on, with those inside a box (image_id, x, y, w, h) in opaque black.

    By sweep, in time that grows with pixels plus boxes: a box is four corners, plus and minus ones, and how many boxes
    cover a pixel is the sum of all corners above and left of it. Running sums down each column, then along each row,
    give it, so no pixel meets a box, and no task reads more than a column or a row. Boxes are clipped to the image;
    those without area, and rows with a null image or place, cover nothing and stay as they are.
    """
    sound = F.col("image_id").isNotNull() & (F.col("w") > 0) & (F.col("h") > 0)
    left, top = F.greatest(F.col("x").cast("long"), F.lit(0)), F.greatest(F.col("y").cast("long"), F.lit(0))
    right, low = F.col("x").cast("long") + F.col("w"), F.col("y").cast("long") + F.col("h")
    corner = lambda x, y, d: F.struct(x.alias("_x"), y.alias("_y"), F.lit(d).alias("_d"))
    corners = boxes.where(sound & (right > 0) & (low > 0)).select("image_id", F.explode(F.array(corner(left, top, 1), corner(right, top, -1), corner(left, low, -1), corner(right, low, 1))).alias("c")).select("image_id", "c.*")
    corners = corners.groupBy("image_id", "_x", "_y").agg(F.sum("_d").alias("_d"))
    own = pixels.select("image_id", F.col("x").cast("long").alias("_x"), F.col("y").cast("long").alias("_y"), F.lit(0).cast("long").alias("_d"), F.struct("image_id", *"xyrgba").alias("_p"))
    every = own.unionByName(corners.withColumn("_p", F.lit(None).cast(own.schema["_p"].dataType)))
    down = Window.partitionBy("image_id", "_x").orderBy("_y").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    along = Window.partitionBy("image_id", "_y").orderBy("_x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    covered = every.withColumn("_n", F.sum("_d").over(down)).where("_p IS NOT NULL").withColumn("_n", F.sum("_n").over(along))
    black = (F.col("_n") > 0) & F.col("image_id").isNotNull() & F.col("_x").isNotNull() & F.col("_y").isNotNull()
    return covered.select("_p.image_id", "_p.x", "_p.y", *[F.when(black, F.lit(255 if c == "a" else 0)).otherwise(F.col(f"_p.{c}")).alias(c) for c in "rgba"])
