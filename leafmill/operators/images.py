"""Image steps: geometry as expressions, pixels as NumPy inside Arrow batches of an image table.

An image table has the columns of Spark's image source: origin, height, width, nChannels, data (rows of
pixels, blue first).  Steps that need a vision library (edges and their lines, contours, recognition engines) enter as tables of segments
and boxes, or are adapters: ``recognise`` takes any function from pixels to words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import bound

MAX_SIDE = 2400


def target_size(width: Column, height: Column) -> Column:
    """Size after shrinking the longer side to MAX_SIDE at most; never enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(MAX_SIDE)) / F.greatest(width, height))
    return F.struct((width * scale).cast("int").alias("width"), (height * scale).cast("int").alias("height"))


def skew_angle(segments: DataFrame) -> DataFrame:
    """(doc_id, page_number, x1, y1, x2, y2) to the median angle of the flat segments; 0 unless it is over 0.3 degrees."""
    angle = F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    flat = segments.select("doc_id", "page_number", angle.alias("a"))
    median = F.median(F.when(F.abs("a") < 45, F.col("a")))
    return flat.groupBy("doc_id", "page_number").agg(F.coalesce(F.when(F.abs(median) > 0.3, median), F.lit(0.0)).alias("skew_angle"))


def detected_boxes(candidates: DataFrame) -> DataFrame:
    """Boxes of plausible size, padded by 2 % and 4 % and clipped to the image (image_width, image_height)."""
    area, page = F.col("width") * F.col("height"), F.col("image_width") * F.col("image_height")
    kept = candidates.where((area >= 40) & (area <= 0.95 * page) & (F.col("height") >= 8) & (F.col("width") >= 8))
    px, py = (F.col("width") * 0.02).cast("int"), (F.col("height") * 0.04).cast("int")
    x, y = F.greatest(F.lit(0), F.col("x") - px), F.greatest(F.lit(0), F.col("y") - py)
    return kept.select("doc_id", "page_number", "box_idx", x.alias("x"), y.alias("y"), F.least(F.col("image_width") - x, F.col("width") + px * 2).alias("width"), F.least(F.col("image_height") - y, F.col("height") + py * 2).alias("height"))


def ink_runs(boxes: DataFrame) -> DataFrame:
    """Boxes with ``projection`` (ink by row) over 40 rows high become their runs of ink, split at thin rows: over 12 % of the most ink, 10 rows or more; without such a run they stay."""
    boxes = boxes.withColumn("_least", F.array_max("projection") * 0.12)
    rows = F.filter(F.transform("projection", lambda v, i: F.when(v > F.col("_least"), i)), lambda i: i.isNotNull())
    none = F.array().cast("array<struct<top:int,bottom:int>>")

    def step(acc: Column, i: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["top"].alias("top"), i.alias("bottom"))))
        return F.when(last["bottom"] == i - 1, longer).otherwise(F.concat(acc, F.array(F.struct(i.alias("top"), i.alias("bottom")))))

    runs = F.filter(F.aggregate(rows, none, step), lambda r: r["bottom"] - r["top"] + 1 >= 10)
    whole = F.array(F.struct(F.lit(0).alias("top"), (F.col("height") - 1).alias("bottom")))
    chosen = F.when((F.col("height") > 40) & (F.size(runs) > 0), runs).otherwise(whole)
    out = boxes.select("doc_id", "page_number", "box_idx", "x", "y", "width", F.posexplode(chosen).alias("part", "run"))
    return out.select("doc_id", "page_number", "box_idx", "part", "x", (F.col("y") + F.col("run.top")).alias("y"), "width", (F.col("run.bottom") - F.col("run.top") + 1).alias("height"))


def ctc_text(steps: Column, charset: str) -> Column:
    """Greedy decoding: classes by time step, 0 being blank; repeats collapse, then blanks go."""
    changed = F.filter(steps, lambda c, i: (i == 0) | (c != F.get(steps, F.greatest(i - 1, F.lit(0)))))
    symbols = F.array(*(F.lit(c) for c in charset))
    return F.array_join(F.transform(F.filter(changed, lambda c: c != 0), lambda c: F.element_at(symbols, c.cast("int"))), "")


def recognition_confidence(text: Column) -> Column:
    return F.round(F.lit(0.85) + F.least(F.lit(0.12), F.char_length(text) * 0.01), 3)


def glyph_confidence(heights: Column) -> Column:
    """1 - variance / median squared (1 at least) of the glyphs' heights, between 0.5 and 0.95, 3 digits; 0.95 without glyphs."""
    n = F.size(heights)
    mean = F.aggregate(heights, F.lit(0.0), lambda s, x: s + x) / n
    variance = bound(mean, lambda m: F.aggregate(heights, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n)
    middle = lambda o: (F.get(o, F.floor((n - 1) / 2).cast("int")) + F.get(o, F.floor(n / 2).cast("int"))) / 2
    median = bound(F.array_sort(heights), middle)
    confidence = F.least(F.lit(0.95), F.greatest(F.lit(0.5), 1 - variance / F.greatest(median * median, F.lit(1.0))))
    return F.round(F.when(n > 0, confidence).otherwise(0.95), 3)


def _pixels(row: pd.Series) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of blue, green, red pixels."""
    return image[..., 0] if image.shape[2] == 1 else np.rint(image[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def steps(images: DataFrame, functions: dict[str, Callable[[np.ndarray], np.ndarray]], skip: tuple[str, ...] = ()) -> DataFrame:
    """Images after each of the given steps, in order: origin, step, step_key, height, width, nChannels, data; step 0 is the original.

    functions: pixels (height x width x channels, or without channels) to pixels, by name; the image library is the caller's.
    """
    if unknown := set(skip) - set(functions):
        raise ValueError(f"no such step: {sorted(unknown)}")
    wanted = [(k, f) for k, f in functions.items() if k not in skip]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, row in pdf.iterrows():
                now, out = _pixels(row), []
                for k, (name, f) in enumerate([("original", lambda x: x), *wanted]):
                    now = f(now)
                    out.append((row["origin"], k, name, now.shape[0], now.shape[1], 1 if now.ndim == 2 else now.shape[2], now.tobytes()))
                yield pd.DataFrame(out, columns=["origin", "step", "step_key", "height", "width", "nChannels", "data"])

    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "origin string, step int, step_key string, height int, width int, nChannels int, data binary")


def patches(boxes: DataFrame, least: int = 4) -> DataFrame:
    """Boxes (with image_width and image_height) clipped to the image; what is left of fewer than ``least`` pixels a side goes."""
    x, y = F.greatest(F.lit(0), F.col("x")), F.greatest(F.lit(0), F.col("y"))
    right, bottom = F.least(F.col("image_width"), F.col("x") + F.col("width")), F.least(F.col("image_height"), F.col("y") + F.col("height"))
    clipped = boxes.withColumns({"_x": x, "_y": y, "_w": right - x, "_h": bottom - y}).where((F.col("_w") >= least) & (F.col("_h") >= least))
    return clipped.withColumns({"x": F.col("_x"), "y": F.col("_y"), "width": F.col("_w"), "height": F.col("_h")}).drop("_x", "_y", "_w", "_h")


def recognise(images: DataFrame, engine: Callable[[np.ndarray], list[tuple]]) -> DataFrame:
    """Words by an engine, a function from pixels to (text, confidence, x, y, width, height) rows; blank and weak words go."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(row["origin"], i, *w) for _, row in pdf.iterrows() for i, w in enumerate(engine(_pixels(row)))]
            yield pd.DataFrame(rows, columns=["origin", "word_idx", "text", "confidence", "x", "y", "width", "height"])

    words = images.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "origin string, word_idx int, text string, confidence double, x int, y int, width int, height int")
    return words.where((F.trim("text") != "") & (F.col("confidence") >= 0.20))


def engine_for(name: str, available: dict[str, Callable]) -> Callable:
    """The engine of that name, or for ``auto`` the first that is there, in the usual order."""
    order = ["custom", "tesseract", "rapidocr", "easyocr", "builtin"]
    chosen = next((n for n in order if n in available), None) if name == "auto" else name
    if chosen not in available:
        raise ValueError(f"no recognition engine {name!r}; available: {sorted(available)}")
    return available[chosen]
