"""Geometry: boxes to reading order, lines, table rows, cells with words, and key/value neighbours.

A page is the unit of all these operators: windows and groups are by (doc_id, page_number) and never larger than a
page.  Boxes that are near one another are joined by tiles or bands of the page, so the cost of a page follows
its neighbours, not its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("doc_id", "page_number")
SAME_LINE, SAME_ROW = 15, 12
#: Side of the tiles, and height of the bands, by which boxes of a page find those near them.
TILE, BAND = 128, 64


def normalised(boxes: DataFrame, width: str = "image_width", height: str = "image_height") -> DataFrame:
    """x, y, width and height as shares of the image, 4 digits."""
    share = lambda c, size: F.round(F.col(c) / F.greatest(F.col(size), F.lit(1)), 4)
    return boxes.withColumns({"x_norm": share("x", width), "y_norm": share("y", height), "w_norm": share("width", width), "h_norm": share("height", height)})


def _islands(boxes: DataFrame, new: Column, order: Window) -> DataFrame:
    """Number the runs that ``new`` begins, in the given order."""
    flagged = boxes.withColumn("_new", F.when(new, 1).otherwise(0))
    return flagged.withColumn("line", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def reading_order(boxes: DataFrame) -> DataFrame:
    """Adds line and position: a box continues the line if its top or its bottom is near that of the box before it."""
    order = Window.partitionBy(*PAGE).orderBy("y", "box_idx")
    top, bottom = F.col("y"), F.col("y") + F.col("height")
    far = (F.abs(top - F.lag(top).over(order)) > SAME_LINE) & (F.abs(bottom - F.lag(bottom).over(order)) > SAME_LINE)
    lines = _islands(boxes, F.coalesce(far, F.lit(False)), order)
    return lines.withColumn("position", F.row_number().over(Window.partitionBy(*PAGE).orderBy("line", "x", "y", "box_idx")))


def cell_rows(cells: DataFrame) -> DataFrame:
    """Adds row_idx and col_idx: a cell continues the row if its top is near that of the cell before it."""
    order = Window.partitionBy(*PAGE, "table_id").orderBy("y", "cell_idx")
    rows = _islands(cells, F.coalesce(F.abs(F.col("y") - F.lag("y").over(order)) > SAME_ROW, F.lit(False)), order)
    place = F.row_number().over(Window.partitionBy(*PAGE, "table_id", "line").orderBy("x", "y", "cell_idx")) - 1
    return rows.withColumn("col_idx", place).withColumnRenamed("line", "row_idx")


def assemble_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page_number, word_idx, text, confidence, x, y, width, height) to lines.

    A word joins the line while its centre is within 0.65 of the line's mean height from the line's mean
    centre.  The means restart with every line, which no window can do, so a page's words are folded in order.
    """
    word = F.struct("y", "x", "word_idx", "height", "width", "text", "confidence")
    pages = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(word)).alias("words"))
    start = F.struct(F.lit(0).alias("line"), F.lit(0.0).alias("centres"), F.lit(0.0).alias("heights"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("lines"))

    def step(a: Column, w: Column) -> Column:
        centre, height = w["y"] + w["height"] / 2.0, w["height"].cast("double")
        joins = (a["n"] > 0) & (F.abs(centre - a["centres"] / a["n"]) <= a["heights"] / a["n"] * 0.65)
        line = F.when(joins, a["line"]).otherwise(a["line"] + 1)
        return F.struct(
            line.alias("line"), (F.when(joins, a["centres"]).otherwise(0.0) + centre).alias("centres"), (F.when(joins, a["heights"]).otherwise(0.0) + height).alias("heights"),
            (F.when(joins, a["n"]).otherwise(0) + 1).alias("n"), F.concat(a["lines"], F.array(line)).alias("lines"),
        )

    numbers = F.aggregate("words", start, step, lambda a: a["lines"])
    each = pages.select(*PAGE, F.explode(F.arrays_zip("words", numbers.alias("lines"))).alias("z")).select(*PAGE, "z.words.*", F.col("z.lines").alias("line_number"))
    texts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("x", "y", "word_idx", "text"))))
    right, bottom = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    lines = each.groupBy(*PAGE, "line_number").agg(
        F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("text"), F.round(F.avg("confidence"), 3).alias("confidence"),
        F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("width"), (bottom - F.min("y")).alias("height"),
    )
    return lines.where("text <> ''")


def _strips(low: Column, high: Column, size: int) -> Column:
    """Numbers of the strips of the given width that lie between two coordinates; one null where a bound is null."""
    first, last = F.floor(low / size), F.floor(high / size)
    none = F.array(F.lit(None).cast("bigint"))
    return F.when(low.isNull() | high.isNull(), none).otherwise(F.sequence(first, F.greatest(first, last)))


def cell_words(cells: DataFrame, words: DataFrame) -> DataFrame:
    """The text of each cell: the words whose centre lies in it, bounds included, in their order; confidence 0.9 with text, else 1.

    A word's centre is in one tile of the page, a cell in those that it covers; the two meet in a tile.
    """
    cx, cy = F.col("x") + F.col("width") / 2.0, F.col("y") + F.col("height") / 2.0
    w = words.select(*(F.col(k).alias(f"_{k}") for k in PAGE), "word_idx", F.col("text").alias("word"), cx.alias("cx"), cy.alias("cy"), F.floor(cx / TILE).alias("_tx"), F.floor(cy / TILE).alias("_ty"))
    tiles = cells.withColumn("_cx", F.explode(_strips(F.col("x"), F.col("x") + F.col("width"), TILE))).withColumn("_cy", F.explode(_strips(F.col("y"), F.col("y") + F.col("height"), TILE)))
    inside = F.col("cx").between(F.col("x"), F.col("x") + F.col("width")) & F.col("cy").between(F.col("y"), F.col("y") + F.col("height"))
    meet = [F.col(k) == F.col(f"_{k}") for k in PAGE] + [F.col("_cx") == F.col("_tx"), F.col("_cy") == F.col("_ty"), inside]
    joined = tiles.join(w, meet, "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("word_idx").isNotNull(), F.struct("word_idx", "word")))), lambda t: t["word"]), " ")
    out = joined.groupBy(*cells.columns).agg(F.trim(text).alias("text"))
    return out.withColumn("confidence", F.when(F.col("text") != "", 0.9).otherwise(1.0))


def assemble_tables(cells: DataFrame) -> DataFrame:
    """Cells with row_idx, col_idx and text to a row for each table: the first of several rows is the header."""
    rows = cells.groupBy(*PAGE, "table_id", "row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "text"))), lambda s: s["text"]).alias("cells"))
    tables = rows.groupBy(*PAGE, "table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))), lambda s: s["cells"]).alias("all"))
    several = F.size("all") > 1
    none = F.array().cast("array<string>")
    return tables.select(
        *PAGE, "table_id", F.size("all").alias("num_rows"), F.array_max(F.transform("all", F.size)).alias("num_cols"),
        F.when(several, F.element_at("all", 1)).otherwise(none).alias("headers"), F.when(several, F.slice("all", F.lit(2), F.size("all") - 1)).otherwise(F.col("all")).alias("rows"),
    )


def neighbours(words: DataFrame) -> DataFrame:
    """Values of words that end with a colon: (doc_id, page_number, word_idx, key, value, confidence).

    To the right: later words of the same height, the first and those that follow without a wide gap.
    Below, if nothing is to the right: the first later word under the key.  A key counts once a page, where it first has a value.
    """
    w = words.select(*PAGE, "word_idx", F.trim("text").alias("text"), "x", "y", "width", "height")
    keys = w.where(F.col("text").endswith(":") & (F.char_length("text") > 1))
    k = keys.select(
        *PAGE, F.col("word_idx").alias("key_idx"), F.trim(F.expr("substring(text, 1, char_length(text) - 1)")).alias("key"), F.col("x").alias("kx"), F.col("y").alias("ky"),
        F.col("width").alias("kw"), F.greatest(F.lit(20), (F.col("height") * 1.6).cast("int")).alias("dy"),
    )
    # what a key looks at lies between dy above its top and three times dy below it
    k = k.withColumn("band", F.explode(_strips(F.col("ky") - F.col("dy"), F.col("ky") + F.col("dy") * 3, BAND)))
    both = k.join(w.withColumn("band", F.floor(F.col("y") / BAND)), [*PAGE, "band"]).where(F.col("word_idx") > F.col("key_idx"))
    right = (F.abs(F.col("y") - F.col("ky")) < F.col("dy")) & (F.col("x") > F.col("kx"))
    below = (F.abs(F.col("x") - F.col("kx")) < F.greatest(F.lit(50), F.col("kw"))) & (F.col("y") - F.col("ky") > 0) & (F.col("y") - F.col("ky") < F.col("dy") * 3)
    one = F.struct("word_idx", "x", "width", "text")
    found = both.groupBy(*PAGE, "key_idx", "key").agg(F.array_sort(F.collect_list(F.when(right, one))).alias("right"), F.min_by(F.when(below, F.col("text")), F.when(below, F.col("word_idx"))).alias("below"))

    def step(a: Column, c: Column) -> Column:
        first = F.size(a["texts"]) == 0
        near = c["x"] - a["end"] < F.greatest(F.lit(50.0), a["width"] * 1.5)
        take = ~a["over"] & (first | near)
        return F.struct(
            F.when(take, F.concat(a["texts"], F.array(c["text"]))).otherwise(a["texts"]).alias("texts"), F.when(take, (c["x"] + c["width"]).cast("double")).otherwise(a["end"]).alias("end"),
            F.when(take, c["width"].cast("double")).otherwise(a["width"]).alias("width"), (a["over"] | ~take).alias("over"),
        )

    start = F.struct(F.array().cast("array<string>").alias("texts"), F.lit(0.0).alias("end"), F.lit(0.0).alias("width"), F.lit(False).alias("over"))
    text = F.trim(F.array_join(F.aggregate("right", start, step, lambda a: a["texts"]), " "))
    beside = F.size("right") > 0
    value = F.when(beside, text).otherwise(F.col("below"))
    found = found.select(*PAGE, F.col("key_idx").alias("word_idx"), "key", value.alias("value"), F.when(beside, 0.87).otherwise(0.82).alias("confidence")).where("value <> ''")
    first = F.row_number().over(Window.partitionBy(*PAGE, F.lower("key")).orderBy("word_idx"))
    return found.withColumn("_n", first).where("_n = 1").drop("_n")


def new_keys(spatial: DataFrame, line_pairs: DataFrame) -> DataFrame:
    """Spatial pairs whose key no line of the page has."""
    known = line_pairs.select(*PAGE, F.lower("key").alias("_k")).distinct()
    return spatial.withColumn("_k", F.lower("key")).join(known, [*PAGE, "_k"], "left_anti").drop("_k")
