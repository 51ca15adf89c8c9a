"""Text blocks: splitting, OCR words, and text that tables cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_blocks(text: Column) -> Column:
    """The pieces between blank lines, or after a line that ends in a full stop; empty ones left out."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n|(?<=\.)\s*\n", -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def ocr_blocks(words: DataFrame) -> DataFrame:
    """OCR words to blocks: words by line, top and left; mean confidence; the box in page units."""
    keys = ["version_id", "page_number", "block_num", "par_num"]
    usable = words.filter("conf >= 0 and trim(text) <> ''")
    sx, sy = F.col("page_width") / F.col("image_width"), F.col("page_height") / F.col("image_height")
    box = {"x0": F.col("left") * sx, "y0": F.col("top") * sy, "x1": (F.col("left") + F.col("width")) * sx, "y1": (F.col("top") + F.col("height")) * sy}
    return usable.withColumns(box).groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_num", "top", "left", "text"))), lambda w: F.trim(w["text"])), " ").alias("text"),
        F.round(F.avg("conf") / 100, 4).alias("confidence"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


BOX = ("x0", "y0", "x1", "y1")


def _in_cells(boxes: DataFrame, size: float, prefix: str = "") -> DataFrame:
    """A row for each grid cell (cx, cy) that a box touches; boxes turned inside out or without a corner touch none."""
    x0, y0, x1, y1 = (F.col(prefix + c) for c in BOX)
    at = lambda v: F.floor(v / size)
    whole = boxes.filter((x0 <= x1) & (y0 <= y1))
    return whole.withColumn("cx", F.explode(F.sequence(at(x0), at(x1)))).withColumn("cy", F.explode(F.sequence(at(y0), at(y1))))


def outside_tables(blocks: DataFrame, tables: DataFrame, share: float = 0.55, cell: float = 128.0) -> DataFrame:
    """Blocks of which no table box of the same page covers the share or more.

    Boxes meet by the cells of a grid over the page, so that a block is compared with the tables near it; a pair that
    shares several cells counts in the one where its overlap begins. Blocks without a box or an area stay."""
    keys = ["version_id", "page_number"]
    near = _in_cells(blocks.select(*keys, "block_num", *BOX), cell)
    t = _in_cells(tables.select(*keys, *[F.col(c).alias(f"t_{c}") for c in BOX]), cell, "t_")
    left, top = F.greatest("x0", "t_x0"), F.greatest("y0", "t_y0")
    width, height = F.greatest(F.least("x1", "t_x1") - left, F.lit(0.0)), F.greatest(F.least("y1", "t_y1") - top, F.lit(0.0))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    begins = (F.floor(left / cell) == F.col("cx")) & (F.floor(top / cell) == F.col("cy"))
    covered = near.join(t, [*keys, "cx", "cy"]).filter(begins & (area > 0) & (width * height / area >= share)).select(*keys, "block_num").distinct()
    return blocks.join(covered, [*keys, "block_num"], "left_anti")
