"""Sheets of ordered items: pages, rows, columns and pixel positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.operators.quality import numbered


def page_count(items: Column, columns: int, rows: int) -> Column:
    return F.ceil(items / (columns * rows)).cast("int")


def place(items: DataFrame, sheet: list[str], order: list, columns: int = 5, rows: int = 6, width: int = 320, height: int = 240, gap: int = 12, margin: int = 24) -> DataFrame:
    """Add n_items, pages, page, row, column (from 0), x and y of each item on its sheet."""
    columns, rows = min(8, max(1, columns)), min(20, max(1, rows))
    width, height = max(120, width), max(90, height)
    each = columns * rows
    placed = numbered(items, sheet, [F.col(c) if isinstance(c, str) else c for c in order], "_i", "n_items").withColumn("_i", F.col("_i") - 1)
    row, column = F.floor(F.col("_i") % each / columns).cast("int"), (F.col("_i") % columns).cast("int")
    return (
        placed.withColumn("pages", page_count(F.col("n_items"), columns, rows))
        .withColumn("page", (F.floor(F.col("_i") / each) + 1).cast("int"))
        .withColumn("row", row)
        .withColumn("column", column)
        .withColumn("x", (F.col("column") * (width + gap) + margin).cast("int"))
        .withColumn("y", (F.col("row") * (height + gap) + margin).cast("int"))
        .drop("_i")
    )


def card_cells(colors: DataFrame, card: str, slot_order: Column, width: int = 1920, height: int = 1080) -> DataFrame:
    """Add x0, y0, x1, y1 of ten colours on a card of five columns and two rows; the centre is at cx, cy."""
    i = F.row_number().over(Window.partitionBy(card).orderBy(slot_order)) - 1
    cw, ch = width // 5, height // 2
    out = colors.withColumn("_i", i).withColumn("x0", (F.col("_i") % 5 * cw).cast("int")).withColumn("y0", (F.floor(F.col("_i") / 5) * ch).cast("int"))
    return out.withColumn("x1", F.col("x0") + cw).withColumn("y1", F.col("y0") + ch).withColumn("cx", F.col("x0") + cw // 2).withColumn("cy", F.col("y0") + ch // 2).drop("_i")


def overview_size(groups: Column, columns: int = 2, width: int = 960, height: int = 540, gap: int = 18) -> tuple[Column, Column]:
    rows = F.ceil(groups / columns)
    return F.lit(columns * width + (columns + 1) * gap), (rows * height + (rows + 1) * gap).cast("int")
